import itertools
import random

from quillmark.llm.formatting import citation_key, collapse, duplicate_classes, least_rotation, stripped

SCHEMA = "row_id long, citation_text string, title string, copies int"


def pairs(spark, rows):
    df = spark.createDataFrame([(i, c, t, 0) for i, c, t in rows], SCHEMA)
    return sorted((r.keep_id, r.row_id) for r in duplicate_classes(df).filter("row_id <> keep_id").collect())


T = "Rapid export depends on A-B7 binding"
C = "Doe J, Roe KL. Rapid export depends on A-B7 binding. Notes in Cells. 2008;66:2167-2175."


def test_formats_of_one_record(spark):
    rows = [
        (5, C, T), (3, C.upper(), "rapid  export depends on a–b7 binding."), (9, "Notes in Cells | Doe J., Roe K.L. | Rapid export depends on AB7 binding | 2008;66:2167–2175", T),
        (7, "2008;66:2167 2175; Rapid\texport depends\non A-B7 binding; Doe J  Roe KL; Notes in Cells", " " + T), (8, C, T), (8, C, T),
    ]
    assert pairs(spark, rows) == [(3, 5), (3, 7), (3, 8), (3, 8), (3, 9)]


def test_near_misses_stay_apart(spark):
    rows = [(1, C, T), (2, C.replace("2167-2175", "2176-2157"), T), (3, C.replace("Roe KL", "Roe LK"), T), (4, C, ""), (5, C.replace("A-B7", "B-A7"), T.replace("A-B7", "B-A7")), (6, C.replace("Doe J, Roe KL", "Roe KL, Doe J"), T)]
    assert pairs(spark, rows) == []


def test_nulls_empty_and_long(spark):
    long = "word " * 200_000
    rows = [(1, None, None), (2, "", ""), (3, " . ", None), (4, long, None), (5, long.upper(), ""), (6, None, "x")]
    assert pairs(spark, rows) == [(1, 2), (1, 3), (4, 5)]
    assert pairs(spark, []) == []


def test_collapse_counts(spark):
    df = spark.createDataFrame([(1, C, T, 0), (2, C.lower(), T, 0), (3, "other", "", 0)], SCHEMA)
    assert sorted((r.row_id, r.n_copies) for r in collapse(df).collect()) == [(1, 2), (3, 1)]


def test_field_order_against_brute_force():
    rnd = random.Random(2)
    authors = ["Doe J, Roe KL, et al", "Li J, Wu X", "Garcia Lopez M, Ng A", "van der Berg J; O'Neil-Smith BC", "Xu, Q.; Ba, T.", "World Health Organization", "Ōta Z and 2 others", "A"]
    for a in authors:
        for title in ("A study of B12 cells", "Cells", "Ab 2019 1-2"):
            fields = [a, title, "Annals of Cells", "2019;7:15-30"]
            keys = {citation_key(rnd.choice([str.upper, str.lower, str])(sep.join(order)), title) for order in itertools.permutations(fields) for sep in (" | ", " / ", "; ", ". ")}
            assert len(keys) == 1, (a, title, keys)
    for a, b in itertools.combinations(authors, 2):
        assert citation_key(f"{a}. T. J. 2019;1:2", "T") != citation_key(f"{b}. T. J. 2019;1:2", "T")
    assert citation_key("Doe J. Annals. 2019", "") == citation_key("2019 / Annals / Doe J", "") != citation_key("Doe J. Annals. 2018", "")
    assert stripped("Ä-b 1!") == "äb1"


def test_least_rotation_against_brute_force():
    rnd = random.Random(5)
    for _ in range(300):
        s = "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 12)))
        assert least_rotation(s) == min((s[i:] + s[:i] for i in range(len(s))), default="")


def test_hot_class(spark):
    df = spark.range(60_000).selectExpr("id as row_id", f"case when id % 3 = 0 then '{C}' else concat('Doe J. Title ', id) end as citation_text", "'' as title", "0 as copies")
    got = duplicate_classes(df)
    assert got.count() == 20_000 and got.select("keep_id").distinct().count() == 1
