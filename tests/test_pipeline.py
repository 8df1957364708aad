import pytest
from pyspark.sql import functions as F

from quillmark.operators import pipeline as P
from quillmark.operators import reasoning as R


def rules(df):
    return sorted((r.rule, r.detail) for r in df.collect())


def test_arguments():
    assert P.year_range("2019") == (2019, 2019) and P.year_range(" 2019 - 2021") == (2019, 2021) and P.share("0.25") == 0.25
    for f, bad in ((P.year_range, "2021-2019"), (P.year_range, "1850"), (P.year_range, "x"), (P.share, "1.5"), (P.share, -1)):
        with pytest.raises(ValueError):
            f(bad)


def test_resolution_over_the_memo(spark):
    refs = spark.createDataFrame([(1, None, " ", "10.99901/a."), (2, "5", None, None), (3, None, "PMC9", None), (4, None, None, "10.99901/fail"), (5, None, None, None), (1, None, " ", "10.99901/a.")], "k long, pmid string, pmcid string, doi string")
    memo = spark.createDataFrame([("doi", "10.99901/a", "7", None), ("pmid", "7", None, "PMC1"), ("pmid", "5", None, "PMC2"), ("doi", "10.99901/fail", None, None)], "kind string, id string, pmid string, pmcid string")
    got = {r.k: (r.pmid, r.pmcid, r.found_by) for r in P.resolved_ids(refs, "k", memo).collect()}
    assert got == {1: ("7", "PMC1", "pmid"), 2: ("5", "PMC2", "pmid"), 3: ("", "PMC9", "own"), 4: ("", "", "none"), 5: ("", "", "none")}
    opened = P.open_by_doi(refs, "k", spark.createDataFrame([("10.99901/a", True), ("10.99901/fail", None)], "doi string, is_open boolean"))
    assert {r.k for r in opened.filter("is_open").collect()} == {1}
    assert P.resolved_ids(refs.limit(0), "k", memo).count() == 0


def test_pairs_in_classes_say_the_same_as_pairs(spark):
    facts = spark.createDataFrame([(1, "p", 2), (2, "p", 0), (3, "q", 1)], "fact_key long, paper string, n_ids int")
    edges = spark.createDataFrame([(1, "p", "R1"), (3, "q", "R1")], "fact_key long, paper string, ref string")
    dim = spark.createDataFrame([("p", "R1", 0), ("p", "R2", 0), ("p", "T1", 1), ("q", "R1", 0)], "paper string, ref string, trace_depth int")
    classes = P.required_pair_classes(facts, edges, dim)
    got = sorted(tuple(r) for r in P.pairs_of(facts, facts, classes).collect())
    assert got == [(1, "R1"), (1, "T1"), (2, "R1"), (2, "R2"), (2, "T1"), (3, "R1")]


def test_final_rows_audits_and_sources(spark):
    papers = spark.createDataFrame([("p",), ("q",), ("r",), ("p",)], "paper string")
    cover = spark.createDataFrame([(1, "p", True), (2, "p", True), (4, "q", False), (3, "q", False)], "fact_key long, paper string, covered boolean")
    assert {r.paper: (r.decision, r.n_facts, r.failed) for r in P.final_rows(papers, cover).collect()} == {"p": ("INCLUDE", 2, ""), "q": ("EXCLUDE", 2, "3,4"), "r": ("NO_FACTS", 0, "")}
    files = spark.createDataFrame([("p", "a", True), ("p", "b", None)], "paper string, name string, found boolean")
    assert {r.paper: (r.n_files, r.n_missing, r.complete) for r in P.dataset_audit(papers, files, "paper", "name").collect()} == {"p": (2, 1, False), "q": (0, 0, True), "r": (0, 0, True)}
    figs = spark.createDataFrame([("p", 1, "x"), ("p", 2, "x"), ("p", 3, ""), ("p", 4, "")], "paper string, n int, s string")
    assert sorted(r.n for r in P.first_of_source(figs, "paper", F.col("s"), ["n"]).collect()) == [1, 3, 4]
    rows = spark.createDataFrame([(1, 2020, True), (2, 2020, None), (3, 2020, True), (4, 2021, True)], "k int, y int, ok boolean")
    assert sorted((r.k, r["rank"]) for r in P.collected(rows, "y", ["k"], F.col("ok"), {2020: 1, 2021: 5}).collect()) == [(1, 1), (4, 1)]
    assert [r.k for r in P.without_text(spark.createDataFrame([(1, " ", None), (2, None, "x")], "k int, t string, m string"), "k", "t", ["m"]).collect()] == [1]


def test_reviews(spark):
    part = lambda result="PASS", reason='"r"': f'{{"result": "{result}", "reason": {reason}}}'
    names = R.DIMENSIONS
    review = lambda final, parts: "text ```json\n{" + ", ".join(f'"{n}": {p}' for n, p in zip(names, parts)) + f', "final_decision": "{final}"}}\n```'
    rows = [(1, review("INCLUDE", [part()] * 4)), (2, review("EXCLUDE", [part()] * 3 + [part("FAIL")])), (3, review("INCLUDE", [part()] * 3 + [part("FAIL")])), (4, review("INCLUDE", [part("MAYBE"), part(reason='" \\n "'), part(reason="3"), '"x"'])), (5, "nothing"), (6, None), (7, "[1]"), (8, review("INCLUDE", [part()] * 3))]
    df = spark.createDataFrame(rows, "k int, a string")
    got = sorted(tuple(r) for r in R.review_rules(df, "k", "a").collect())
    assert set(got) == {
        (3, "final_decision", "INCLUDE"), (4, "part_missing", names[3]), (4, "reason", names[2]), (4, "reason", names[1]), (4, "result", names[0]),
        (5, "no_object", ""), (6, "no_object", ""), (7, "no_object", ""), (8, "part_missing", names[3]),
    } and len(got) == 9
    out = {r.k: r.final_decision for r in R.review_outcomes(df, "k", "a").collect()}
    assert out == {1: "INCLUDE", 2: "EXCLUDE"}


def test_facts_and_figures(spark):
    facts = spark.createDataFrame([(1, "p", "It — “works”", ["R1"], 1), (2, "p", "absent", ["R9"], 2), (3, "q", None, [], None)], "fact_key long, paper string, anchor_text string, ids array<string>, atomic_claim_count int")
    intros = spark.createDataFrame([("p", 'Here it - "works" and It -  "works".')], "paper string, introduction string")
    known = spark.createDataFrame([("p", "R1")], "paper string, ref string")
    got = sorted(tuple(r) for r in R.fact_rules(facts, intros, known).collect())
    assert got == [("fact 2", "anchor", "absent"), ("fact 2", "claims", "2"), ("fact 2", "unknown_reference", "R9"), ("fact 3", "anchor", None), ("fact 3", "claims", None), ("fact 3", "no_reference", ""), ("paper q", "fact_count", "1")]
    figs = spark.createDataFrame([("d", "f1"), ("d", "f2")], "d string, figure_uid string")
    dec = spark.createDataFrame([("d", "f1", "EXPERIMENTAL_DATA", True, None, "INCLUDE"), ("d", "f3", "X", False, False, "EXCLUDE"), ("d", "f3", "X", False, False, "EXCLUDE")], "d string, figure_uid string, classification string, real_data boolean, relevant boolean, decision string")
    assert rules(R.figure_rules(figs, dec, "d")) == [("figure_extra", "f3"), ("figure_missing", "f2"), ("figure_repeated", "f3"), ("unsafe_inclusion", "f1")]
    assert R.included_figures(dec).count() == 0


def test_documents_analyses_and_paths(spark):
    docs = spark.createDataFrame([(1, '{"v": "1", "a": {"b": null}, "l": [1, 2]}'), (2, '{"v": "2", "l": []}'), (3, "[]"), (4, None)], "k int, d string")
    got = sorted(tuple(r) for r in R.document_rules(docs, "k", "d", ["a", "a.b"], {"v": "1"}, {"l": (1, 2)}).collect())
    assert got == [(1, "required", "a.b"), (2, "constant", "v"), (2, "required", "a"), (2, "required", "a.b"), (2, "size", "l"), (3, "no_object", ""), (4, "no_object", "")]
    a = spark.createDataFrame([("k1", "full"), ("k9", "full")], "package_id string, evidence_mode string")
    o = spark.createDataFrame([("k1", "O1", ["f1", "f2"], "read"), ("k1", "O2", [], "told")], "package_id string, observation_id string, figure_ids array<string>, provenance string")
    s = spark.createDataFrame([(k, f"P{i}", ["O1"]) for k in ("k1",) for i in range(2)] + [("k9", "P8", ["O1"]), ("k9", "P9", ["O1"])], "package_id string, subconclusion_id string, supporting_observation_ids array<string>")
    packages, kept = spark.createDataFrame([("k1",), ("k2",)], "package_id string"), spark.createDataFrame([("k1", "f1")], "package_id string, figure_id string")
    assert rules(R.analysis_violations(a, o, s, "full", packages=packages, figures=kept, provenance="read")) == [("figure_not_included", "O1:f2"), ("no_analysis", ""), ("provenance", "O2"), ("unknown_observation", "P8:O1"), ("unknown_observation", "P9:O1"), ("unknown_package", "")]
    refs = spark.createDataFrame([("d", "R1"), ("d", "R2")], "dataset string, reference_id string")
    props = spark.createDataFrame([("d", "R1", "A"), ("d", "R2", "B")], "dataset string, reference_id string, proposition_id string")
    hyp = spark.createDataFrame([("d", "H1", ["B", "A"])], "dataset string, hypothesis_id string, path array<string>")
    assert rules(R.proposition_violations(props, refs, hypotheses=hyp)) == [("hypothesis_count", "1")]
    assert rules(R.proposition_violations(props, refs, hypotheses=hyp.unionByName(spark.createDataFrame([("d", "H2", ["A"])], hyp.schema)))) == [("path", "H2")]
