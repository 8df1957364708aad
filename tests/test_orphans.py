import datetime as dt

import pytest

from quillmark.operators.orphans import find_orphans, orphan_references, orphan_report
from quillmark.operators.skew import hot_keys, skew_join

REFS = [(1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, "a", None), (5, None, None), (6, None, "q"), (7, "z", "x"), (7, "z", "x")]


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("match,want", [("simple", [2, 7, 7]), ("partial", [2, 6, 7, 7]), ("full", [2, 3, 4, 6, 7, 7])])
def test_match_semantics(spark, match, want):
    refs = spark.createDataFrame(REFS, "id long, k string, v string")
    targets = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "y")], "k string, v string")
    assert ids(find_orphans(refs, targets, ["k", "v"], "id", match)) == want


def test_empty_sides_and_extra_columns(spark):
    refs = spark.createDataFrame(REFS[:2], "id long, k string, v string")
    empty = spark.createDataFrame([], "k string, v string, id long")
    assert ids(find_orphans(refs, empty, ["k", "v"], "id")) == [1, 2]
    assert find_orphans(refs.limit(0), empty, ["k", "v"], "id").count() == 0
    with pytest.raises(ValueError):
        find_orphans(refs, empty, ["k", "v"], "id", "fuzzy")


def test_hot_keys_do_not_change_the_result(spark):
    left = spark.range(50_000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('k', id % 500) end as k")
    right = spark.createDataFrame([("hot", 1), ("k7", 2), ("k8", 3)], "k string, x int")
    assert [r.k for r in hot_keys(left, ["k"], min_rows=1000).collect()] == ["hot"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew_join(left, right, ["k"], how, "id").select("id").collect()
        want = left.join(right, "k", how).select("id").collect()
        assert sorted(got) == sorted(want), how


def test_usable_records_only(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    facts = spark.createDataFrame(
        [(1, "PMC1", ["r1 ", "R2,r3", None, " "], t(5)), (2, " pmc1", ["R4"], t(1)), (3, "2", ["R1"], t(5)), (4, None, ["R1"], t(5)), (5, "1", None, t(5)), (6, "1", ["R1", "R1"], None)],
        "fact_key long, pmcid string, nearby_reference_ids array<string>, extracted_at timestamp_ntz",
    )
    records = spark.createDataFrame(
        [(1, "1", "R1", None, t(1), None), (2, "PMC1", "R3", "", t(1), t(2)), (3, "PMC1", "R4", " r1", t(3), None), (4, "PMC1", "R9::R5", "R9", t(4), None), (5, "PMC1", "R1::R5", "R1", t(4), None)],
        "row_id long, citing_pmcid string, reference_id string, source_reference_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz",
    )
    got = {(r.src_field, r.src_id, r.target_id) for r in orphan_references(facts, records).collect()}
    n = "nearby_reference_ids"
    assert got == {(n, 1, "R2"), (n, 1, "R3"), (n, 2, "R4"), (n, 3, "R1"), (n, 4, "R1"), (n, 6, "R1"), ("source_reference_id", 4, "R9"), ("reference_id", 4, "R9")}
    assert sum(r.n_orphans for r in orphan_report(facts, records).collect()) == len(got)
