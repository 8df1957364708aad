import json

import pytest

from quillmark.operators import nested
from quillmark.operators.nested import AUDIT_KEYS, AUDIT_LISTS, audit_children, canonical_records, extract_record, flatten_records, merged_schema

SCHEMA = "audit_id long, audit_json string, record string"


def audits(spark, *texts):
    return spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts, 1)], SCHEMA)


def children(spark, *texts):
    return sorted(tuple(r) for r in audit_children(audits(spark, *texts)).collect())


FULL = {
    "schema_version": "v", "decision": "INCLUDE",
    "candidate_reasoning": {"candidate_facts": [{"fact_id": "F1", "nearby_reference_ids": ["R1", "R1"]}, {"nearby_reference_ids": "R2"}, {"fact_id": None, "nearby_reference_ids": None}]},
    "evidence_assessments": {"F2": [{"reference_id": "R9", "relevant_figure_ids": [{"id": "fig1"}, None]}], "F1": [{"reference_id": "R8"}]},
    "fact_coverage": {"fact_id": "F1", "eligible_oa_primary_reference_ids": {"b": "R3", "a": ["R4", "R5"]}},
}
WANT = [
    ("assessment", 0, 1, "R9"), ("assessment", 0, 2, "R8"), ("assessment_figure", 1, 1, "fig1"), ("assessment_figure", 1, 2, ""), ("coverage", 0, 1, "F1"),
    ("coverage_reference", 1, 1, "R3"), ("coverage_reference", 1, 2, "R4"), ("coverage_reference", 1, 3, "R5"),
    ("fact", 0, 1, "F1"), ("fact", 0, 2, ""), ("fact", 0, 3, ""), ("fact_reference", 1, 1, "R1"), ("fact_reference", 1, 2, "R1"), ("fact_reference", 2, 1, "R2"),
]


def test_shapes(spark):
    assert children(spark, json.dumps(FULL)) == [(1, *w) for w in WANT]


def test_wrapped_and_encoded(spark):
    plain = json.dumps(FULL)
    encoded = json.dumps({**FULL, "candidate_reasoning": json.dumps(FULL["candidate_reasoning"])})
    texts = ["```json\n" + plain + "\n```", "Here {is} it:\n" + plain + "\nBye", "﻿" + plain, json.dumps({"result": FULL, "usage": {"n": 1}}), json.dumps({"result": plain}), json.dumps(plain), encoded]
    got = children(spark, *texts)
    for i in range(1, len(texts) + 1):
        assert [g[1:] for g in got if g[0] == i] == WANT, i


def test_broken_texts_give_nothing(spark):
    plain = json.dumps(FULL)
    assert children(spark, None, "", "  ", "no", plain[:-20], "null", "[]", "{}", plain[: len(plain) // 2]) == []


def test_empty_table(spark):
    assert audit_children(spark.createDataFrame([], SCHEMA)).count() == 0


def test_record_inside_a_broken_wrapper():
    assert extract_record('{"result": ' + json.dumps(FULL) + ', "usage": {"a', frozenset(AUDIT_KEYS)) == FULL
    assert extract_record('{"a": 1}', frozenset(AUDIT_KEYS)) is None


def test_repeated_rows_and_long_texts(spark):
    long = {**FULL, "note": "x" * 2_000_000}
    df = spark.createDataFrame([(1, json.dumps(long)), (1, json.dumps(long))], "audit_id long, audit_json string")
    assert audit_children(df).count() == 2 * len(WANT)


def test_general_flattening(spark):
    df = spark.createDataFrame([(1, '{"k": "a", "o": {"x": 1}, "l": [{"v": 1, "m": [[1, 2], [3]]}, {"w": "z"}]}'), (2, '{"k": "b", "l": null}')], "id long, j string")
    t = flatten_records(df, "id", "j", merged_schema(df, "j"))
    assert set(t) == {"$", "$.l", "$.l.m", "$.l.m[]"}
    assert sorted(map(tuple, t["$"].select("id", "k", "o_x").collect())) == [(1, "a", "1"), (2, "b", None)]
    assert sorted(map(tuple, t["$.l"].select("id", "pos_1", "v", "w").collect())) == [(1, 1, "1", None), (1, 2, None, "z")]
    assert sorted(map(tuple, t["$.l.m[]"].collect())) == [(1, 1, 1, 1, "1"), (1, 1, 1, 2, "2"), (1, 1, 2, 1, "3")]


def test_canonical_form_keeps_order(spark):
    df = audits(spark, json.dumps(FULL))
    rec = json.loads(canonical_records(df, "audit_id", "audit_json", AUDIT_KEYS, declared=AUDIT_LISTS).first().record)
    assert [a["reference_id"] for a in rec["evidence_assessments"]] == ["R9", "R8"]
    with pytest.raises(KeyError):
        rec["nothing"]


def test_records_keyed_by_their_own_ids(spark, monkeypatch):
    """Keys that are data make one place, however many there are, with and without a record that shows a list."""
    monkeypatch.setattr(nested, "MAX_PATHS", 60)
    monkeypatch.setattr(nested, "MAX_KEYS", 12)
    texts = [json.dumps({**FULL, "evidence_assessments": {f"id{i}": {"reference_id": f"R{i}", "relevant_figure_ids": []}}, "notes": {f"n{i}": {"v": i}}}) for i in range(100)]
    got = children(spark, *texts)
    assert [g[4] for g in got if g[1] == "assessment"] == [f"R{i}" for i in range(100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "audit_id long, audit_json string")
    lists, objects = nested.infer_shape(df, "audit_json", AUDIT_KEYS, declared=AUDIT_LISTS)
    assert lists["$.notes"] == {"v"} and not any("id7" in p or "n7" in p for p in objects)
    t = nested.audit_tables(df)["$.notes"]
    assert sorted(int(r.v) for r in t.collect()) == list(range(100))


def test_many_genuine_fields_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(nested, "MAX_PATHS", 20)
    df = audits(spark, json.dumps({**FULL, **{f"f{i}": 1 for i in range(40)}}))
    with pytest.raises(ValueError):
        nested.infer_shape(df, "audit_json", AUDIT_KEYS)
