import pytest

from quillmark.operators import reasoning as R


def rules(df):
    return sorted((r.rule, r.detail) for r in df.collect())


def test_subsets(spark):
    want = spark.createDataFrame([("p", "S1", ["F1", "F2"]), ("p", "S2", ["F1", "F3"])], "paper string, subset_id string, fact_ids array<string>")
    schema = "paper string, subset_id string, fact_ids array<string>, gap_still_defined boolean, hypothesis_answers_gap boolean, hypothesis_compatible_with_facts boolean, sufficient boolean"
    ok = [("p", "S1", ["F1", "F2"], True, True, True, True), ("p", "S2", ["F1", "F3"], True, None, True, False)]
    assert rules(R.subset_violations(spark.createDataFrame(ok, schema), want)) == []
    bad = [("p", "S1", ["F2", "F1"], True, True, True, False), ("p", "S9", ["F1"], True, True, True, True), ("p", "S1", ["F1", "F2"], True, True, True, True)]
    assert rules(R.subset_violations(spark.createDataFrame(bad, schema), want)) == [("subset_extra", "S9"), ("subset_facts", "S1"), ("subset_missing", "S2"), ("subset_repeated", "S1"), ("subset_sufficient", "S1")]


def test_bridges_and_pairs(spark):
    scopes = spark.createDataFrame([("p",), ("q",)], "paper string")
    facts = spark.createDataFrame([("p", "F1"), ("p", "F2"), ("q", "F1"), ("q", "F2")], "paper string, fact_id string")
    refs = spark.createDataFrame([("p", "R1")], "paper string, reference_id string")
    b = spark.createDataFrame(
        [("p", "B1", ["F1", "F2"], "ESTABLISHED", ["R1"]), ("p", "B2", ["F1", "F2"], "MISSING", []), ("q", "B1", ["F1", "F1"], "ODD", ["R7"]), ("q", "B1", ["F1", "F9"], "PARTIAL", None)],
        "paper string, bridge_id string, source_fact_ids array<string>, status string, supporting_reference_ids array<string>",
    )
    got = R.bridge_violations(b, facts, refs, scopes)
    assert {r.paper for r in got.collect()} == {"q"}
    assert rules(got) == [("bridge_facts", "B1"), ("bridge_repeated", "B1"), ("bridge_status", "B1"), ("bridge_unknown_fact", "B1:F9"), ("bridge_unknown_reference", "B1:R7"), ("bridge_without_references", "B1")]
    schema = "paper string, pair_id string, role string, source_bridge_ids array<string>, gap_id string, knowledge_gap string, hypothesis_id string, hypothesis string, independent_variable string, dependent_variable string, falsification_condition string"
    pairs = spark.createDataFrame([("p", "P1", "PRIMARY", ["B2"], "G1", "gap one", "H1", "h one", "x", "y", "z"), ("p", "P2", "ALTERNATIVE", ["B1", "B9"], "G2", "Gap  one", "H1", " ", "x", "y", "z")], schema)
    got = [r for r in R.pair_violations(pairs, b, scopes).collect()]
    assert sorted((r.rule, r.detail) for r in got if r.paper == "p") == [("gap_repeated", "gap one"), ("hypothesis_id_repeated", "H1"), ("pair_hypothesis", "P2"), ("pair_unknown_bridge", "P2:B9"), ("pair_without_open_bridge", "P2")]
    assert sorted((r.rule, r.detail) for r in got if r.paper == "q") == [("pair_count", "0"), ("primary_count", "0")]


def test_analyses_joint_results_propositions(spark):
    a = spark.createDataFrame([("k1", "full"), ("k2", None)], "package_id string, evidence_mode string")
    o = spark.createDataFrame([("k1", "O1")], "package_id string, observation_id string")
    s = spark.createDataFrame([("k1", "P1", ["O1"]), ("k1", "P2", ["O1", "O2"]), ("k1", "P3", None)], "package_id string, subconclusion_id string, supporting_observation_ids array<string>")
    assert rules(R.analysis_violations(a, o, s, "full")) == [("evidence_mode", None), ("subconclusion_count", "0"), ("unknown_observation", "P2:O2"), ("unsupported", "P3")]
    scopes = spark.createDataFrame([("d",)], "dataset string")
    subs = spark.createDataFrame([("d", "P1", "k1"), ("d", "P2", "k2"), ("d", "P3", "k1")], "dataset string, subconclusion_id string, package_id string")
    combos = spark.createDataFrame([("d", "C1", ["P1", "P2"]), ("d", "C2", ["P1", "P3", "P9"])], "dataset string, combination_id string, subconclusion_ids array<string>")
    pairs = spark.createDataFrame([("d", "X1", "C1", "G1", "G1"), ("d", "X2", "C7", "G2", None)], "dataset string, pair_id string, combination_id string, gap_id string, corresponding_gap_id string")
    assert rules(R.joint_violations(combos, pairs, subs, scopes)) == [("gap_mismatch", "X2"), ("one_package", "C2"), ("orphan_combination", "C2"), ("unknown_combination", "C7"), ("unknown_subconclusion", "C2:P9")]
    refs = spark.createDataFrame([("d", "R1"), ("d", "R2")], "dataset string, reference_id string")
    props = spark.createDataFrame([("d", "R1"), ("d", "R1"), ("d", "R3")], "dataset string, reference_id string")
    assert rules(R.proposition_violations(props, refs)) == [("no_proposition", "R2"), ("several_propositions", "R1"), ("unknown_reference", "R3")]
    R.check_providers(["a", "b", "c", "d"])
    for bad in (["a", "b", "c"], ["a", "a", "b", "c"], ["a", "b", "c", "<model>"]):
        with pytest.raises(ValueError):
            R.check_providers(bad)


def test_edges(spark):
    a = spark.createDataFrame(
        [(1, 1, "F1", "R1", "NONE", "REVIEW", "false"), (1, 2, "F1", "R1", "direct", "PRIMARY_EXPERIMENTAL", "true"), (1, 3, "F2", "R1", "DIRECT", "REVIEW", "true"), (1, 4, "F3", "R1", "DIRECT", "PRIMARY_EXPERIMENTAL", None)],
        "audit_id int, pos_1 int, fact_id string, reference_id string, support_level string, article_type string, has_relevant_experimental_figure string",
    )
    last = R.last_assessments(a)
    assert [(r.fact_id) for r in R.direct_primary(last).collect()] == ["F1"] and [r.fact_id for r in R.direct_reviews(last).collect()] == ["F2"]
