"""Validators of reasoning records as relations of violations (VA3, VA4, VA6-VA8, VA12) and evidence edges of audits (FLT6,
FLT7, JN6, JN9). Every function returns (scope, rule, detail) rows; a scope without a row is valid."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.ids import trimmed
from quillmark.functions.text import contains_anchor, json_block
from quillmark.operators.skew import skew_join
from quillmark.operators.validate import both_ways, duplicates, violations

#: Statuses of bridges, roles of pairs, sizes of sets.
STATUSES, UNRESOLVED, ROLES, SIZE = ("ESTABLISHED", "PARTIAL", "MISSING"), ("PARTIAL", "MISSING"), ("PRIMARY", "ALTERNATIVE"), (2, 6)


def _blank(c: str | Column) -> Column:
    return F.coalesce(trimmed(F.col(c) if isinstance(c, str) else c), F.lit("")) == ""


def _rows(df: DataFrame, scope: str) -> DataFrame:
    return df.select(scope, "rule", F.col("detail").cast("string").alias("detail"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def size_outside(df: DataFrame, scopes: DataFrame, scope: str, rule: str, least: int = SIZE[0], most: int = SIZE[1]) -> DataFrame:
    """Scopes with fewer or more rows than allowed, those without any included."""
    n = df.groupBy(scope).agg(F.count(F.lit(1)).alias("_n"))
    j = scopes.select(scope).distinct().join(n, scope, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return j.filter(~F.col("_n").between(least, most)).select(scope, F.lit(rule).alias("rule"), F.col("_n").cast("string").alias("detail"))


def not_among(df: DataFrame, scope: str, ids: str, known: DataFrame, key: str, owner: str, rule: str) -> DataFrame:
    """Ids of a list column that known does not have in the same scope; detail is owner:id."""
    each = df.select(scope, owner, F.explode(F.array_distinct(ids)).alias(key))
    bad = skew_join(each, known.select(scope, key).distinct(), [scope, key], "left_anti", owner)
    return bad.select(scope, F.lit(rule).alias("rule"), F.concat_ws(":", F.col(owner).cast("string"), key).alias("detail"))


def fact_rules(facts: DataFrame, introductions: DataFrame, known: DataFrame) -> DataFrame:
    """(scope, rule, detail): facts (scope is fact and its key) whose anchor is blank or does not stand in the introduction, without nearby ids,
    with unknown ones or with other than one claim; papers (scope is paper and its key) with other than two to six facts (VA2).

    facts: (fact_key, paper, anchor_text, ids, atomic_claim_count); introductions: (paper, introduction), one row per paper;
    known: (paper, ref).
    """
    with_text = skew_join(facts.select("fact_key", "paper", "anchor_text"), introductions, ["paper"], "left", "fact_key")
    anchored = F.coalesce(contains_anchor(F.col("introduction"), F.col("anchor_text")), F.lit(False))
    own = violations(facts, ["fact_key"], [("claims", F.coalesce("atomic_claim_count", F.lit(0)) != 1, F.col("atomic_claim_count")), ("no_reference", F.size("ids") == 0, F.lit(""))])
    bare = violations(with_text, ["fact_key"], [("anchor", ~anchored, F.col("anchor_text"))])
    edges = facts.select("fact_key", "paper", F.explode("ids").alias("ref"))
    missing = skew_join(edges, known, ["paper", "ref"], "left_anti", "fact_key").select("fact_key", F.lit("unknown_reference").alias("rule"), F.col("ref").alias("detail"))
    per_fact = _all(own, bare, missing).select(F.concat(F.lit("fact "), F.col("fact_key").cast("string")).alias("scope"), "rule", "detail")
    counts = size_outside(facts, facts, "paper", "fact_count").select(F.concat(F.lit("paper "), "paper").alias("scope"), "rule", "detail")
    return per_fact.unionByName(counts)


def included_figures(decisions: DataFrame) -> DataFrame:
    """Decisions to include a figure that hold: experimental data, real and relevant."""
    return decisions.filter("decision = 'INCLUDE' and classification = 'EXPERIMENTAL_DATA' and real_data is true and relevant is true")


def figure_rules(figures: DataFrame, decisions: DataFrame, scope: str, uid: str = "figure_uid") -> DataFrame:
    """(scope, rule, detail): figures without a decision, decisions without a figure, repeated ones and unsafe inclusions (VA5)."""
    sides = both_ways(figures, decisions, [scope, uid]).select(scope, F.when(F.col("side") == "missing", "figure_extra").otherwise("figure_missing").alias("rule"), F.col(uid).alias("detail"))
    fit = (F.col("classification") == "EXPERIMENTAL_DATA") & F.col("real_data") & F.col("relevant")
    unsafe = violations(decisions, [scope], [("unsafe_inclusion", (F.col("decision") == "INCLUDE") & ~F.coalesce(fit, F.lit(False)), F.col(uid))])
    return _all(sides, _rows(duplicates(decisions, [scope], F.col(uid), "figure_repeated"), scope), _rows(unsafe, scope))


#: The parts of a review and its outcomes.
DIMENSIONS = ("research_question", "original_experimental_research", "novel_biological_finding", "experimental_evidence")


def _decoded_review(raw: str) -> tuple[Column, Column]:
    """The review of a model's answer as a variant, and its outcome by the results of its parts."""
    v = F.try_parse_json(json_block(F.col(raw)))
    results = [F.try_variant_get(v, f"$.{d}.result", "string") for d in DIMENSIONS]
    return v, F.when(reduce(lambda a, b: a & b, [F.coalesce(x == "PASS", F.lit(False)) for x in results]), "INCLUDE").otherwise("EXCLUDE")


def review_rules(reviews: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, rule, detail): answers that hold no object, parts that are missing or no object, results other than PASS and FAIL,
    reasons that are no text or blank, and outcomes that do not follow from the results (only where the parts are sound) (VA1, SC22)."""
    v, expected = _decoded_review(raw)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    rules: list[tuple[str, Column, Column]] = []
    for d in DIMENSIONS:
        result, reason = (F.try_variant_get(v, f"$.{d}.{x}", "string") for x in ("result", "reason"))
        is_object = kind(f"$.{d}").startswith("OBJECT")
        rules += [
            ("part_missing", ~is_object, F.lit(d)), ("result", is_object & ~F.coalesce(result.isin("PASS", "FAIL"), F.lit(False)), F.lit(d)),
            ("reason", is_object & ((kind(f"$.{d}.reason") != "STRING") | _blank(reason)), F.lit(d)),
        ]
    known = reviews.withColumn("_object", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    broken = known.filter(~F.col("_object")).select(key, F.lit("no_object").alias("rule"), F.lit("").alias("detail"))
    parts = _rows(violations(known.filter("_object"), [key], rules), key)
    final = F.try_variant_get(v, "$.final_decision", "string")
    wrong = reduce(lambda a, b: a | b, [c for _, c, _ in rules])
    outcome = violations(known.filter(F.col("_object") & ~wrong), [key], [("final_decision", ~final.eqNullSafe(expected), final)])
    return _all(broken, parts, _rows(outcome, key))


def review_outcomes(reviews: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, <part>_result, <part>_reason, final_decision) of the reviews that break no rule, reasons trimmed (PRJ13)."""
    v, expected = _decoded_review(raw)
    bad = review_rules(reviews, key, raw).select(key).distinct()
    fields = [c for d in DIMENSIONS for c in (F.try_variant_get(v, f"$.{d}.result", "string").alias(f"{d}_result"), trimmed(F.try_variant_get(v, f"$.{d}.reason", "string")).alias(f"{d}_reason"))]
    return reviews.join(bad, key, "left_anti").select(key, *fields, expected.alias("final_decision"))


def subset_violations(assessed: DataFrame, expected: DataFrame, scope: str = "paper") -> DataFrame:
    """Subset assessments against the enumerated subsets: ids equal as sets and unique, the same ordered facts, sufficient
    exactly if all three conditions are true (NULL is not true) (VA3, JN11)."""
    ids = both_ways(expected, assessed, [scope, "subset_id"]).select(scope, F.concat(F.lit("subset_"), F.when(F.col("side") == "missing", "extra").otherwise("missing")).alias("rule"), F.col("subset_id").alias("detail"))
    j = assessed.join(expected.select(scope, "subset_id", F.col("fact_ids").alias("_want")), [scope, "subset_id"])
    holds = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(False)) for c in ("gap_still_defined", "hypothesis_answers_gap", "hypothesis_compatible_with_facts")])
    own = violations(j, [scope], [("subset_facts", ~F.col("fact_ids").eqNullSafe(F.col("_want")), F.col("subset_id")), ("subset_sufficient", F.coalesce("sufficient", F.lit(False)) != holds, F.col("subset_id"))])
    return _all(ids, _rows(own, scope), _rows(duplicates(assessed, [scope], F.col("subset_id"), "subset_repeated"), scope))


def bridge_violations(bridges: DataFrame, facts: DataFrame, references: DataFrame, scopes: DataFrame, scope: str = "paper") -> DataFrame:
    """Bridges: at least one, unique filled ids, two and more selected facts, a known status, known references, references
    exactly where the status is not MISSING (VA4)."""
    refs = F.size(F.coalesce("supporting_reference_ids", F.array().cast("array<string>")))
    own = violations(bridges, [scope], [
        ("bridge_id", _blank("bridge_id"), F.lit("")),
        ("bridge_facts", F.size(F.array_distinct(F.coalesce("source_fact_ids", F.array().cast("array<string>")))) < 2, F.col("bridge_id")),
        ("bridge_status", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.col("bridge_id")),
        ("bridge_missing_with_references", (F.col("status") == "MISSING") & (refs > 0), F.col("bridge_id")),
        ("bridge_without_references", F.col("status").isin("ESTABLISHED", "PARTIAL") & (refs == 0), F.col("bridge_id")),
    ])
    return _all(
        _rows(own, scope), _rows(duplicates(bridges, [scope], F.col("bridge_id"), "bridge_repeated"), scope), size_outside(bridges, scopes, scope, "bridge_count", 1, 10**9),
        not_among(bridges, scope, "source_fact_ids", facts, "fact_id", "bridge_id", "bridge_unknown_fact"), not_among(bridges, scope, "supporting_reference_ids", references, "reference_id", "bridge_id", "bridge_unknown_reference"),
    )


def pair_violations(pairs: DataFrame, bridges: DataFrame, scopes: DataFrame, scope: str = "paper") -> DataFrame:
    """Gap-hypothesis pairs: two to six, unique ids and texts, filled fields, one PRIMARY, known bridges of which one is unresolved (VA4, SC18)."""
    texts = ("knowledge_gap", "hypothesis", "independent_variable", "dependent_variable", "falsification_condition")
    own = violations(pairs, [scope], [*[(f"pair_{c}", _blank(c), F.col("pair_id")) for c in texts], ("pair_role", ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), F.col("pair_id"))])
    flat = lambda c: F.lower(F.btrim(F.regexp_replace(c, r"\s+", " ")))
    repeated = [_rows(duplicates(pairs, [scope], x, rule), scope) for rule, x in (("gap_id_repeated", F.col("gap_id")), ("hypothesis_id_repeated", F.col("hypothesis_id")), ("gap_repeated", flat("knowledge_gap")), ("hypothesis_repeated", flat("hypothesis")))]
    each = pairs.select(scope, "pair_id", F.explode("source_bridge_ids").alias("bridge_id")).join(bridges.select(scope, "bridge_id", "status"), [scope, "bridge_id"])
    open_ = each.filter(F.col("status").isin(*UNRESOLVED)).select(scope, "pair_id").distinct()
    settled = pairs.select(scope, "pair_id").join(open_, [scope, "pair_id"], "left_anti").select(scope, F.lit("pair_without_open_bridge").alias("rule"), F.col("pair_id").alias("detail"))
    primary = size_outside(pairs.filter(F.col("role") == "PRIMARY"), scopes, scope, "primary_count", 1, 1)
    return _all(_rows(own, scope), *repeated, settled, primary, size_outside(pairs, scopes, scope, "pair_count"), not_among(pairs, scope, "source_bridge_ids", bridges, "bridge_id", "pair_id", "pair_unknown_bridge"))


def analysis_violations(analyses: DataFrame, observations: DataFrame, subconclusions: DataFrame, evidence_mode: str, scope: str = "package_id", packages: DataFrame | None = None, figures: DataFrame | None = None, provenance: str | None = None) -> DataFrame:
    """Reference analyses: the fixed evidence mode and provenance, two to six subconclusions, each supported by known
    observations; with packages given, analyses of these and no others; with figures given, only figures that were included
    (analyses and observations then have figure_ids and provenance) (VA6)."""
    rules = [("evidence_mode", ~F.col("evidence_mode").eqNullSafe(F.lit(evidence_mode)), F.col("evidence_mode"))]
    own = _rows(violations(analyses, [scope], rules), scope)
    if provenance is not None:
        own = own.unionByName(_rows(violations(observations, [scope], [("provenance", ~F.col("provenance").eqNullSafe(F.lit(provenance)), F.col("observation_id"))]), scope))
    if packages is not None:
        sides = both_ways(packages, analyses, [scope])
        own = own.unionByName(sides.select(scope, F.when(F.col("side") == "missing", "unknown_package").otherwise("no_analysis").alias("rule"), F.lit("").alias("detail")))
    if figures is not None:
        own = own.unionByName(not_among(observations, scope, "figure_ids", figures, "figure_id", "observation_id", "figure_not_included"))
    bare = violations(subconclusions, [scope], [("unsupported", F.size(F.coalesce("supporting_observation_ids", F.array().cast("array<string>"))) == 0, F.col("subconclusion_id"))])
    return _all(own, _rows(bare, scope), size_outside(subconclusions, analyses, scope, "subconclusion_count"), not_among(subconclusions, scope, "supporting_observation_ids", observations, "observation_id", "subconclusion_id", "unknown_observation"))


def joint_violations(combinations: DataFrame, pairs: DataFrame, subconclusions: DataFrame, scopes: DataFrame, scope: str = "dataset") -> DataFrame:
    """Joint results: combinations of known subconclusions whose owners are two packages at least, pairs that point to a
    combination and to their own gap, no combination without a pair, ids that are not repeated, texts that are not blank (VA7).
    subconclusions: (scope, subconclusion_id, package_id)."""
    each = combinations.select(scope, "combination_id", F.explode("subconclusion_ids").alias("subconclusion_id")).join(subconclusions, [scope, "subconclusion_id"])
    owners = each.groupBy(scope, "combination_id").agg(F.countDistinct("package_id").alias("_n"))
    few = combinations.select(scope, "combination_id").join(owners, [scope, "combination_id"], "left").filter(F.coalesce("_n", F.lit(0)) < 2)
    texts = [c for c in ("knowledge_gap", "hypothesis") if c in pairs.columns]
    own = violations(pairs, [scope], [("gap_mismatch", ~F.col("corresponding_gap_id").eqNullSafe(F.col("gap_id")), F.col("pair_id")), *[(f"blank_{c}", _blank(c), F.col("pair_id")) for c in texts]])
    repeated = [_rows(duplicates(df, [scope], F.col(c), f"{c}_repeated"), scope) for df, c in ((combinations, "combination_id"), (pairs, "pair_id"), (pairs, "gap_id"))]
    sides = both_ways(combinations, pairs, [scope, "combination_id"])
    return _all(
        few.select(scope, F.lit("one_package").alias("rule"), F.col("combination_id").alias("detail")), _rows(own, scope), *repeated, size_outside(pairs, scopes, scope, "pair_count"),
        not_among(combinations, scope, "subconclusion_ids", subconclusions, "subconclusion_id", "combination_id", "unknown_subconclusion"),
        sides.select(scope, F.when(F.col("side") == "missing", "unknown_combination").otherwise("orphan_combination").alias("rule"), F.col("combination_id").alias("detail")),
    )


def proposition_violations(propositions: DataFrame, references: DataFrame, scope: str = "dataset", hypotheses: DataFrame | None = None) -> DataFrame:
    """Exactly one proposition per reference; with hypotheses given (scope, hypothesis_id, path), two to six of them, each with
    a path of all propositions (VA8)."""
    more = []
    if hypotheses is not None:
        want = propositions.groupBy(scope).agg(F.array_sort(F.collect_set("proposition_id")).alias("_all"))
        j = hypotheses.join(want, scope, "left").filter(~F.array_sort(F.array_distinct("path")).eqNullSafe(F.col("_all")))
        more = [size_outside(hypotheses, references, scope, "hypothesis_count"), j.select(scope, F.lit("path").alias("rule"), F.col("hypothesis_id").alias("detail"))]
    return _all(
        *more,
        both_ways(references, propositions, [scope, "reference_id"]).select(scope, F.when(F.col("side") == "missing", "unknown_reference").otherwise("no_proposition").alias("rule"), F.col("reference_id").alias("detail")),
        _rows(duplicates(propositions, [scope], F.col("reference_id"), "several_propositions"), scope),
    )


def document_rules(documents: DataFrame, key: str, raw: str, required: Sequence[str] = (), constants: dict[str, str] | None = None, sizes: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(key, rule, detail): documents that are no object, lack required paths, differ from constants, or whose lists have fewer
    or more entries than allowed (VA9). Paths are given without the root, as a.b."""
    v = F.try_parse_json(raw)
    kind = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{p}", "variant")), F.lit("VOID"))
    rules: list[tuple[str, Column, Column]] = [("required", kind(p) == "VOID", F.lit(p)) for p in required]
    rules += [("constant", ~F.try_variant_get(v, f"$.{p}", "string").eqNullSafe(F.lit(c)), F.lit(p)) for p, c in (constants or {}).items()]
    for p, (least, most) in (sizes or {}).items():
        n = F.coalesce(F.size(F.try_variant_get(v, f"$.{p}", "array<variant>")), F.lit(-1))
        rules.append(("size", ~n.between(least, most), F.lit(p)))
    known = documents.withColumn("_object", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    broken = known.filter(~F.col("_object")).select(key, F.lit("no_object").alias("rule"), F.lit("").alias("detail"))
    return _all(broken, _rows(violations(known.filter("_object"), [key], rules), key))


def check_providers(models: Sequence[str], count: int = 4) -> None:
    """Configuration check of model providers: so many, distinct, none a placeholder (VA12)."""
    if len(models) != count or len(set(models)) != count or any(not m or m.startswith("<") or "placeholder" in m.lower() for m in models):
        raise ValueError(f"{count} distinct models are needed, got {list(models)}")


def last_assessments(assessments: DataFrame, key: Sequence[str] = ("audit_id", "fact_id", "reference_id"), order: str = "pos_1") -> DataFrame:
    """The last assessment of every fact and reference (JN9)."""
    rest = [c for c in assessments.columns if c not in key]
    return assessments.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(*key, "_x.*")


def direct_primary(assessments: DataFrame) -> DataFrame:
    """Edges that count: direct support by a primary experimental article with a relevant figure (FLT6)."""
    return assessments.filter((F.upper("support_level") == "DIRECT") & (F.upper("article_type") == "PRIMARY_EXPERIMENTAL") & (F.col("has_relevant_experimental_figure") == "true"))


def direct_reviews(assessments: DataFrame) -> DataFrame:
    """Reviews with direct support, which are traced to their originals (FLT7)."""
    return assessments.filter((F.upper("support_level") == "DIRECT") & (F.upper("article_type") == "REVIEW"))
