"""Evidence operators: audit rates, mentions, coverage of facts by references, tracing (AG2, AG7-AG12, JN2-JN10, FLT5-FLT7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.ids import id_list, paper_key, ref_key
from quillmark.functions.text import ratio


def audit_rates(refs: DataFrame, paper: str, flags: dict[str, str]) -> DataFrame:
    """Per paper: total, one count n_<flag> and one share <flag>_rate per flag column; 0/0 is 0 (AG2)."""
    counts = [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"n_{name}") for name, c in flags.items()]
    out = refs.groupBy(paper).agg(F.count(F.lit(1)).alias("n_total"), *counts)
    return out.select("*", *[ratio(F.col(f"n_{name}"), F.col("n_total")).alias(f"{name}_rate") for name in flags])


def mentions(refs: DataFrame, row_id: str) -> DataFrame:
    """(row_id, paragraph_index, context): the first context per reference and paragraph (PRJ10, PRJ11)."""
    each = refs.select(row_id, F.posexplode("citation_contexts").alias("pos", "c")).select(row_id, "pos", F.col("c.paragraph_index").alias("paragraph_index"), F.col("c.context").alias("context"))
    return each.groupBy(row_id, "paragraph_index").agg(F.min_by("context", "pos").alias("context"), F.count(F.lit(1)).alias("n_mentions"))


def fact_edges(facts: DataFrame) -> DataFrame:
    """(fact_key, paper, ref, pos): the distinct ids near each fact, in their order."""
    ids = id_list(F.array_join("nearby_reference_ids", ","))
    return facts.select("fact_key", paper_key(F.col("pmcid")).alias("paper"), F.posexplode(ids).alias("pos", "ref"))


def reference_dim(records: DataFrame) -> DataFrame:
    """One row per paper and reference id: its latest usable record's evidence columns."""
    r = records.filter("deleted_at is null").select(
        paper_key(F.col("citing_pmcid")).alias("paper"), ref_key(F.col("reference_id")).alias("ref"), "row_id", "ingested_at",
        (F.coalesce("pmcid", F.lit("")) != "").alias("in_archive"), (F.length(F.coalesce("full_text", F.lit(""))) > 0).alias("has_text"),
        F.coalesce(F.array_contains("article_types", "research-article"), F.lit(False)).alias("is_primary"), F.coalesce(F.array_contains("article_types", "review-article"), F.lit(False)).alias("is_review"),
        (F.coalesce(F.size("figure_captions"), F.lit(0)) > 0).alias("has_figures"), F.coalesce("trace_depth", F.lit(0)).alias("trace_depth"),
    )
    last = F.max(F.struct("ingested_at", "row_id", F.struct(*[c for c in r.columns if c not in ("paper", "ref", "row_id", "ingested_at")]).alias("x"))).alias("m")
    return r.filter("paper is not null and ref is not null").groupBy("paper", "ref").agg(last).select("paper", "ref", F.col("m.row_id").alias("row_id"), "m.x.*")


def eligible(edges: DataFrame) -> DataFrame:
    """Edges whose reference is primary, open and has figures (FLT6)."""
    return edges.filter("in_archive and has_text and is_primary and has_figures")


def fact_coverage(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(fact_key, paper, n_nearby, eligible_ids, covered): a fact is covered if any eligible reference is near it (JN8, AG7)."""
    ok = F.col("in_archive") & F.col("has_text") & F.col("is_primary") & F.col("has_figures")
    per = edges.groupBy("fact_key").agg(F.count(F.lit(1)).alias("n_nearby"), F.array_sort(F.collect_list(F.when(ok, F.struct("pos", "ref")))).alias("e"))
    j = facts.select("fact_key", paper_key(F.col("pmcid")).alias("paper")).join(per, "fact_key", "left")
    ids = F.array_join(F.transform(F.coalesce("e", F.expr("cast(array() as array<struct<pos:int,ref:string>>)")), lambda x: x.ref), ",")
    return j.select("fact_key", "paper", F.coalesce("n_nearby", F.lit(0)).alias("n_nearby"), ids.alias("eligible_ids"), (ids != "").alias("covered"))


def paper_decision(coverage: DataFrame) -> DataFrame:
    """(paper, n_facts, n_covered, all_covered): all facts covered or not (AG8, AG9)."""
    return coverage.groupBy("paper").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if("covered").alias("n_covered"), F.every("covered").alias("all_covered"))


def required_pair_counts(facts: DataFrame, edges: DataFrame, dim: DataFrame) -> DataFrame:
    """(fact_key, n_required): pairs of a fact and a reference of its paper that an assessment needs (JN5): those near the
    fact (all references where none is near) and all traced ones. Counted without writing out the pairs."""
    per_paper = dim.groupBy("paper").agg(F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("trace_depth") > 0).alias("n_traced"))
    near = edges.groupBy("fact_key").agg(F.count(F.lit(1)).alias("n_near"), F.count_if(F.col("trace_depth") > 0).alias("n_near_traced"))
    named = facts.select("fact_key", paper_key(F.col("pmcid")).alias("paper"), F.size(id_list(F.array_join("nearby_reference_ids", ","))).alias("n_ids"))
    j = named.join(near, "fact_key", "left").join(per_paper, "paper", "left").na.fill(0, ["n_refs", "n_traced", "n_near", "n_near_traced"])
    n = F.when(F.col("n_ids") == 0, F.col("n_refs")).otherwise(F.col("n_near") + F.col("n_traced") - F.col("n_near_traced"))
    return j.select("fact_key", n.cast("bigint").alias("n_required"))


def traced_originals(records: DataFrame, most: int = 8) -> DataFrame:
    """(paper, review, original, hop_no): the first references traced through each review (JN7, SL6, FLT7)."""
    r = records.filter("deleted_at is null and trace_depth > 0").select(
        paper_key(F.col("citing_pmcid")).alias("paper"), F.explode(id_list(F.col("source_reference_id"))).alias("review"), ref_key(F.col("reference_id")).alias("original"), "row_id"
    )
    one = r.groupBy("paper", "review", "original").agg(F.min("row_id").alias("first_id"))
    rank = F.row_number().over(Window.partitionBy("paper", "review").orderBy("first_id", "original"))
    return one.withColumn("hop_no", rank).filter(F.col("hop_no") <= most).select("paper", "review", "original", "hop_no")
