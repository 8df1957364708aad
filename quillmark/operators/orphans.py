"""References to records that do not exist.

``find_orphans`` is the general operator: references with a composite key of which parts may be NULL are grouped by
their null mask, and each mask is anti-joined on its non-null columns under the declared match semantics.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.ids import id_list, paper_key, ref_key
from quillmark.operators.skew import skew_join
from quillmark.session import read_table

MATCHES = ("simple", "partial", "full")


def find_orphans(refs: DataFrame, targets: DataFrame, keys: list[str], row_id: str, match: str = "full", nullable: list[str] | None = None, ref_time: str | None = None, target_time: str | None = None) -> DataFrame:
    """The rows of refs that no row of targets answers.

    keys: the columns of the composite key, of the same names on both sides. nullable: those that may be NULL in refs
    (default: all). match, as in SQL's MATCH clause: ``simple`` - a key with any NULL refers to nothing and is no orphan;
    ``partial`` - the non-null columns must match; ``full`` - a key with some but not all columns NULL is an orphan.
    A key of NULLs only is no reference under any semantics. ref_time, target_time: if given, a target answers only
    if its time is not after that of the reference; a NULL time answers and is answered by nothing.

    Targets are pre-aggregated to one row per key (with their earliest time), so repeated target rows cost nothing; hot
    keys of the references are salted. Empty refs give no rows; with empty targets every reference is an orphan. Repeated
    rows of refs come out as often as they came in. Other columns of refs are kept, whatever their names on the target side.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    nullable = [k for k in keys if k in (keys if nullable is None else nullable)]
    parts = []
    for mask in product([False, True], repeat=len(nullable)):
        null = {k for k, m in zip(nullable, mask) if m}
        on = [k for k in keys if k not in null]
        if not on or (null and match == "simple"):
            continue
        some = refs.filter(reduce(lambda a, b: a & b, [F.col(k).isNull() if k in null else F.col(k).isNotNull() for k in keys]))
        if null and match == "full":
            parts.append(some)
            continue
        usable = targets.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on]))
        if target_time:
            usable = usable.filter(F.col(target_time).isNotNull()).groupBy(*on).agg(F.min(target_time).alias("_since"))
            parts.append(skew_join(some, usable, on, "left_anti", row_id, F.col("_since") <= F.col(ref_time)))
        else:
            parts.append(skew_join(some, usable.select(*on).distinct(), on, "left_anti", row_id))
    return reduce(DataFrame.unionByName, parts)


def reference_rows(facts: DataFrame, records: DataFrame) -> DataFrame:
    """One row per source row, field and distinct id referred to: src_table, src_field, src_id, paper, target_id, at.

    Blank and NULL ids are no reference; a text with several ids, parted by blanks or commas, gives several rows.
    """
    def rows(df: DataFrame, table: str, field: str, key: str, paper: str, time: str, ids: Column) -> DataFrame:
        return df.select(
            F.lit(table).alias("src_table"), F.lit(field).alias("src_field"), F.col(key).cast("bigint").alias("src_id"),
            paper_key(F.col(paper)).alias("paper"), F.explode(ids).alias("target_id"), F.col(time).alias("at"),
        )

    nearby = id_list(F.array_join(F.col("nearby_reference_ids"), ","))
    review = F.when(F.col("reference_id").contains("::"), F.split(F.col("reference_id"), "::")[0])
    return (
        rows(facts, "candidate_fact", "nearby_reference_ids", "fact_key", "pmcid", "extracted_at", nearby)
        .unionByName(rows(records, "reference_record", "source_reference_id", "row_id", "citing_pmcid", "ingested_at", id_list(F.col("source_reference_id"))))
        .unionByName(rows(records, "reference_record", "reference_id", "row_id", "citing_pmcid", "ingested_at", id_list(review)))
    )


def usable_records(records: DataFrame) -> DataFrame:
    return records.filter(F.col("deleted_at").isNull()).select(
        paper_key(F.col("citing_pmcid")).alias("paper"), ref_key(F.col("reference_id")).alias("target_id"), F.col("ingested_at").alias("_ingested")
    )


def orphan_references(facts: DataFrame, records: DataFrame) -> DataFrame:
    """Every reference of facts and records that names no usable record of the same paper, with its month."""
    refs = reference_rows(facts, records)
    found = find_orphans(refs, usable_records(records), ["paper", "target_id"], "src_id", "full", ["paper"], "at", "_ingested")
    return found.withColumn("month", F.date_format("at", "yyyy-MM"))


def orphan_report(facts: DataFrame, records: DataFrame) -> DataFrame:
    """References and orphans per table, field and month of the source row."""
    by = ["src_table", "src_field", "month"]
    refs = reference_rows(facts, records).withColumn("month", F.date_format("at", "yyyy-MM")).groupBy(*by).agg(F.count(F.lit(1)).alias("n_references"))
    orphans = orphan_references(facts, records).groupBy(*by).agg(F.count(F.lit(1)).alias("n_orphans"))
    r, o = refs.alias("r"), orphans.alias("o")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by])
    return r.join(o, same, "left").select(*[F.col(f"r.{c}").alias(c) for c in by], "n_references", F.coalesce("n_orphans", F.lit(0)).cast("bigint").alias("n_orphans"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphan_references(read_table(spark, d, "candidate_fact"), read_table(spark, d, "reference_record"))
    return found.select("src_table", "src_field", "src_id", "target_id")


def p2_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(read_table(spark, d, "candidate_fact"), read_table(spark, d, "reference_record"))


_REFS_SQL = r"""
refs AS (
  SELECT DISTINCT 'candidate_fact' AS src_table, 'nearby_reference_ids' AS src_field, fact_key AS src_id,
         regexp_replace(upper(trim(pmcid, E' \t\n\r')), '^PMC', '') AS paper, extracted_at AS ref_at,
         unnest(regexp_split_to_array(upper(array_to_string(nearby_reference_ids, ',')), '[\s,]+')) AS target_id
  FROM candidate_fact
  UNION ALL
  SELECT DISTINCT 'reference_record', 'source_reference_id', row_id, regexp_replace(upper(trim(citing_pmcid, E' \t\n\r')), '^PMC', ''), ingested_at,
         unnest(regexp_split_to_array(upper(source_reference_id), '[\s,]+'))
  FROM reference_record
  UNION ALL
  SELECT DISTINCT 'reference_record', 'reference_id', row_id, regexp_replace(upper(trim(citing_pmcid, E' \t\n\r')), '^PMC', ''), ingested_at,
         unnest(regexp_split_to_array(upper(split_part(reference_id, '::', 1)), '[\s,]+'))
  FROM reference_record WHERE contains(reference_id, '::')
),
usable AS (
  SELECT regexp_replace(upper(trim(citing_pmcid, E' \t\n\r')), '^PMC', '') AS paper, upper(trim(reference_id, E' \t\n\r')) AS target_id, min(ingested_at) AS since
  FROM reference_record WHERE deleted_at IS NULL GROUP BY ALL
),
orphans AS (
  SELECT r.* FROM refs r WHERE r.target_id <> '' AND NOT EXISTS (SELECT 1 FROM usable u WHERE u.paper = r.paper AND u.target_id = r.target_id AND u.since <= r.ref_at)
)
"""

QUERIES = {"p2_found": p2_found, "p2_orphans_by_month": p2_orphans_by_month}
SQL = {
    "p2_found": f"WITH {_REFS_SQL} SELECT src_table, src_field, src_id, target_id FROM orphans",
    "p2_orphans_by_month": f"""WITH {_REFS_SQL}
SELECT a.src_table, a.src_field, a.month, a.n_references, coalesce(b.n_orphans, 0) AS n_orphans
FROM (SELECT src_table, src_field, strftime(ref_at, '%Y-%m') AS month, count(*) AS n_references FROM refs WHERE target_id <> '' GROUP BY ALL) a
LEFT JOIN (SELECT src_table, src_field, strftime(ref_at, '%Y-%m') AS month, count(*) AS n_orphans FROM orphans GROUP BY ALL) b
  ON a.src_table = b.src_table AND a.src_field = b.src_field AND a.month IS NOT DISTINCT FROM b.month""",
}
