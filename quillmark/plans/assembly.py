"""Queries of dataset assembly, registry, leakage seal and external calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions.ids import id_list, paper_key, ref_key
from quillmark.operators import assembly, external, identity, validate
from quillmark.plans.fixtures import ids_sql, latest_papers, paper_sql, LATEST_SQL
from quillmark.plans.curation import _REF_IDENTITY
from quillmark.session import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH c AS (SELECT {paper_sql('citing_pmcid')} AS paper, row_id, unnest(citation_contexts) AS c, generate_subscripts(citation_contexts, 1) AS pos FROM reference_record)
SELECT row_id, pos, 'O' || dense_rank() OVER (PARTITION BY paper ORDER BY row_id) || '_' || row_number() OVER (PARTITION BY paper, row_id ORDER BY pos) AS new_id FROM c""")
def observation_renumber(spark, d):
    """Contexts renumbered over the references of each paper (WN5)."""
    r = read_table(spark, d, "reference_record").select(paper_key(F.col("citing_pmcid")).alias("paper"), "row_id", F.posexplode("citation_contexts").alias("p", "c"))
    out = assembly.renumbered(r.withColumn("pos", (F.col("p") + 1).cast("bigint")), "paper", "row_id", ["pos"], "O")
    return out.select("row_id", "pos", "new_id")


@query(f"""WITH near AS (SELECT fact_key, {paper_sql('pmcid')} AS paper, x.u AS old_id, x.i AS pos FROM (SELECT *, unnest(list_zip({ids_sql("array_to_string(nearby_reference_ids, ',')")}, range(1, 1000))) AS z FROM candidate_fact), LATERAL (SELECT z[1] AS u, z[2] AS i) x WHERE x.u IS NOT NULL),
t AS (SELECT {paper_sql('citing_pmcid')} AS paper, upper(trim(source_reference_id, E' \\t\\n\\r')) AS old_id, upper(trim(reference_id, E' \\t\\n\\r')) AS new_id, min(row_id) AS first_id FROM reference_record WHERE trace_depth > 0 AND deleted_at IS NULL GROUP BY ALL),
j AS (SELECT fact_key, coalesce(t.new_id, n.old_id) AS id, min((n.pos, coalesce(t.first_id, 0))) AS place FROM near n LEFT JOIN t USING (paper, old_id) GROUP BY ALL)
SELECT fact_key, string_agg(id, ',' ORDER BY place) AS ids FROM j GROUP BY fact_key""")
def observation_remap(spark, d):
    """Reviews among a fact's references replaced by the works traced through them (JN19)."""
    f = read_table(spark, d, "candidate_fact").select("fact_key", paper_key(F.col("pmcid")).alias("paper"), id_list(F.array_join("nearby_reference_ids", ",")).alias("ids"))
    t = read_table(spark, d, "reference_record").filter("trace_depth > 0 and deleted_at is null").select(paper_key(F.col("citing_pmcid")).alias("paper"), ref_key(F.col("source_reference_id")).alias("old_id"), ref_key(F.col("reference_id")).alias("new_id"), "row_id")
    t = t.filter("old_id is not null").groupBy("paper", "old_id", "new_id").agg(F.min("row_id").alias("first_id"))
    m = t.groupBy("paper", "old_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_id", "new_id"))), lambda x: x.new_id).alias("new_ids"))
    keyed = f.select("fact_key", "paper", F.explode(F.array_distinct("ids")).alias("old_id")).join(m, ["paper", "old_id"]).select("fact_key", "old_id", "new_ids")
    out = assembly.remapped(f.select("fact_key", "ids"), "fact_key", "ids", keyed)
    return out.select("fact_key", F.array_join("ids", ",").alias("ids"))


@query(f"""WITH w AS (SELECT {_REF_IDENTITY} AS identity, {paper_sql('citing_pmcid')} AS paper FROM reference_record WHERE deleted_at IS NULL)
SELECT identity, count(DISTINCT paper) AS n_papers, count(*) AS n_rows FROM w GROUP BY identity HAVING count(DISTINCT paper) >= 2""")
def cross_paper_support(spark, d):
    """Works that at least two papers cite (VA7)."""
    r = read_table(spark, d, "reference_record").filter("deleted_at is null").select(identity.reference_identity().alias("identity"), paper_key(F.col("citing_pmcid")).alias("paper"))
    return r.groupBy("identity").agg(F.countDistinct("paper").alias("n_papers"), F.count(F.lit(1)).alias("n_rows")).filter("n_papers >= 2")


@query(f"""WITH {LATEST_SQL} SELECT l.paper, CASE WHEN EXISTS (SELECT 1 FROM feasibility_audit a WHERE {paper_sql('a.pmcid')} = l.paper) THEN 'READY' ELSE 'SKIPPED' END AS status FROM latest l""")
def registry_status(spark, d):
    """Every paper with whether it has an audit (FLT14, JN21)."""
    done = read_table(spark, d, "feasibility_audit").select(paper_key(F.col("pmcid")).alias("paper"))
    return assembly.registry(latest_papers(spark, d).select("paper"), done, ["paper"])


@query(f"""WITH {LATEST_SQL} SELECT paper, 'm' || row_number() OVER (ORDER BY row_id) || '_' || regexp_replace(paper, '[^A-Za-z0-9_.-]+', '_', 'g') AS package_id FROM latest""")
def package_manifest(spark, d):
    """Package ids over the papers in order (PRJ15, SNK8)."""
    return assembly.package_ids(latest_papers(spark, d).select("paper", "row_id"), ["row_id"], "paper")


@query(f"""WITH {LATEST_SQL} SELECT paper, title, "year", length(abstract) AS abstract_chars FROM latest""")
def sealed_projection(spark, d):
    """The open columns of papers, after the check that none is sealed (VA10)."""
    p = latest_papers(spark, d).select("paper", "title", "year", F.length("abstract").cast("bigint").alias("abstract_chars"))
    return validate.sealed(p)


@query("""SELECT fact_key, left(sha256(coalesce(statement, '')), 12) AS digest FROM candidate_fact""")
def memo_responses(spark, d):
    """Answers of a deterministic provider through the memo table: a third of the facts are remembered, the rest asked (EX1-EX5, JN15)."""
    f = read_table(spark, d, "candidate_fact").select("fact_key", F.coalesce("statement", F.lit("")).alias("payload"))
    asked = f.withColumn("key", external.memo_key("digest", "v1", "stub", F.col("payload")))
    memo = asked.filter(F.substring("key", 1, 1) < "6").select("key", F.lit("digest").alias("operation"), F.to_json(F.struct(F.left(F.sha2("payload", 256), F.lit(12)).alias("digest"))).alias("response"), F.lit(None).cast("string").alias("error"))
    answers, _ = external.call(asked, memo, external.stub, "digest")
    return answers.select("fact_key", F.get_json_object("response", "$.digest").alias("digest"))
