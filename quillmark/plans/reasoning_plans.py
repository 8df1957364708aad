"""Queries of composed stages: reviews, collection, resolution, payloads, final rows, ground truth, datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.functions.ids import id_list, paper_key, ref_key
from quillmark.operators import evidence, external, minset, ordinal, pipeline, reasoning
from quillmark.plans import evidence_plans as ev
from quillmark.plans.curation import _DOI
from quillmark.plans.fixtures import LATEST_SQL, ids_sql, latest_papers, paper_sql
from quillmark.session import materialize, read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PARTS = ["research_question", "original_experimental_research", "novel_biological_finding", "experimental_evidence"]
_REVIEWS = f"""WITH {LATEST_SQL},
r AS (SELECT paper, row_id % 11 AS k, coalesce(length(trim(title)), 0) > 0 AS p1, coalesce(list_contains(article_types, 'research-article'), false) AS p2, coalesce(length(abstract), 0) >= 80 AS p3, coalesce(length(full_text), 0) >= 500 AS p4, open_access IS TRUE AS final FROM latest),
parts AS (SELECT paper, k, final, p1 AND p2 AND p3 AND p4 AS expected, unnest({_PARTS}) AS part, unnest([p1, p2, p3, p4]) AS pass FROM r),
v AS (
  SELECT paper, 'no_object' AS rule, '' AS detail FROM r WHERE k = 0
  UNION ALL SELECT paper, 'part_missing', part FROM parts WHERE k = 1 AND part = 'novel_biological_finding' OR k = 2 AND part = 'research_question'
  UNION ALL SELECT paper, 'result', part FROM parts WHERE k = 3 AND part = 'experimental_evidence'
  UNION ALL SELECT paper, 'reason', part FROM parts WHERE k = 4 AND part = 'original_experimental_research' OR k = 5 AND part = 'experimental_evidence'),
w AS (SELECT * FROM v UNION ALL SELECT paper, 'final_decision', CASE WHEN final THEN 'INCLUDE' ELSE 'EXCLUDE' END FROM (SELECT DISTINCT paper, final, expected FROM parts) WHERE final <> expected AND paper NOT IN (SELECT paper FROM v))
"""


def _reviews(spark, d):
    """Answers as a model might give them: a review of each paper in a fence and with prose around, some of them broken."""
    k = F.col("row_id") % 11
    passes = [F.coalesce(F.length(F.btrim("title")), F.lit(0)) > 0, F.coalesce(F.array_contains("article_types", "research-article"), F.lit(False)), F.coalesce(F.length("abstract"), F.lit(0)) >= 80, F.coalesce(F.length("full_text"), F.lit(0)) >= 500]
    results = [F.when(p, "PASS").otherwise("FAIL") for p in passes]
    results[3] = F.when(k == 3, "UNSURE").otherwise(results[3])
    reasons = [F.lit('"As told."'), F.when(k == 4, '" \\n"').otherwise('" By the type. "'), F.lit('"Long enough."'), F.when(k == 5, "7").otherwise('"Read."')]
    parts = [F.concat(F.lit(f'"{n}": {{"result": "'), r, F.lit('", "reason": '), why, F.lit("}")) for n, r, why in zip(_PARTS, results, reasons)]
    parts[0] = F.when(k == 2, '"research_question": "PASS"').otherwise(parts[0])
    kept = F.array_compact(F.array(parts[0], parts[1], F.when(k != 1, parts[2]), parts[3]))
    final = F.when(F.coalesce("open_access", F.lit(False)), "INCLUDE").otherwise("EXCLUDE")
    body = F.concat(F.lit("Here it is:\n```json\n{"), F.array_join(kept, ", "), F.lit(', "final_decision": "'), final, F.lit('"}\n```'))
    return latest_papers(spark, d).select("paper", F.when(k == 0, "I cannot say.").otherwise(body).alias("answer"))


@query(_REVIEWS + "SELECT * FROM w")
def review_violations(spark, d):
    """Reviews of four parts against their rules (VA1, SC22)."""
    return reasoning.review_rules(_reviews(spark, d), "paper", "answer")


@query(_REVIEWS + f"""SELECT r.paper, {', '.join(f"CASE WHEN p{i} THEN 'PASS' ELSE 'FAIL' END AS {n}_result, '{t}' AS {n}_reason" for i, (n, t) in enumerate(zip(_PARTS, ('As told.', 'By the type.', 'Long enough.', 'Read.')), 1))}, CASE WHEN p1 AND p2 AND p3 AND p4 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS final_decision
FROM r WHERE paper NOT IN (SELECT paper FROM w)""")
def review_outcomes(spark, d):
    """The sound reviews as flat rows (VA1, PRJ13)."""
    return reasoning.review_outcomes(_reviews(spark, d), "paper", "answer")


@query(ev._EVIDENCE + """SELECT paper, CAST(fact_key AS VARCHAR) AS fact_class, ref FROM edges UNION SELECT paper, 'any', ref FROM dim WHERE trace_depth > 0
UNION SELECT paper, 'unnamed', ref FROM dim SEMI JOIN (SELECT DISTINCT paper FROM facts WHERE len(ids) = 0) USING (paper)""")
def required_pair_classes(spark, d):
    """Which references the facts of every class must be assessed against (JN5)."""
    return pipeline.required_pair_classes(_facts_with_counts(spark, d), ev._edges(spark, d), evidence.reference_dim(ev._records(spark, d)))


def _facts_with_counts(spark, d):
    return ev._facts(spark, d).select("fact_key", paper_key(F.col("pmcid")).alias("paper"), F.size(id_list(F.array_join("nearby_reference_ids", ","))).alias("n_ids"))


@query(ev._EVIDENCE + """, few AS (SELECT paper FROM facts GROUP BY paper HAVING count(*) <= 6), p AS (SELECT f.fact_key, d.ref, f.ids, d.trace_depth FROM facts f JOIN dim d USING (paper) SEMI JOIN few USING (paper))
SELECT fact_key, ref FROM p WHERE len(ids) = 0 OR list_contains(ids, ref) OR trace_depth > 0""")
def required_pairs(spark, d):
    """The pairs written out, for the papers that may have an assessment at all: those with at most six facts (JN5, VA2)."""
    facts = materialize(_facts_with_counts(spark, d), "facts")
    classes = pipeline.required_pair_classes(facts, ev._edges(spark, d), evidence.reference_dim(ev._records(spark, d)))
    few = minset.fact_counts(facts).filter("status <> 'TOO_MANY_FACTS'")
    return pipeline.pairs_of(few, facts, classes)


@query("""SELECT row_id, sha256(left(coalesce(abstract, ''), 12000)) AS abstract_digest, sha256(left(coalesce(full_text, ''), 30000)) AS text_digest, coalesce(len(figure_captions), 0) AS n_figures, coalesce(full_text, '') <> '' AS full_text_available FROM reference_record""")
def evidence_payload(spark, d):
    """What a model is given of every reference, as digests (PRJ14, SC6)."""
    p = pipeline.evidence_payload(ev._records(spark, d))
    return p.select("row_id", F.sha2("abstract", 256).alias("abstract_digest"), F.sha2("full_text", 256).alias("text_digest"), F.col("n_figures").cast("bigint").alias("n_figures"), "full_text_available")


@query("""SELECT row_id FROM paper WHERE trim(coalesce(full_text, '')) = '' AND trim(coalesce(methods, '')) = '' AND trim(coalesce(results, '')) = '' AND trim(coalesce(discussion, '')) = '' AND trim(coalesce(introduction, '')) = ''""")
def papers_without_text(spark, d):
    """Deliveries that a screening must not start with (FLT9)."""
    return pipeline.without_text(read_table(spark, d, "paper"), "row_id", "full_text", ["introduction", "methods", "results", "discussion"])


@query("SELECT row_id, len(citation_contexts) AS n_contexts FROM reference_record WHERE len(citation_contexts) > 0")
def citing_references(spark, d):
    """References that the introduction cites (FLT12)."""
    return ev._records(spark, d).filter(F.size("citation_contexts") > 0).select("row_id", F.size("citation_contexts").cast("bigint").alias("n_contexts"))


_OWN = "nullif(trim({c}), '')"
_MEMO = f"""WITH papers AS (SELECT {_DOI.format(c='doi')} AS d, nullif(trim(pmid), '') AS m, 'PMC' || {paper_sql('pmcid')} AS c, row_id FROM paper WHERE pmcid IS NOT NULL),
by_doi AS (SELECT d, arg_min(m, row_id) AS m, min(c) AS c FROM papers WHERE d IS NOT NULL GROUP BY d), by_pmid AS (SELECT m, min(c) AS c FROM papers WHERE m IS NOT NULL GROUP BY m),
j AS (SELECT r.row_id, nullif(trim(r.pmcid), '') AS own, coalesce(nullif(trim(r.pmid), ''), b.m) AS pmid, b.c AS c FROM (SELECT *, {_DOI.format(c='doi')} AS d FROM reference_record) r LEFT JOIN by_doi b ON b.d = r.d)
"""


def _memo(spark, d):
    """The papers as a memo of resolved identifiers."""
    p = read_table(spark, d, "paper").filter("pmcid is not null").select(tx.doi_norm(F.col("doi")).alias("d"), F.nullif(F.btrim("pmid"), F.lit("")).alias("m"), F.concat(F.lit("PMC"), paper_key(F.col("pmcid"))).alias("c"), "row_id")
    by_doi = p.filter("d is not null").groupBy(F.col("d").alias("id")).agg(F.min_by("m", F.when(F.col("m").isNotNull(), F.col("row_id"))).alias("pmid"), F.min("c").alias("pmcid"))
    by_pmid = p.filter("m is not null").groupBy(F.col("m").alias("id")).agg(F.min("c").alias("pmcid"))
    return by_doi.select(F.lit("doi").alias("kind"), "id", "pmid", "pmcid").unionByName(by_pmid.select(F.lit("pmid").alias("kind"), "id", F.col("id").alias("pmid"), "pmcid"))


@query(_MEMO + """SELECT j.row_id, coalesce(j.pmid, '') AS pmid, coalesce(j.own, j.c, m.c, '') AS pmcid, CASE WHEN j.own IS NOT NULL THEN 'own' WHEN j.c IS NOT NULL THEN 'doi' WHEN m.c IS NOT NULL THEN 'pmid' ELSE 'none' END AS found_by
FROM j LEFT JOIN by_pmid m ON m.m = j.pmid""")
def resolved_ids(spark, d):
    """Identifiers of references resolved over the memo: DOI, then PMID (EX7)."""
    return pipeline.resolved_ids(ev._records(spark, d), "row_id", _memo(spark, d))


@query(f"""WITH o AS (SELECT {_DOI.format(c='doi')} AS d, bool_or(coalesce(open_access, false)) AS is_open FROM paper GROUP BY 1)
SELECT r.row_id, coalesce(o.is_open, false) AS is_open FROM (SELECT row_id, {_DOI.format(c='doi')} AS d FROM reference_record) r LEFT JOIN o ON o.d = r.d""")
def open_by_doi(spark, d):
    """Whether references are open by a look-up of their DOI, failures closed (EX8)."""
    memo = read_table(spark, d, "paper").select(tx.doi_norm(F.col("doi")).alias("doi"), F.coalesce("open_access", F.lit(False)).alias("o")).filter("doi is not null").groupBy("doi").agg(F.bool_or("o").alias("is_open"))
    return pipeline.open_by_doi(ev._records(spark, d), "row_id", memo)


@query(f"""WITH {LATEST_SQL}, e AS (SELECT paper, "year", row_number() OVER (PARTITION BY "year" ORDER BY received_at, row_id) AS rank FROM latest WHERE open_access IS TRUE AND length(trim(coalesce(full_text, ''))) >= 500)
SELECT * FROM e WHERE "year" BETWEEN 2016 AND 2023 AND rank <= CASE WHEN "year" <= 2018 THEN 7 ELSE 6 END""")
def collected_papers(spark, d):
    """Eligible papers of every year, in the order of their arrival, until the year's quota is filled (PL1, PL3, SL2, SL3)."""
    ok = F.col("open_access") & (F.length(F.btrim(F.coalesce("full_text", F.lit("")))) >= 500)
    out = pipeline.collected(latest_papers(spark, d), "year", ["received_at", "row_id"], ok, ordinal.year_quotas(2016, 2023, 51))
    return out.select("paper", "year", F.col("rank").cast("bigint").alias("rank"))


@query(_REVIEWS + """, asked AS (SELECT r.paper, row_number() OVER (ORDER BY l.received_at, r.paper) AS pos, r.paper IN (SELECT paper FROM w) AS broken, p1 AND p2 AND p3 AND p4 AS fits FROM r JOIN latest l USING (paper)),
part AS (SELECT *, count(*) FILTER (fits AND NOT broken) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM asked WHERE pos BETWEEN 11 AND 400)
SELECT paper, CASE WHEN broken THEN 'ERROR' WHEN fits THEN 'INCLUDE' ELSE 'EXCLUDE' END AS outcome FROM part WHERE before < 25""")
def screened_papers(spark, d):
    """The screening of an interval of papers: each is asked about over the memo, its answer validated, until enough are taken (PL4)."""
    p = latest_papers(spark, d).select("paper", "received_at").join(_reviews(spark, d), "paper")
    part = ordinal.interval(p, ["received_at", "paper"], "11-400").drop("pos")
    asked = part.select("paper", "received_at", F.col("answer").alias("payload")).withColumn("key", external.memo_key("review", "v1", "stub", F.col("payload")))
    memo = asked.select("key", F.lit("review").alias("operation"), F.to_json(F.struct(F.col("payload").alias("answer"))).alias("response"), F.lit(None).cast("string").alias("error")).dropDuplicates(["key"])
    answers, _ = external.call(asked, memo, external.stub, "review")
    given = materialize(answers.select("paper", "received_at", F.get_json_object("response", "$.answer").alias("answer")), "answers")
    sound = reasoning.review_outcomes(given.select("paper", "answer"), "paper", "answer").select("paper", "final_decision")
    j = given.select("paper", "received_at").join(sound, "paper", "left").withColumn("outcome", F.coalesce("final_decision", F.lit("ERROR")))
    return ordinal.until_target(j.withColumn("hit", F.col("outcome") == "INCLUDE"), ["received_at", "paper"], "hit", 25).select("paper", "outcome")


@query(ev._EVIDENCE + f""", {LATEST_SQL}, per AS (SELECT paper, count(*) AS n_facts, count(*) FILTER (covered) AS n_covered, coalesce(string_agg(fact_key, ',' ORDER BY fact_key) FILTER (NOT covered), '') AS failed FROM coverage GROUP BY paper)
SELECT l.paper, CASE WHEN p.n_facts IS NULL THEN 'NO_FACTS' WHEN n_facts = n_covered THEN 'INCLUDE' ELSE 'EXCLUDE' END AS decision, coalesce(n_facts, 0) AS n_facts, coalesce(n_covered, 0) AS n_covered, coalesce(failed, '') AS failed FROM latest l LEFT JOIN per p USING (paper)""")
def final_papers(spark, d):
    """The final row of every paper: decision, coverage and the facts that failed (PL5, PRJ13)."""
    return pipeline.final_rows(latest_papers(spark, d), ev._coverage(spark, d))


@query(ev._RATES + f""", {LATEST_SQL} SELECT c.paper, l.title, l."year" AS "year" FROM c JOIN latest l USING (paper) WHERE c.code IS NULL""")
def qualified_papers(spark, d):
    """Qualified papers with what was fetched of them; those not fetched are skipped (JN14, PL12)."""
    return ev.oa_qualified(spark, d).join(latest_papers(spark, d).select("paper", "title", "year"), "paper")


@query(ev._COVERS + f""", dim AS (SELECT {paper_sql('citing_pmcid')} AS paper, upper(trim(reference_id, E' \\t\\n\\r')) AS ref, arg_max(row_id, (ingested_at, row_id)) AS row_id FROM reference_record WHERE deleted_at IS NULL GROUP BY ALL)
SELECT m.paper, m.ref, d.row_id, r.title FROM members m JOIN dim d USING (paper, ref) JOIN reference_record r ON r.row_id = d.row_id""")
def selected_manifest(spark, d):
    """The references of the minimum covers with their records (JN13)."""
    covers = materialize(ev._covers(spark, d), "covers")
    members, _ = minset.minimum_cover(covers)
    records = ev._records(spark, d)
    dim = evidence.reference_dim(records).select("paper", "ref", "row_id")
    return members.select("paper", "ref").join(dim, ["paper", "ref"]).join(records.select("row_id", "title"), "row_id").select("paper", "ref", "row_id", "title")


@query(ev._UNITS + """, lone AS (SELECT paper, mask, unit FROM ranked, range(0, 6) t(unit) WHERE rn = 1 AND (mask & (1 << CAST(unit AS INTEGER))) <> 0),
del AS (SELECT c.paper, count(*) AS n_chosen, count(*) FILTER (NOT coalesce(a.sufficient, false)) AS n_indispensable FROM lone c LEFT JOIN assessed a ON a.paper = c.paper AND a.mask = c.mask - (1 << CAST(c.unit AS INTEGER)) GROUP BY c.paper)
SELECT p.paper, p.status, p.n_facts, coalesce(d.n_chosen, 0) AS n_chosen, coalesce(d.n_indispensable, 0) AS n_indispensable FROM papers p LEFT JOIN del d USING (paper)""")
def ground_truth(spark, d):
    """Every paper's ground truth: subsets enumerated and assessed, the smallest sufficient one chosen, each of its facts
    deleted in turn; papers out of the range of facts with the reason (PL8, CO1, CO2, CO5)."""
    a = materialize(ev._assessed(spark, d), "assessed")
    tests = minset.deletion_test(a, minset.smallest_sufficient(a)).groupBy("paper").agg(F.count(F.lit(1)).alias("n_chosen"), F.count_if("indispensable").alias("n_indispensable"))
    out = minset.fact_counts(ev._keyed_facts(spark, d)).join(tests, "paper", "left")
    return out.select("paper", "status", "n_facts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chosen", "n_indispensable")])


@query(f"""WITH f AS (SELECT {paper_sql('citing_pmcid')} AS paper, row_id, pos, f.figure_id AS figure_id, lower(trim(regexp_replace(coalesce(f.caption, ''), '\\s+', ' ', 'g'))) AS s FROM (SELECT *, unnest(figure_captions) AS f, generate_subscripts(figure_captions, 1) AS pos FROM reference_record))
SELECT paper, row_id, pos, figure_id FROM (SELECT *, row_number() OVER (PARTITION BY paper, s ORDER BY row_id, pos) AS rn FROM f) WHERE rn = 1 OR s = ''""")
def distinct_figures(spark, d):
    """The first of the figures of one source in a paper (SO10)."""
    f = ev._records(spark, d).select(paper_key(F.col("citing_pmcid")).alias("paper"), "row_id", F.posexplode("figure_captions").alias("p", "f"))
    f = f.select("paper", "row_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.col("f.figure_id").alias("figure_id"), F.lower(tx.collapse(F.coalesce("f.caption", F.lit("")))).alias("s"))
    return pipeline.first_of_source(f, "paper", F.col("s"), ["row_id", "pos"]).select("paper", "row_id", "pos", "figure_id")


@query(f"""WITH {LATEST_SQL}, n AS (SELECT {paper_sql('citing_pmcid')} AS paper, count(*) AS n_files, count(*) FILTER (coalesce(trim(f.caption), '') = '' OR f.label IS NULL) AS n_missing FROM (SELECT citing_pmcid, unnest(figure_captions) AS f FROM reference_record) GROUP BY 1)
SELECT l.paper, coalesce(n_files, 0) AS n_files, coalesce(n_missing, 0) AS n_missing, coalesce(n_missing, 0) = 0 AS complete FROM latest l LEFT JOIN n USING (paper)""")
def dataset_audit(spark, d):
    """Figures that every paper's dataset lacks (AG15)."""
    files = ev._records(spark, d).select(paper_key(F.col("citing_pmcid")).alias("paper"), F.explode("figure_captions").alias("f"))
    files = files.select("paper", F.col("f.figure_id").alias("name"), ((F.coalesce(F.btrim("f.caption"), F.lit("")) != "") & F.col("f.label").isNotNull()).alias("found"))
    return pipeline.dataset_audit(latest_papers(spark, d), files, "paper", "name")


@query(f"""WITH {LATEST_SQL} SELECT l.paper FROM latest l WHERE EXISTS (SELECT 1 FROM feasibility_audit a WHERE {paper_sql('a.pmcid')} = l.paper)""")
def usable_packages(spark, d):
    """Packages that are ready (FLT8)."""
    from quillmark.operators import assembly

    done = read_table(spark, d, "feasibility_audit").select(paper_key(F.col("pmcid")).alias("paper"))
    return pipeline.usable(assembly.registry(latest_papers(spark, d).select("paper"), done, ["paper"])).select("paper")


@query(ev._RATES + "SELECT paper, round_even(resolved_rate, 3) AS resolved_rate, round_even(archive_rate, 1) AS archive_rate FROM a")
def rates_half_even(spark, d):
    """Rates rounded half to even (SC15)."""
    return ev._rates(spark, d).select("paper", *[F.bround(c, n).alias(c) for c, n in (("resolved_rate", 3), ("archive_rate", 1))])


@query(f"""WITH f AS (SELECT {paper_sql('pmcid')} AS paper, count(*) AS n, min(fact_key) AS k FROM candidate_fact GROUP BY 1)
SELECT paper, 'constant' AS rule, 'schema_version' AS detail FROM f WHERE k % 7 = 0 UNION ALL SELECT paper, 'required', 'gap' FROM f WHERE k % 5 = 0 UNION ALL SELECT paper, 'size', 'facts' FROM f WHERE n NOT BETWEEN 2 AND 6 UNION ALL SELECT paper, 'no_object', '' FROM f WHERE false""")
def document_violations(spark, d):
    """Ground-truth documents against their schema: required parts, constants, sizes of lists (VA9)."""
    f = ev._keyed_facts(spark, d).groupBy("paper").agg(F.count(F.lit(1)).alias("n"), F.min("fact_key").alias("k"))
    # the lists are cut at seven entries, more of them break the same rule
    facts = F.transform(F.sequence(F.lit(1), F.least("n", F.lit(7))), lambda i: F.struct(i.alias("fact_id")))
    doc = F.to_json(F.struct(F.when(F.col("k") % 7 == 0, "0.9").otherwise("1.0").alias("schema_version"), F.when(F.col("k") % 5 != 0, "a gap").alias("gap"), facts.alias("facts")))
    return reasoning.document_rules(f.select("paper", doc.alias("doc")), "paper", "doc", ["gap", "facts"], {"schema_version": "1.0"}, {"facts": (2, 6)})
