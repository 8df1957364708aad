"""Queries of screening, scoring, ordinals, identity, merge and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.functions.ids import paper_key
from quillmark.operators import cascade, identity, ordinal, scoring
from quillmark.operators.allocation import topic_sample, topic_weights
from quillmark.plans.fixtures import EXCLUDED_TYPES, LATEST_SQL, LEXICON, MIN_ABSTRACT, MIN_FULL_TEXT, TITLE_PATTERN, WITHDRAWN_PATTERN, latest_papers, paper_sql
from quillmark.session import read_table
from quillmark.sources import search

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _screened(spark: SparkSession, d: str) -> DataFrame:
    code = cascade.first_match([
        ("E_NOT_OPEN", ~F.coalesce("open_access", F.lit(False))),
        ("E_SHORT_ABSTRACT", F.length(tx.collapse(F.coalesce("abstract", F.lit("")))) < MIN_ABSTRACT),
        ("E_WITHDRAWN", F.coalesce("title", F.lit("")).rlike(WITHDRAWN_PATTERN) | cascade.any_element(F.col("article_types"), WITHDRAWN_PATTERN)),
        ("E_TYPE", F.arrays_overlap("article_types", F.array(*[F.lit(t) for t in EXCLUDED_TYPES]))),
        ("E_TITLE", F.coalesce("title", F.lit("")).rlike(TITLE_PATTERN)),
        ("E_SHORT_TEXT", F.length(F.btrim(F.coalesce("full_text", F.lit("")))) < MIN_FULL_TEXT),
    ])
    return latest_papers(spark, d).select("paper", "year", F.coalesce(code, F.lit("OK")).alias("code"))


_SCREEN = f"""WITH {LATEST_SQL}, screened AS (
  SELECT paper, "year", CASE
    WHEN NOT coalesce(open_access, false) THEN 'E_NOT_OPEN'
    WHEN length(trim(regexp_replace(coalesce(abstract, ''), '\\s+', ' ', 'g'))) < {MIN_ABSTRACT} THEN 'E_SHORT_ABSTRACT'
    WHEN regexp_matches(coalesce(title, ''), '{WITHDRAWN_PATTERN}') OR regexp_matches(coalesce(array_to_string(article_types, '|'), ''), '{WITHDRAWN_PATTERN}') THEN 'E_WITHDRAWN'
    WHEN list_contains(article_types, 'brief-report') THEN 'E_TYPE'
    WHEN regexp_matches(coalesce(title, ''), '{TITLE_PATTERN}') THEN 'E_TITLE'
    WHEN length(trim(coalesce(full_text, ''), ' ')) < {MIN_FULL_TEXT} THEN 'E_SHORT_TEXT' ELSE 'OK' END AS code
  FROM latest)
"""


@query(_SCREEN + 'SELECT paper, "year", code FROM screened')
def exclusion_code_by_paper(spark, d):
    """First matching screening rule per paper (FLT1, FLT2)."""
    return _screened(spark, d)


@query(_SCREEN + "SELECT code, count(*) AS n_papers FROM screened GROUP BY code")
def exclusion_code_counts(spark, d):
    """Papers per screening outcome (AG1)."""
    return _screened(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n_papers"))


@query(_SCREEN + 'SELECT "year", count(*) AS n_papers, count(*) FILTER (code = \'OK\') AS n_kept, max(paper) AS last_paper FROM screened GROUP BY "year"')
def run_summary(spark, d):
    """Run counts per year, of all and of kept papers (AG1, AG11, AG12, SNK10)."""
    return _screened(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("n_papers"), F.count_if(F.col("code") == "OK").alias("n_kept"), F.max("paper").alias("last_paper"))


def _scores(spark, d):
    p = latest_papers(spark, d)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    return scoring.category_scores(p, "paper", text, LEXICON, F.col("source_categories"))


def _score_sql() -> str:
    one = " UNION ALL ".join(
        f"SELECT paper, {o} AS ord, '{c}' AS category, CAST(" + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in ws) + f" + CASE WHEN coalesce(list_contains(source_categories, '{c}'), false) THEN 2 ELSE 0 END AS BIGINT) AS score FROM txt"
        for o, c, ws in LEXICON
    )
    return f"WITH {LATEST_SQL}, txt AS (SELECT paper, source_categories, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS t FROM latest), scores AS ({one}) "


@query(_score_sql() + "SELECT paper, ord, category, score FROM scores")
def category_score_long(spark, d):
    """Keyword score of every paper and category (AG13)."""
    return _scores(spark, d)


@query(_score_sql() + "SELECT paper, arg_max(category, (score, -ord)) AS category, max(score) AS score FROM scores GROUP BY paper")
def category_argmax(spark, d):
    """Best category per paper, ties to the first (AG14)."""
    return scoring.best_category(_scores(spark, d), "paper")


@query(f"""WITH m AS (SELECT {paper_sql('pmcid')} AS paper, unnest(source_categories) AS c FROM paper)
SELECT paper, string_agg(c, '|' ORDER BY c) AS categories, count(*) AS n_categories FROM (SELECT DISTINCT paper, c FROM m WHERE c IS NOT NULL) GROUP BY paper""")
def category_membership(spark, d):
    """The set of source categories of every paper over all its deliveries (JN1, SL8)."""
    p = read_table(spark, d, "paper").select(paper_key(F.col("pmcid")).alias("paper"), F.explode("source_categories").alias("c")).filter("c is not null")
    return p.groupBy("paper").agg(F.array_sort(F.collect_set("c")).alias("s")).select("paper", F.array_join("s", "|").alias("categories"), F.size("s").cast("bigint").alias("n_categories"))


_FRACTION = f"""WITH {LATEST_SQL}, one AS (SELECT paper, list_distinct(list_filter(source_categories, lambda x: x <> '')) AS l FROM latest),
w AS (SELECT c AS category, count(*) AS n_papers, sum(1.0 / n) AS weight FROM (SELECT paper, unnest(l) AS c, len(l) AS n FROM one WHERE len(l) > 0) GROUP BY c)
"""


def _weights(spark, d):
    return scoring.fractional_weights(latest_papers(spark, d), "paper", "source_categories")


@query(_FRACTION + "SELECT category, n_papers, round(weight, 6) AS weight FROM w")
def fractional_category_weight(spark, d):
    """Fractional multi-label weights (AG3, AG4)."""
    return _weights(spark, d).withColumn("weight", F.round("weight", 6))


@query(_FRACTION + """, h AS (SELECT c AS category, count(*) AS hits FROM (SELECT unnest(source_categories) AS c FROM paper) WHERE c <> '' GROUP BY c)
SELECT h.category, round(coalesce(h.hits * w.weight / w.n_papers, 0), 6) AS population FROM h LEFT JOIN w USING (category)""")
def population_weight(spark, d):
    """Population weights from hit counts over all deliveries (AG5, AG6)."""
    hits = read_table(spark, d, "paper").select(F.explode("source_categories").alias("category")).filter("category <> ''").groupBy("category").agg(F.count(F.lit(1)).alias("hits"))
    return scoring.population_weights(_weights(spark, d), hits).withColumn("population", F.round("population", 6))


@query("SELECT 2014 + CAST(i AS INTEGER) AS \"year\", CAST(1000 // 11 + CASE WHEN i < 1000 % 11 THEN 1 ELSE 0 END AS BIGINT) AS quota FROM range(11) t(i)")
def year_quotas(spark, d):
    """1000 papers spread evenly over 2014-2024 (SL2)."""
    return spark.createDataFrame([*ordinal.year_quotas(2014, 2024, 1000).items()], "year int, quota bigint")


@query(f"""WITH {LATEST_SQL}, q AS (SELECT 2014 + i AS y, 1000 // 11 + CASE WHEN i < 1000 % 11 THEN 1 ELSE 0 END AS quota FROM range(11) t(i))
SELECT paper, "year", rank FROM (SELECT paper, "year", row_number() OVER (PARTITION BY "year" ORDER BY row_id) AS rank FROM latest) r JOIN q ON q.y = r."year" WHERE rank <= quota""")
def year_quota_topn(spark, d):
    """The first papers of every year up to its quota (WN3)."""
    out = ordinal.quota_prefix(latest_papers(spark, d).select("paper", "year", "row_id"), "year", ["row_id"], ordinal.year_quotas(2014, 2024, 1000))
    return out.select("paper", "year", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT row_id, pos FROM (SELECT row_id, row_number() OVER (ORDER BY received_at, row_id) AS pos FROM paper) WHERE pos BETWEEN 51 AND 150")
def interval_select(spark, d):
    """The deliveries at positions 51-150 by time (WN1, WN2)."""
    return ordinal.interval(read_table(spark, d, "paper").select("row_id", "received_at"), ["received_at", "row_id"], "51-150").select("row_id", F.col("pos").cast("bigint").alias("pos"))


@query(f"""WITH {LATEST_SQL} SELECT paper FROM (SELECT paper, sum(h) OVER (ORDER BY received_at, paper ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - h AS before
FROM (SELECT paper, received_at, CASE WHEN open_access AND length(full_text) >= 2000 THEN 1 ELSE 0 END AS h FROM latest)) WHERE before < 40""")
def target_stop(spark, d):
    """The papers a scan by time reads until 40 long open ones are found (WN4)."""
    p = latest_papers(spark, d).select("paper", "received_at", (F.col("open_access") & (F.length("full_text") >= 2000)).alias("hit"))
    return ordinal.until_target(p, ["received_at", "paper"], "hit", 40).select("paper")


@query(f"""SELECT row_id, CAST((row_number() OVER (PARTITION BY {paper_sql('citing_pmcid')} ORDER BY row_id) - 1) // 3 AS INTEGER) AS batch_no FROM reference_record""")
def reference_batches(spark, d):
    """References in batches of three per paper (SL9)."""
    r = read_table(spark, d, "reference_record").select("row_id", paper_key(F.col("citing_pmcid")).alias("paper"))
    return ordinal.batches(r, "paper", ["row_id"], 3).select("row_id", "batch_no")


@query(f"""WITH f AS (SELECT {paper_sql('pmcid')} AS paper, upper(trim(fact_id)) AS fact, arg_max(fact_key, (extracted_at, fact_key)) AS last_key, min(fact_key) AS first_key, count(*) AS n_versions FROM candidate_fact GROUP BY ALL)
SELECT * FROM f""")
def upsert_last_wins(spark, d):
    """The last extraction of every fact, at the place of its first (SO9, WN6)."""
    f = read_table(spark, d, "candidate_fact").select(paper_key(F.col("pmcid")).alias("paper"), F.upper(F.btrim("fact_id")).alias("fact"), "fact_key", "extracted_at")
    return f.groupBy("paper", "fact").agg(F.max_by("fact_key", F.struct("extracted_at", "fact_key")).alias("last_key"), F.min("fact_key").alias("first_key"), F.count(F.lit(1)).alias("n_versions"))


@query(f"""SELECT row_id FROM paper p WHERE NOT EXISTS (SELECT 1 FROM feasibility_audit a WHERE {paper_sql('a.pmcid')} = {paper_sql('p.pmcid')})""")
def resume_anti(spark, d):
    """The paper deliveries not yet audited (JN15, JN16)."""
    todo = read_table(spark, d, "paper").select("row_id", paper_key(F.col("pmcid")).alias("paper"))
    done = read_table(spark, d, "feasibility_audit").select(paper_key(F.col("pmcid")).alias("paper"))
    return identity.resume(todo, done, ["paper"], "row_id").select("row_id")


_DOI = r"nullif(regexp_replace(regexp_extract(lower({c}), '10\.\d{{4,9}}/\S+', 0), '[.,;]+$', ''), '')"
_TRIM = r"nullif(trim({c}, E' \t\n\r'), '')"
_REF_IDENTITY = f"""coalesce('pmcid:' || nullif({paper_sql('pmcid')}, ''), 'pmid:' || {_TRIM.format(c='pmid')}, 'doi:' || {_DOI.format(c='doi')}, 'sha:' || sha256(lower(coalesce(citation_text, ''))))"""
_PAPER_IDENTITY = f"""coalesce('pmcid:' || nullif({paper_sql('pmcid')}, ''), 'doi:' || {_DOI.format(c='doi')}, 'pmid:' || {_TRIM.format(c='pmid')}, 'title:' || lower({_TRIM.format(c='title')}))"""


@query(f"SELECT {paper_sql('citing_pmcid')} AS paper, {_REF_IDENTITY} AS identity, min(row_id) AS first_id, count(*) AS n_rows FROM reference_record GROUP BY ALL")
def ref_identity_dedup(spark, d):
    """First row per cited work and citing paper (SO7)."""
    r = read_table(spark, d, "reference_record").withColumn("paper", paper_key(F.col("citing_pmcid")))
    return identity.first_per_identity(r, ["paper"], identity.reference_identity(), "row_id")


@query(f"SELECT {_PAPER_IDENTITY} AS identity, min(row_id) AS first_id, count(*) AS n_rows FROM paper WHERE {_PAPER_IDENTITY} IS NOT NULL GROUP BY ALL")
def paper_identity(spark, d):
    """First delivery per paper identity (SO8)."""
    return identity.first_per_identity(read_table(spark, d, "paper"), [], identity.paper_identity(), "row_id")


_SHORT_IDENTITY = f"""coalesce(nullif({paper_sql('pmcid')}, ''), {_DOI.format(c='doi')}, lower({_TRIM.format(c='title')}))"""


@query(f"SELECT {_SHORT_IDENTITY} AS identity, min(row_id) AS first_id, count(*) AS n_rows FROM paper WHERE {_SHORT_IDENTITY} IS NOT NULL GROUP BY ALL")
def paper_short_identity(spark, d):
    """First delivery per identity without prefix (SO8)."""
    return identity.first_per_identity(read_table(spark, d, "paper"), [], identity.short_identity(), "row_id")


@query(f"SELECT row_id FROM paper WHERE {_PAPER_IDENTITY} IS NULL UNION ALL SELECT -row_id FROM reference_record WHERE nullif({paper_sql('citing_pmcid')}, '') IS NULL")
def rejected_without_identity(spark, d):
    """Deliveries that nothing identifies, and (negative) references of no paper (SO8)."""
    p = identity.without_identity(read_table(spark, d, "paper"), identity.paper_identity()).select("row_id")
    r = identity.without_identity(read_table(spark, d, "reference_record"), paper_key(F.col("citing_pmcid"))).select((-F.col("row_id")).alias("row_id"))
    return p.unionByName(r)


@query(f"SELECT ref_key, {_DOI.format(c='doi')} AS doi FROM cited_reference")
def doi_norm(spark, d):
    """DOIs of the cited references in one writing (SC8)."""
    return read_table(spark, d, "cited_reference").select("ref_key", tx.doi_norm(F.col("doi")).alias("doi"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x{85}\x{1c}-\x{1f}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS text FROM documents")
def whitespace_norm(spark, d):
    """Texts with blanks collapsed (SC1)."""
    return read_table(spark, d, "documents").select("doc_id", tx.collapse(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 600 THEN substr(text, 1, 300) || E'\\n[...]\\n' || right(text, 300) ELSE text END AS text FROM documents")
def bounded_text(spark, d):
    """Texts of more than 600 characters with their middle left out (SC5)."""
    return read_table(spark, d, "documents").select("doc_id", tx.elide_middle(F.col("text"), 600).alias("text"))


@query("SELECT doc_id, left(sha256('v1|' || coalesce(text, '') || '|' || coalesce(source, '')), 20) AS id, sha256(coalesce(text, '')) AS checksum FROM documents")
def stable_ids(spark, d):
    """Content ids and checksums (SC9, SC10)."""
    return read_table(spark, d, "documents").select("doc_id", tx.stable_id(F.lit("v1"), F.col("text"), F.col("source")).alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))


@query("SELECT row_id, coalesce(array_to_string(article_types, '|'), '') AS joined, len(list_filter(string_split(coalesce(array_to_string(article_types, '|'), ''), '|'), lambda x: x <> '')) AS n_back FROM paper")
def pipe_list_roundtrip(spark, d):
    """Lists as piped text and back (SRC9, SNK2)."""
    j = tx.pipe_join(F.col("article_types"))
    return read_table(spark, d, "paper").select("row_id", j.alias("joined"), F.size(tx.pipe_split(j)).cast("bigint").alias("n_back"))


@query(f"WITH {LATEST_SQL}, n AS (SELECT primary_category AS c, count(*) AS n FROM latest GROUP BY 1) SELECT t.value AS category, coalesce(n.n, 0) AS n_papers FROM sample_target t LEFT JOIN n ON n.c = t.value WHERE t.dimension = 'primary_category'")
def per_category_including_empty(spark, d):
    """Papers per target category, those without any included (SNK7)."""
    n = latest_papers(spark, d).groupBy(F.col("primary_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    t = read_table(spark, d, "sample_target").filter("dimension = 'primary_category'").select(F.col("value").alias("category"))
    return t.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_papers"))


@query(f"""WITH {LATEST_SQL}, c AS (SELECT paper, list_distinct(list_filter(source_categories, lambda x: x <> '')) AS l, "year" FROM latest WHERE "year" BETWEEN 2014 AND 2024)
SELECT "year", category, count(*) AS candidates FROM (SELECT "year", unnest(l) AS category FROM c) GROUP BY ALL""")
def sample_candidates(spark, d):
    """Candidates per year and category: the sampler's report columns (AG3, FLT5)."""
    p = latest_papers(spark, d).filter("year between 2014 and 2024")
    return p.select("year", F.explode(F.array_distinct(F.filter("source_categories", lambda x: x != ""))).alias("category")).groupBy("year", "category").agg(F.count(F.lit(1)).alias("candidates"))


_TOPICS = f"""WITH RECURSIVE {LATEST_SQL},
c AS (SELECT "year" AS y, unnest(list_distinct(list_filter(source_categories, lambda x: x <> ''))) AS cat, paper, row_id AS pos FROM latest WHERE "year" BETWEEN 2014 AND 2024),
one AS (SELECT y, cat, paper, min(pos) AS pos FROM c GROUP BY ALL),
lab AS (SELECT y, paper, 1099511627776 // count(*) AS w FROM one GROUP BY ALL),
pop AS (SELECT y, cat, count(*) AS h FROM (SELECT "year" AS y, unnest(list_distinct(list_filter(source_categories, lambda x: x <> ''))) AS cat FROM paper) GROUP BY ALL),
lanes AS (SELECT y, cat, list(paper ORDER BY pos, paper) AS ids, count(*) AS n, CAST(sum(w) AS DOUBLE) / 1099511627776 AS fw FROM one JOIN lab USING (y, paper) GROUP BY ALL),
w AS (SELECT y, cat, ids, n, h, h * (fw / n) AS weight, row_number() OVER (PARTITION BY y ORDER BY cat) AS ord FROM lanes JOIN pop USING (y, cat)),
cover AS (SELECT DISTINCT y, 0 AS step, CAST([] AS VARCHAR[]) AS tp, CAST([] AS VARCHAR[]) AS tc FROM w
  UNION ALL SELECT y, step + 1, list_append(tp, nxt), list_append(tc, cat) FROM (
    SELECT *, row_number() OVER (PARTITION BY y ORDER BY n, ord) AS rn FROM (
      SELECT s.*, w.cat, w.n, w.ord, list_filter(w.ids, lambda x: NOT list_contains(s.tp, x))[1] AS nxt, len(list_filter(s.tc, lambda x: x = w.cat)) AS held FROM cover s JOIN w ON s.y = w.y WHERE s.step < 40)
    WHERE held < 2 AND nxt IS NOT NULL) WHERE rn = 1),
covered AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY step DESC) AS rn FROM cover) WHERE rn = 1),
goal AS (SELECT w.*, len(list_filter(c.tc, lambda x: x = w.cat)) + (40 - c.step) * w.weight / sum(w.weight) OVER (PARTITION BY w.y) AS target FROM w JOIN covered c ON c.y = w.y),
fill AS (SELECT y, step, tp, tc FROM covered
  UNION ALL SELECT y, step + 1, list_append(tp, nxt), list_append(tc, cat) FROM (
    SELECT *, row_number() OVER (PARTITION BY y ORDER BY target - held DESC, weight / (held + 1) DESC, ord) AS rn FROM (
      SELECT s.*, g.cat, g.target, g.weight, g.ord, list_filter(g.ids, lambda x: NOT list_contains(s.tp, x))[1] AS nxt, len(list_filter(s.tc, lambda x: x = g.cat)) AS held FROM fill s JOIN goal g ON s.y = g.y WHERE s.step < 40)
    WHERE nxt IS NOT NULL) WHERE rn = 1),
done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY step DESC) AS rn FROM fill) WHERE rn = 1),
picks AS (SELECT y AS "year", unnest(tp) AS paper, unnest(tc) AS category, generate_subscripts(tp, 1) AS pick_no FROM done)
"""


def _topics(spark, d):
    p = latest_papers(spark, d).filter("year between 2014 and 2024")
    names = F.array_distinct(F.filter("source_categories", lambda x: x != ""))
    c = p.select("year", F.explode(names).alias("category"), "paper", F.col("row_id").alias("pos"))
    hits = read_table(spark, d, "paper").select("year", F.explode(names).alias("category")).groupBy("year", "category").agg(F.count(F.lit(1)).alias("hits"))
    return c, hits


@query(_TOPICS + "SELECT * FROM picks")
def topic_coverage_sample(spark, d):
    """Topic-coverage sample of up to 40 papers a year, each under one of its categories, by the weights of all deliveries (SL1, SL4, AG5)."""
    c, hits = _topics(spark, d)
    return topic_sample(c, "year", "category", "pos", "paper", 40, 2, hits).withColumn("pick_no", F.col("pick_no").cast("bigint"))


@query(_TOPICS + """SELECT w.y AS "year", w.cat AS category, w.n AS candidates, w.h AS hits, round(w.weight, 3) AS weight, (SELECT count(*) FROM picks p WHERE p."year" = w.y AND p.category = w.cat) AS sampled FROM w""")
def topic_sample_report(spark, d):
    """Per year and category: candidates, hits, weight and papers sampled (SL1, AG3-AG5)."""
    c, hits = _topics(spark, d)
    sampled = topic_sample(c, "year", "category", "pos", "paper", 40, 2, hits).groupBy("year", "category").agg(F.count(F.lit(1)).alias("sampled"))
    out = topic_weights(c, "year", "category", "paper", hits).join(sampled, ["year", "category"], "left")
    return out.select("year", "category", "candidates", "hits", F.round("weight", 3).alias("weight"), F.coalesce("sampled", F.lit(0)).alias("sampled"))


@query("SELECT row_id FROM reference_record WHERE regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '(actin bundling|cortical tension|spindle)') AND coalesce(try_cast(year AS INTEGER), 0) BETWEEN 2010 AND 2024")
def search_hits(spark, d):
    """Keyword search within a range of years over the landed references (SRC1, SRC4)."""
    r = read_table(spark, d, "reference_record")
    return search.search(r, ["actin bundling", "cortical tension", "spindle*"], ["title", "abstract"], F.try_to_number(F.col("year"), F.lit("9999")).cast("int"), 2010, 2024).select("row_id")


@query("""SELECT strftime(published_at, '%Y-%m') AS month, count(*) AS hits FROM paper WHERE published_at >= TIMESTAMP '2014-01-01' AND published_at < TIMESTAMP '2026-01-01'
AND regexp_matches(lower(coalesce(title, '')), 'kinase|ligase') GROUP BY 1""")
def search_counts_by_month(spark, d):
    """Hits per month window, without the rows (SRC2, SRC3)."""
    p = read_table(spark, d, "paper")
    return search.monthly_counts(p, ["kinase", "ligase"], ["title"], "published_at", 2014, 2025)
