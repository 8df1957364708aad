"""Queries of audits, coverage, tracing, covers and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.functions.ids import id_list, paper_key, ref_key
from quillmark.operators import cascade, evidence, minset, reasoning, validate
from quillmark.operators.ordinal import group_position
from quillmark.plans.fixtures import LATEST_SQL, ids_sql, latest_papers, paper_sql, plain_sql
from quillmark.session import materialize, read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Thresholds of the audit cascade: (code, column, minimum).
MINIMA = [("E_FEW_REFERENCES", "n_total", 5), ("E_LOW_RESOLUTION", "resolved_rate", 0.6), ("E_LOW_OPEN", "open_rate", 0.1), ("E_LOW_ARCHIVE", "archive_rate", 0.3), ("E_FEW_ARCHIVED", "n_archive", 2)]


def _facts(spark, d):
    return read_table(spark, d, "candidate_fact")


def _records(spark, d):
    return read_table(spark, d, "reference_record")


def _rates(spark, d):
    filled = lambda c: F.coalesce(F.btrim(c), F.lit("")) != ""
    r = _records(spark, d).filter("deleted_at is null and trace_depth = 0").select(
        paper_key(F.col("citing_pmcid")).alias("paper"), (filled("pmcid") | filled("pmid") | filled("doi")).alias("resolved"), (F.length(F.coalesce("full_text", F.lit(""))) > 0).alias("open"), filled("pmcid").alias("archive")
    )
    return evidence.audit_rates(r, "paper", {"resolved": "resolved", "open": "open", "archive": "archive"})


_RATES = f"""WITH r AS (
  SELECT {paper_sql('citing_pmcid')} AS paper, (trim(coalesce(pmcid, '')) <> '' OR trim(coalesce(pmid, '')) <> '' OR trim(coalesce(doi, '')) <> '') AS resolved,
         length(coalesce(full_text, '')) > 0 AS open, trim(coalesce(pmcid, '')) <> '' AS archive
  FROM reference_record WHERE deleted_at IS NULL AND trace_depth = 0),
a AS (SELECT paper, count(*) AS n_total, count(*) FILTER (resolved) AS n_resolved, count(*) FILTER (open) AS n_open, count(*) FILTER (archive) AS n_archive,
             count(*) FILTER (resolved) / count(*) AS resolved_rate, count(*) FILTER (open) / count(*) AS open_rate, count(*) FILTER (archive) / count(*) AS archive_rate FROM r GROUP BY paper),
c AS (SELECT *, CASE {' '.join(f"WHEN {c} < {m} THEN '{code}'" for code, c, m in MINIMA)} END AS code FROM a)
"""


@query(_RATES + "SELECT paper, n_total, n_resolved, n_open, n_archive, round(resolved_rate, 6) AS resolved_rate, round(open_rate, 6) AS open_rate, round(archive_rate, 6) AS archive_rate FROM a")
def intro_oa_audit(spark, d):
    """Counts and rates of resolved, open and archived references per paper (AG2)."""
    a = _rates(spark, d)
    return a.select("paper", "n_total", "n_resolved", "n_open", "n_archive", *[F.round(c, 6).alias(c) for c in ("resolved_rate", "open_rate", "archive_rate")])


@query(_RATES + "SELECT paper, code FROM c")
def oa_threshold_code(spark, d):
    """The first minimum a paper misses (FLT3)."""
    return _rates(spark, d).select("paper", cascade.below_minimum(MINIMA).alias("code"))


@query(_RATES + "SELECT paper FROM c WHERE code IS NULL")
def oa_qualified(spark, d):
    """Papers that reach all minima: the conjunction, which equals a NULL code (FLT4, PL12)."""
    return _rates(spark, d).filter(cascade.all_hold({c: m for _, c, m in MINIMA})).select("paper")


@query(_RATES + "SELECT coalesce(code, 'OK') AS code, count(*) AS n_papers FROM c GROUP BY 1")
def oa_code_counts(spark, d):
    return _rates(spark, d).select(F.coalesce(cascade.below_minimum(MINIMA), F.lit("OK")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n_papers"))


@query("""WITH m AS (SELECT row_id, c.paragraph_index AS paragraph_index, c.context AS context, pos FROM (SELECT row_id, unnest(citation_contexts) AS c, generate_subscripts(citation_contexts, 1) AS pos FROM reference_record))
SELECT row_id, paragraph_index, arg_min(context, pos) AS context, count(*) AS n_mentions FROM m GROUP BY ALL""")
def citation_mentions(spark, d):
    """Mentions distinct by reference and paragraph (PRJ10, PRJ11, WN7)."""
    return evidence.mentions(_records(spark, d), "row_id")


@query(f"""WITH e AS (SELECT {paper_sql('pmcid')} AS paper, anchor_paragraph_index AS paragraph_index, unnest({ids_sql("array_to_string(nearby_reference_ids, ',')")}) AS ref FROM candidate_fact)
SELECT paper, paragraph_index, string_agg(ref, ',' ORDER BY ref) AS refs FROM (SELECT DISTINCT * FROM e) GROUP BY ALL""")
def paragraph_refs(spark, d):
    """The distinct ids cited near the facts of every paragraph (PRJ10)."""
    e = _facts(spark, d).select(paper_key(F.col("pmcid")).alias("paper"), F.col("anchor_paragraph_index").alias("paragraph_index"), F.explode(id_list(F.array_join("nearby_reference_ids", ","))).alias("ref"))
    return e.groupBy("paper", "paragraph_index").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("refs"))


_EVIDENCE = f"""WITH dim AS (
  SELECT paper, ref, row_id, in_archive, has_text, is_primary, is_review, has_figures, trace_depth FROM (
    SELECT {paper_sql('citing_pmcid')} AS paper, upper(trim(reference_id, E' \\t\\n\\r')) AS ref, row_id, coalesce(pmcid, '') <> '' AS in_archive, length(coalesce(full_text, '')) > 0 AS has_text,
           coalesce(list_contains(article_types, 'research-article'), false) AS is_primary, coalesce(list_contains(article_types, 'review-article'), false) AS is_review,
           coalesce(len(figure_captions), 0) > 0 AS has_figures, coalesce(trace_depth, 0) AS trace_depth,
           row_number() OVER (PARTITION BY {paper_sql('citing_pmcid')}, upper(trim(reference_id, E' \\t\\n\\r')) ORDER BY ingested_at DESC, row_id DESC) AS rn
    FROM reference_record WHERE deleted_at IS NULL) WHERE rn = 1),
facts AS (SELECT fact_key, {paper_sql('pmcid')} AS paper, {ids_sql("array_to_string(nearby_reference_ids, ',')")} AS ids FROM candidate_fact),
near AS (SELECT fact_key, paper, unnest(ids) AS ref, generate_subscripts(ids, 1) AS pos FROM facts),
edges AS (SELECT n.*, d.* EXCLUDE (paper, ref) FROM near n JOIN dim d USING (paper, ref)),
ok AS (SELECT * FROM edges WHERE in_archive AND has_text AND is_primary AND has_figures),
coverage AS (SELECT f.fact_key, f.paper, (SELECT count(*) FROM edges e WHERE e.fact_key = f.fact_key) AS n_nearby, coalesce(o.ids, '') AS eligible_ids, o.ids IS NOT NULL AS covered
             FROM facts f LEFT JOIN (SELECT fact_key, string_agg(ref, ',' ORDER BY pos) AS ids FROM ok GROUP BY fact_key) o USING (fact_key))
"""


def _edges(spark, d):
    return evidence.fact_edges(_facts(spark, d)).join(evidence.reference_dim(_records(spark, d)), ["paper", "ref"])


def _coverage(spark, d):
    return evidence.fact_coverage(_facts(spark, d), _edges(spark, d))


@query(_EVIDENCE + "SELECT fact_key, ref, row_id FROM ok")
def eligible_evidence(spark, d):
    """Edges between facts and eligible references (JN4, JN10, FLT6)."""
    return evidence.eligible(_edges(spark, d)).select("fact_key", "ref", "row_id")


@query(_EVIDENCE + "SELECT * FROM coverage")
def fact_coverage(spark, d):
    """Coverage of every fact (JN8, AG7)."""
    return _coverage(spark, d)


@query(_EVIDENCE + "SELECT paper, count(*) AS n_facts, count(*) FILTER (covered) AS n_covered, bool_and(covered) AS all_covered FROM coverage GROUP BY paper")
def paper_decision(spark, d):
    """All facts of a paper covered or not (AG8, AG9)."""
    return evidence.paper_decision(_coverage(spark, d))


@query(_EVIDENCE + "SELECT c.fact_key, c.paper, f.fact_id FROM coverage c JOIN candidate_fact f USING (fact_key) WHERE NOT covered")
def failed_facts(spark, d):
    """The facts without eligible evidence (AG8, FLT13)."""
    return _coverage(spark, d).filter("not covered").select("fact_key", "paper").join(_facts(spark, d).select("fact_key", "fact_id"), "fact_key")


@query(_EVIDENCE + """, per AS (SELECT paper, count(*) AS n_refs, count(*) FILTER (trace_depth > 0) AS n_traced FROM dim GROUP BY paper),
nn AS (SELECT fact_key, count(*) AS n_near, count(*) FILTER (trace_depth > 0) AS n_near_traced FROM edges GROUP BY fact_key)
SELECT fact_key, CASE WHEN len(ids) = 0 THEN coalesce(n_refs, 0) ELSE coalesce(n_near, 0) + coalesce(n_traced, 0) - coalesce(n_near_traced, 0) END AS n_required
FROM facts LEFT JOIN per USING (paper) LEFT JOIN nn USING (fact_key)""")
def required_pair_counts(spark, d):
    """How many references each fact must be assessed against (JN5)."""
    return evidence.required_pair_counts(_facts(spark, d), _edges(spark, d), evidence.reference_dim(_records(spark, d)))


@query(f"""WITH r AS (SELECT {paper_sql('citing_pmcid')} AS paper, unnest({ids_sql('source_reference_id')}) AS review, upper(trim(reference_id, E' \\t\\n\\r')) AS original, row_id FROM reference_record WHERE deleted_at IS NULL AND trace_depth > 0),
one AS (SELECT paper, review, original, min(row_id) AS first_id FROM r GROUP BY ALL)
SELECT paper, review, original, hop_no FROM (SELECT *, row_number() OVER (PARTITION BY paper, review ORDER BY first_id, original) AS hop_no FROM one) WHERE hop_no <= 8""")
def review_trace_hop2(spark, d):
    """The first eight works traced through each review (JN6, JN7, SL6)."""
    out = evidence.traced_originals(_records(spark, d))
    return out.withColumn("hop_no", F.col("hop_no").cast("bigint"))


_UNITS = f"""WITH f AS (SELECT fact_key, {paper_sql('pmcid')} AS paper, {ids_sql("array_to_string(nearby_reference_ids, ',')")} AS ids FROM candidate_fact),
u AS (SELECT fact_key, paper, ids, CAST(row_number() OVER (PARTITION BY paper ORDER BY fact_key) - 1 AS INTEGER) AS unit, count(*) OVER (PARTITION BY paper) AS n FROM f),
papers AS (SELECT paper, count(*) AS n_facts, CASE WHEN count(*) < 2 THEN 'TOO_FEW_FACTS' WHEN count(*) > 6 THEN 'TOO_MANY_FACTS' ELSE 'OK' END AS status FROM f GROUP BY paper),
units AS (SELECT u.* FROM u JOIN papers USING (paper) WHERE status = 'OK'),
masks AS (SELECT paper, ref, CAST(bit_or(1 << unit) AS INTEGER) AS mask FROM (SELECT paper, unit, unnest(ids) AS ref FROM units) GROUP BY ALL),
subsets AS (SELECT paper, n_facts AS n, m AS mask, row_number() OVER (PARTITION BY paper ORDER BY bit_count(m), reverse(lpad(bin(m), 31, '0')) DESC) AS subset_no
            FROM papers, range(1, 64) r(m) WHERE status = 'OK' AND m < (1 << CAST(n_facts AS INTEGER)) AND bit_count(m) >= 2),
whole AS (SELECT paper, count(*) AS n_refs FROM masks GROUP BY paper),
assessed AS (SELECT s.paper, s.mask, s.subset_no, s.n, (SELECT count(*) FROM masks r WHERE r.paper = s.paper AND (r.mask & s.mask) <> 0) * 5 >= coalesce(w.n_refs, 0) * 4 AS sufficient FROM subsets s LEFT JOIN whole w USING (paper)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY CASE WHEN sufficient THEN 0 ELSE 1 END, CASE WHEN sufficient THEN bit_count(mask) ELSE -bit_count(mask) END, subset_no) AS rn FROM assessed)
"""


def _keyed_facts(spark, d):
    return _facts(spark, d).select("fact_key", paper_key(F.col("pmcid")).alias("paper"))


def _units(spark, d):
    return minset.paper_units(_keyed_facts(spark, d))


def _subsets(spark, d):
    papers = _units(spark, d).groupBy("paper").agg(F.max("n_units").cast("int").alias("n"))
    out = papers.select("paper", F.posexplode(minset.subset_masks(F.col("n"))).alias("p", "mask"))
    return out.select("paper", "mask", (F.col("p") + 1).cast("bigint").alias("subset_no"))


def _assessed(spark, d):
    """A subset counts as sufficient if its facts are near four fifths of the references its paper's facts are near."""
    masks = minset.reference_masks(_units(spark, d), evidence.fact_edges(_facts(spark, d)))
    # a paper has at most 63 distinct masks, however many references; each subset meets them, not the references
    kinds = masks.groupBy("paper", "mask").agg(F.count(F.lit(1)).alias("n")).groupBy("paper").agg(F.collect_list(F.struct("mask", "n")).alias("ms"), F.sum("n").alias("n_refs"))
    s = _subsets(spark, d).join(kinds, "paper", "left")
    hit = F.coalesce(F.aggregate("ms", F.lit(0).cast("bigint"), lambda a, m: a + F.when(m.mask.bitwiseAND(F.col("mask")) != 0, m.n).otherwise(0)), F.lit(0))
    return s.select("paper", "mask", "subset_no", F.lit(1.0).alias("confidence"), (hit * 5 >= F.coalesce("n_refs", F.lit(0)) * 4).alias("sufficient"))


@query(_UNITS + "SELECT * FROM papers")
def fact_count_status(spark, d):
    """Every paper with the number of its facts and whether its subsets are assessed (VA2)."""
    return minset.fact_counts(_keyed_facts(spark, d))


@query(_UNITS + "SELECT paper, mask, subset_no FROM subsets")
def subset_enumeration(spark, d):
    """All subsets of two and more facts of papers with two to six, in order (CO1); fact_count_status names the others."""
    return _subsets(spark, d).select("paper", F.col("mask").cast("bigint").alias("mask"), "subset_no")


@query(_UNITS + "SELECT p.paper, coalesce(r.mask, 0) AS mask, coalesce(NOT r.sufficient, false) AS fallback, p.status FROM papers p LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (paper)")
def min_subset(spark, d):
    """The smallest sufficient subset of facts, else all facts, of every paper, or why it has none (CO2, SL5)."""
    out = minset.smallest_sufficient(_assessed(spark, d)).withColumn("mask", F.col("mask").cast("bigint"))
    return minset.fact_counts(_keyed_facts(spark, d)).join(out, "paper", "left").select("paper", F.coalesce("mask", F.lit(0)).alias("mask"), F.coalesce("fallback", F.lit(False)).alias("fallback"), "status")


@query(_UNITS + """, chosen AS (SELECT paper, mask, unit FROM ranked, range(0, 6) t(unit) WHERE rn = 1 AND (mask & (1 << CAST(unit AS INTEGER))) <> 0)
SELECT c.paper, c.unit, NOT coalesce(a.sufficient, false) AS indispensable FROM chosen c LEFT JOIN assessed a ON a.paper = c.paper AND a.mask = c.mask - (1 << CAST(c.unit AS INTEGER))""")
def fact_deletion(spark, d):
    """Whether the chosen subset fails without one of its facts (CO5)."""
    a = _assessed(spark, d)
    out = minset.deletion_test(a, minset.smallest_sufficient(a))
    return out.withColumn("unit", F.col("unit").cast("bigint"))


_FACT_COVERS = f"""WITH RECURSIVE f AS (SELECT fact_key, {paper_sql('pmcid')} AS paper, {ids_sql("array_to_string(nearby_reference_ids, ',')")} AS ids FROM candidate_fact),
g AS (SELECT *, lag(ids) OVER (PARTITION BY paper ORDER BY fact_key) AS before FROM f),
fact_units AS (SELECT DISTINCT paper, ref, 'FACT:' || fact_key AS unit FROM (SELECT paper, fact_key, unnest(ids) AS ref FROM f)),
bridge_units AS (SELECT DISTINCT paper, ref, 'BRIDGE:' || fact_key || ':' || ref AS unit FROM (SELECT paper, fact_key, before, unnest(ids) AS ref FROM g WHERE before IS NOT NULL) WHERE list_contains(before, ref)),
"""
_REDUCED = """conf AS (SELECT paper, ref, count(*) AS c FROM cov GROUP BY ALL),
lone AS (SELECT paper, unit, min(ref) AS ref FROM cov GROUP BY ALL HAVING count(*) = 1),
forced AS (SELECT DISTINCT paper, ref FROM lone),
done AS (SELECT DISTINCT paper, unit FROM cov SEMI JOIN forced USING (paper, ref)),
rest AS (SELECT * FROM cov ANTI JOIN done USING (paper, unit)),
np AS (SELECT paper, count(DISTINCT unit) AS n_units FROM cov GROUP BY paper),
nl AS (SELECT paper, count(DISTINCT unit) AS n_left FROM rest GROUP BY paper),
papers AS (SELECT paper, n_units, coalesce(n_left, 0) AS n_left, CASE WHEN coalesce(n_left, 0) <= 10 THEN 'EXACT' ELSE 'OVER_LIMIT' END AS status FROM np LEFT JOIN nl USING (paper)),
bits AS (SELECT paper, unit, CAST(row_number() OVER (PARTITION BY paper ORDER BY unit) - 1 AS INTEGER) AS bit FROM (SELECT DISTINCT paper, unit FROM rest JOIN papers USING (paper) WHERE status = 'EXACT')),
m AS (SELECT paper, ref, CAST(bit_or(1 << bit) AS INTEGER) AS mask FROM rest JOIN bits USING (paper, unit) GROUP BY ALL),
want AS (SELECT paper, CAST(bit_or(mask) AS INTEGER) AS goal FROM m GROUP BY paper),
best AS (SELECT paper, mask, arg_min(ref, (-c, ref)) AS ref, max(c) AS c FROM m JOIN conf USING (paper, ref) GROUP BY paper, mask),
opt AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY ref) AS pos FROM best),
sets AS (SELECT paper, pos AS last, mask AS state, 1 AS n, c AS score, [pos] AS picks FROM opt
  UNION ALL SELECT s.paper, o.pos, s.state | o.mask, s.n + 1, s.score + o.c, list_append(s.picks, o.pos) FROM sets s JOIN opt o ON o.paper = s.paper AND o.pos > s.last AND (s.state | o.mask) <> s.state WHERE s.n < 10),
whole AS (SELECT s.*, row_number() OVER (PARTITION BY s.paper ORDER BY n, score DESC, list_reverse(picks)) AS rn FROM sets s JOIN want w ON w.paper = s.paper AND w.goal = s.state),
members AS (SELECT paper, ref, true AS forced FROM forced UNION ALL SELECT o.paper, o.ref, false FROM opt o JOIN whole w ON w.paper = o.paper AND w.rn = 1 AND list_contains(w.picks, o.pos)),
sizes AS (SELECT p.*, (SELECT count(*) FROM members x WHERE x.paper = p.paper) AS n_members FROM papers p)
"""
_COVERS = _FACT_COVERS + "cov AS (SELECT * FROM fact_units),\n" + _REDUCED
_BRIDGED = _FACT_COVERS + "cov AS (SELECT * FROM fact_units UNION ALL SELECT * FROM bridge_units),\n" + _REDUCED
_SIZES = "SELECT paper, n_units, n_left, n_members, status FROM sizes"


def _bridges(spark, d):
    """Each fact and the one before it in its paper make a bridge, which the references near both support."""
    f = _facts(spark, d).select("fact_key", paper_key(F.col("pmcid")).alias("paper"), id_list(F.array_join("nearby_reference_ids", ",")).alias("ids"))
    g = group_position(f, ["paper"], ["fact_key"], "n")
    before = g.select("paper", (F.col("n") + 1).alias("n"), F.col("ids").alias("before"))
    both = g.join(before, ["paper", "n"]).select("paper", F.col("fact_key").alias("bridge_id"), F.array_intersect("ids", "before").alias("refs"))
    status = F.when(F.size("refs") > 1, "ESTABLISHED").when(F.size("refs") == 1, "PARTIAL").otherwise("MISSING")
    return both.select("paper", "bridge_id", status.alias("status"), F.explode_outer("refs").alias("ref"))


def _covers(spark, d, bridged: bool = False):
    edges = evidence.fact_edges(_facts(spark, d)).filter("paper is not null")
    return minset.coverage_units(edges, _bridges(spark, d) if bridged else None, fact="fact_key")


def _cover_sizes(covers):
    members, papers = minset.minimum_cover(materialize(covers, "covers"))
    n = members.groupBy("paper").agg(F.count(F.lit(1)).alias("n_members"))
    return papers.join(n, "paper", "left").select("paper", "n_units", "n_left", F.coalesce("n_members", F.lit(0)).alias("n_members"), "status")


@query(_BRIDGED + "SELECT paper, ref, count(*) FILTER (unit LIKE 'FACT:%') AS n_fact_units, count(*) FILTER (unit LIKE 'BRIDGE:%') AS n_bridge_units, CAST(count(*) AS DOUBLE) AS confidence FROM cov GROUP BY ALL")
def coverage_units(spark, d):
    """What every reference covers, facts and bridges, and its confidence (JN12, CO6)."""
    covers = _covers(spark, d, bridged=True)
    n = covers.groupBy("paper", "ref").agg(F.count_if(F.col("unit").startswith("FACT:")).alias("n_fact_units"), F.count_if(F.col("unit").startswith("BRIDGE:")).alias("n_bridge_units"))
    return n.join(minset.confidences(covers), ["paper", "ref"])


@query(_FACT_COVERS + "need AS (SELECT paper, 'FACT:' || fact_key AS unit FROM f) SELECT paper, unit FROM need ANTI JOIN fact_units USING (paper, unit)")
def uncovered_facts(spark, d):
    """Facts that no reference covers (CO3)."""
    required = _keyed_facts(spark, d).select("paper", F.concat(F.lit("FACT:"), F.col("fact_key").cast("string")).alias("unit"))
    return minset.uncovered_units(required, _covers(spark, d))


@query(_COVERS + _SIZES)
def min_cover_size(spark, d):
    """Size of an exact minimum reference cover of every paper's facts; of papers over the limit, the references that every
    cover has (CO3, AG10)."""
    return _cover_sizes(_covers(spark, d))


@query(_BRIDGED + _SIZES)
def bridge_cover_size(spark, d):
    """The same for facts and bridges (CO3, CO6)."""
    return _cover_sizes(_covers(spark, d, bridged=True))


@query(_COVERS + """, chosen AS (SELECT cov.* FROM cov SEMI JOIN members USING (paper, ref)), only_one AS (SELECT paper, min(ref) AS ref FROM chosen GROUP BY paper, unit HAVING count(*) = 1)
SELECT m.paper, m.ref, m.forced, coalesce(o.n, 0) AS newly_uncovered, o.n IS NOT NULL AS indispensable FROM members m LEFT JOIN (SELECT paper, ref, count(*) AS n FROM only_one GROUP BY ALL) o USING (paper, ref)""")
def min_cover_members(spark, d):
    """The references of the minimum cover, whether every cover has them and whether each is indispensable (CO3, CO4)."""
    covers = materialize(_covers(spark, d), "covers")
    members, _ = minset.minimum_cover(covers)
    chosen = covers.join(members.select("paper", "ref"), ["paper", "ref"], "left_semi")
    return members.join(minset.removal_test(chosen), ["paper", "ref"])


@query(_FACT_COVERS + """lone AS (SELECT paper, min(ref) AS ref FROM fact_units GROUP BY paper, unit HAVING count(*) = 1), n AS (SELECT paper, ref, count(*) AS k FROM lone GROUP BY ALL)
SELECT c.paper, c.ref, coalesce(n.k, 0) AS newly_uncovered, n.k IS NOT NULL AS indispensable FROM (SELECT DISTINCT paper, ref FROM fact_units) c LEFT JOIN n USING (paper, ref)""")
def removal_test(spark, d):
    """Facts that only one reference of a paper covers, for all papers (CO4)."""
    return minset.removal_test(_covers(spark, d))


_FACTS_SQL = _EVIDENCE + f""", {LATEST_SQL}, known AS (SELECT DISTINCT paper, ref FROM dim),
v AS (
  SELECT fact_key, 'claims' AS rule, CAST(atomic_claim_count AS VARCHAR) AS detail FROM candidate_fact WHERE coalesce(atomic_claim_count, 0) <> 1
  UNION ALL SELECT fact_key, 'no_reference', '' FROM facts WHERE len(ids) = 0
  UNION ALL SELECT c.fact_key, 'anchor', c.anchor_text FROM candidate_fact c LEFT JOIN latest l ON l.paper = {paper_sql('c.pmcid')}
    WHERE coalesce({plain_sql('c.anchor_text')}, '') = '' OR NOT coalesce(contains({plain_sql('l.introduction')}, {plain_sql('c.anchor_text')}), false)
  UNION ALL SELECT n.fact_key, 'unknown_reference', n.ref FROM near n WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.paper = n.paper AND k.ref = n.ref))
SELECT 'fact ' || fact_key AS scope, rule, detail FROM v
UNION ALL SELECT 'paper ' || paper, 'fact_count', CAST(count(*) AS VARCHAR) FROM facts GROUP BY paper HAVING count(*) NOT BETWEEN 2 AND 6"""


@query(_FACTS_SQL)
def fact_violations(spark, d):
    """Violations of the rules for facts: an anchor that stands in the introduction, some reference, known ones only, one
    claim, two to six of a paper (VA2, SO3)."""
    facts = _facts(spark, d).withColumn("paper", paper_key(F.col("pmcid"))).withColumn("ids", id_list(F.array_join("nearby_reference_ids", ",")))
    known = evidence.reference_dim(_records(spark, d)).select("paper", "ref")
    intros = latest_papers(spark, d).select("paper", "introduction")
    return reasoning.fact_rules(facts.select("fact_key", "paper", "anchor_text", "ids", "atomic_claim_count"), intros, known)


@query(f"""SELECT paper, 'duplicate_statement' AS rule, s AS detail FROM (SELECT {paper_sql('pmcid')} AS paper, lower(trim(regexp_replace(statement, '\\s+', ' ', 'g'))) AS s FROM candidate_fact) WHERE s <> '' GROUP BY ALL HAVING count(*) > 1""")
def duplicate_text(spark, d):
    """Statements that stand more than once in a paper (SC18, VA4)."""
    f = _facts(spark, d).withColumn("paper", paper_key(F.col("pmcid")))
    return validate.duplicates(f, ["paper"], F.lower(tx.collapse(F.col("statement"))), "duplicate_statement")


_FIGURES = """WITH g AS (SELECT row_id, f.caption AS caption, pos, row_id || ':' || pos AS figure_uid, trace_depth FROM (SELECT row_id, trace_depth, unnest(figure_captions) AS f, generate_subscripts(figure_captions, 1) AS pos FROM reference_record)),
dec AS (SELECT row_id, figure_uid, CASE WHEN caption ~ '[0-9]' THEN 'EXPERIMENTAL_DATA' ELSE 'SCHEMATIC' END AS classification, length(coalesce(caption, '')) % 3 <> 0 AS real_data, pos < 3 AS relevant,
  CASE WHEN pos % 2 = 1 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS decision FROM g WHERE pos <= 3
  UNION ALL SELECT DISTINCT row_id, row_id || ':x', 'SCHEMATIC', false, false, 'EXCLUDE' FROM g WHERE trace_depth = 1
  UNION ALL SELECT row_id, figure_uid, 'SCHEMATIC', false, false, 'EXCLUDE' FROM g WHERE pos = 2 AND row_id % 5 = 0)
"""


def _figure_decisions(spark, d):
    """Figures, and decisions on them as a screening might give them, some of which break the rules."""
    r = _records(spark, d)
    g = r.select("row_id", "trace_depth", F.posexplode("figure_captions").alias("p", "f")).withColumn("pos", F.col("p") + 1)
    g = g.select("row_id", "trace_depth", "pos", F.col("f.caption").alias("caption"), F.concat_ws(":", F.col("row_id").cast("string"), F.col("pos").cast("string")).alias("figure_uid"))
    fixed = [F.lit("SCHEMATIC").alias("classification"), F.lit(False).alias("real_data"), F.lit(False).alias("relevant"), F.lit("EXCLUDE").alias("decision")]
    told = g.filter("pos <= 3").select(
        "row_id", "figure_uid", F.when(F.coalesce("caption", F.lit("")).rlike("[0-9]"), "EXPERIMENTAL_DATA").otherwise("SCHEMATIC").alias("classification"),
        (F.length(F.coalesce("caption", F.lit(""))) % 3 != 0).alias("real_data"), (F.col("pos") < 3).alias("relevant"), F.when(F.col("pos") % 2 == 1, "INCLUDE").otherwise("EXCLUDE").alias("decision"),
    )
    extra = g.filter("trace_depth = 1").select("row_id").distinct().select("row_id", F.concat(F.col("row_id").cast("string"), F.lit(":x")).alias("figure_uid"), *fixed)
    again = g.filter("pos = 2 and row_id % 5 = 0").select("row_id", "figure_uid", *fixed)
    return g.select("row_id", "figure_uid"), told.unionByName(extra).unionByName(again)


@query(_FIGURES + """SELECT row_id, 'figure_missing' AS rule, figure_uid AS detail FROM g WHERE figure_uid NOT IN (SELECT figure_uid FROM dec)
UNION ALL SELECT DISTINCT row_id, 'figure_extra', figure_uid FROM dec WHERE figure_uid NOT IN (SELECT figure_uid FROM g)
UNION ALL SELECT row_id, 'figure_repeated', figure_uid FROM dec GROUP BY row_id, figure_uid HAVING count(*) > 1
UNION ALL SELECT row_id, 'unsafe_inclusion', figure_uid FROM dec WHERE decision = 'INCLUDE' AND NOT (classification = 'EXPERIMENTAL_DATA' AND real_data AND relevant)""")
def figure_decision_violations(spark, d):
    """Decisions on figures: one for each figure and no other, and no inclusion without real, relevant experimental data (VA5, R15)."""
    figures, decisions = _figure_decisions(spark, d)
    return reasoning.figure_rules(figures, decisions, "row_id")


@query(_FIGURES + "SELECT row_id, figure_uid FROM dec WHERE decision = 'INCLUDE' AND classification = 'EXPERIMENTAL_DATA' AND real_data AND relevant")
def curated_figures(spark, d):
    """The figures whose inclusion holds (FLT13)."""
    return reasoning.included_figures(_figure_decisions(spark, d)[1]).select("row_id", "figure_uid")


@query(_EVIDENCE + """, a AS (SELECT DISTINCT paper, ref FROM near), b AS (SELECT paper, ref FROM dim WHERE trace_depth = 0)
SELECT coalesce(a.paper, b.paper) AS paper, coalesce(a.ref, b.ref) AS ref, CASE WHEN a.ref IS NULL THEN 'missing' ELSE 'extra' END AS side FROM a FULL JOIN b ON a.paper = b.paper AND a.ref = b.ref WHERE a.ref IS NULL OR b.ref IS NULL""")
def pair_bijection(spark, d):
    """References that facts name but no record has, and the other way round (JN20, SO4)."""
    near = evidence.fact_edges(_facts(spark, d))
    return validate.both_ways(near, evidence.reference_dim(_records(spark, d)).filter("trace_depth = 0"), ["paper", "ref"])
