"""Queries of document parsing: articles as XML and back, anchors, decoded model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.operators import jats, nested
from quillmark.plans.fixtures import LATEST_SQL, latest_papers, plain_sql
from quillmark.session import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _escaped(c: str):
    x = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _articles(spark, d):
    """The latest papers written as JATS and parsed back."""
    secs = [F.concat(F.lit(f"<sec><title>{t}</title><p>"), _escaped(c), F.lit("</p></sec>")) for t, c in (("1. Introduction", "introduction"), ("Materials and Methods", "methods"), ("Results", "results"), ("Discussion", "discussion"), ("Conclusions", "conclusions"))]
    xml = F.concat(
        F.lit('<article-set><article article-type="research-article"><front><journal-meta><journal-title-group><journal-title>'), _escaped("journal"), F.lit("</journal-title></journal-title-group></journal-meta><article-meta>"),
        F.lit('<article-id pub-id-type="pmc">'), F.col("paper"), F.lit('</article-id><article-id pub-id-type="doi">'), _escaped("doi"), F.lit("</article-id><title-group><article-title>"),
        F.lit("<bold/>"), _escaped("title"), F.lit("<sup/></article-title></title-group><pub-date pub-type=\"collection\"><year>1900</year></pub-date><pub-date pub-type=\"epub\"><year>"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("</year></pub-date><abstract><p>"), _escaped("abstract"),
        F.lit("</p></abstract></article-meta></front><body>"), *secs, F.lit("</body></article></article-set>"),
    )
    return jats.parse_articles(latest_papers(spark, d).select("paper", xml.alias("xml")), "paper", "xml")


def _flat(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '[\s\x0b\x{{85}}\x{{1c}}-\x{{1f}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


@query(f"""WITH {LATEST_SQL} SELECT paper, 'PMC' || paper AS pmcid, {_flat('title')} AS title, {_flat('abstract')} AS abstract, {_flat('journal')} AS journal, coalesce(doi, '') AS doi, coalesce("year", 0) AS "year" FROM latest""")
def jats_title(spark, d):
    """Front matter through XML and back (PRJ1-PRJ3)."""
    return _articles(spark, d).select("paper", "pmcid", "title", "abstract", "journal", "doi", "year")


_SECTIONS = {"introduction": "1. Introduction", "methods": "Materials and Methods", "results": "Results", "discussion": "Discussion", "conclusions": "Conclusions"}


@query(f"""WITH {LATEST_SQL} SELECT paper, {', '.join(f"{_flat(chr(39) + t + chr(39) + ' || coalesce(' + c + ', ' + chr(39) * 2 + ')')} AS {c}" for c, t in _SECTIONS.items())} FROM latest""")
def jats_sections(spark, d):
    """Section buckets through XML and back (PRJ4, PRJ6)."""
    return _articles(spark, d).select("paper", "introduction", "methods", "results", "discussion", "conclusions")


@query(f"""WITH r AS (SELECT row_id, {_flat('title')} AS title, {_flat('journal')} AS journal, {_flat("CAST(year AS VARCHAR)")} AS "year", {_flat('doi')} AS doi, {_flat('pmid')} AS pmid FROM reference_record) SELECT * FROM r""")
def jats_refs(spark, d):
    """Reference lists through XML and back (PRJ9)."""
    ref = F.concat(
        F.lit('<article><front><article-meta/></front><back><ref-list><ref id="R1"><element-citation><article-title>'), _escaped("title"), F.lit("</article-title><source>"), _escaped("journal"), F.lit("</source><year>"), _escaped("year"),
        F.lit('</year><pub-id pub-id-type="doi">'), _escaped("doi"), F.lit('</pub-id><pub-id pub-id-type="pmid">'), _escaped("pmid"), F.lit("</pub-id></element-citation></ref></ref-list></back></article>"),
    )
    a = jats.parse_articles(read_table(spark, d, "reference_record").select("row_id", ref.alias("xml")), "row_id", "xml")
    return jats.references(a, "row_id").select("row_id", "title", "journal", "year", "doi", "pmid")


@query(f"""WITH {LATEST_SQL}, t AS (SELECT paper, {_flat('title')} AS title FROM latest)
SELECT paper, 1 AS article_no, title, 'research-article|Cells' AS types, 'http://licence.example/a' AS license_url FROM t
UNION ALL SELECT paper, 3, trim('Reply to ' || title), 'letter|short', 'http://licence.example/c' FROM t""")
def jats_article_set(spark, d):
    """Sets of several articles: all come out, with types from three places and the licence's address by its chain (PRJ2)."""
    xml = F.concat(
        F.lit('<set xmlns:x="http://www.w3.org/1999/xlink"><article article-type="research-article"><front><article-meta><article-categories><subj-group><subject>Cells</subject></subj-group></article-categories><title-group><article-title>'), _escaped("title"),
        F.lit('</article-title></title-group><permissions><license x:href="http://licence.example/a"><license-ref>http://licence.example/b</license-ref></license></permissions></article-meta></front></article><article><body/></article>'),
        F.lit('<article article-type="letter"><front><article-meta><title-group><article-title>Reply to '), _escaped("title"),
        F.lit('</article-title></title-group><permissions><license><p>Free</p><license-ref>http://licence.example/c</license-ref></license></permissions><custom-meta-group><custom-meta><meta-name>article-type</meta-name><meta-value>short</meta-value></custom-meta></custom-meta-group></article-meta></front></article></set>'),
    )
    a = jats.parse_articles(latest_papers(spark, d).select("paper", xml.alias("xml")), "paper", "xml")
    return a.select("paper", "article_no", "title", F.array_join("article_types", "|").alias("types"), "license_url")


def _cited(spark, d):
    """The contexts of every reference as paragraphs of an introduction, each with three citations, one of an unknown reference."""
    p = F.transform("citation_contexts", lambda c: F.concat(F.lit("<p>"), _escaped(c.context), F.lit(' <xref ref-type="bibr" rid="A B">[1]</xref> <xref ref-type="bibr" rid="A">[2]</xref></p>')))
    xml = F.concat(F.lit('<article><front><article-meta/></front><body><sec><title>Results</title><p>No</p></sec><sec sec-type="intro"><title>1</title>'), F.array_join(p, ""), F.lit('</sec></body><back><ref-list><ref id="A"/></ref-list></back></article>'))
    return jats.parse_articles(read_table(spark, d, "reference_record").filter("citation_contexts is not null").select("row_id", xml.alias("xml")), "row_id", "xml")


_CONTEXTS = f"""WITH c AS (SELECT row_id, {_flat("coalesce(c.context, '') || ' [1] [2]'")} AS text, CAST(pos AS INTEGER) AS paragraph_index FROM (SELECT row_id, unnest(citation_contexts) AS c, generate_subscripts(citation_contexts, 1) AS pos FROM reference_record))
"""


@query(_CONTEXTS + "SELECT row_id, paragraph_index, text, 'A,B' AS refs FROM c")
def jats_paragraphs(spark, d):
    """Paragraphs of the introduction with the references each cites (PRJ6, PRJ10)."""
    return jats.paragraphs(_cited(spark, d), "row_id").select("row_id", "paragraph_index", "text", F.array_join("reference_ids", ",").alias("refs"))


@query(_CONTEXTS + "SELECT row_id, 'A' AS reference_id, 2 * count(*) AS n_contexts, arg_min(text, paragraph_index) AS first_context, arg_max(text, paragraph_index) AS last_context FROM c GROUP BY row_id")
def jats_contexts(spark, d):
    """The contexts of known references, once per citation (PRJ10, JN2, JN3)."""
    c = jats.contexts(_cited(spark, d), "row_id")
    return c.select("row_id", "reference_id", F.size("contexts").cast("bigint").alias("n_contexts"), F.element_at("contexts", 1)["context"].alias("first_context"), F.element_at("contexts", -1)["context"].alias("last_context"))


@query(_CONTEXTS + "SELECT row_id, paragraph_index, unnest(['A', 'B']) AS reference_id, '[1]' AS marker, text AS context FROM c")
def jats_mentions(spark, d):
    """The first citation of every reference in every paragraph, with its marker (PRJ11)."""
    return jats.mentions(_cited(spark, d), "row_id").select("row_id", "paragraph_index", "reference_id", "marker", "context")


@query(f"""SELECT row_id, CASE WHEN pos % 2 = 0 THEN 'F' || pos ELSE 'id' || pos END AS figure_id, CASE WHEN pos % 3 = 0 THEN 'Figure ' || pos ELSE 'Plate ' || pos END AS label, {_flat('f.caption')} AS caption, 'g' || pos || '.tif' AS href
FROM (SELECT row_id, unnest(figure_captions) AS f, generate_subscripts(figure_captions, 1) AS pos FROM reference_record)""")
def jats_figures(spark, d):
    """Figures with ids and labels where they have none (PRJ12)."""
    def figure(f, i):
        n = (i + 1).cast("string")
        ident = F.when((i + 1) % 2 == 0, F.lit("<fig>")).otherwise(F.concat(F.lit('<fig id="id'), n, F.lit('">')))
        label = F.when((i + 1) % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<label>Plate "), n, F.lit("</label>")))
        return F.concat(ident, label, F.lit("<caption><p>"), _escaped(f.caption), F.lit('</p></caption><graphic x:href="g'), n, F.lit('.tif"/></fig>'))

    xml = F.concat(F.lit('<article xmlns:x="http://www.w3.org/1999/xlink"><front><article-meta/></front><body><sec>'), F.array_join(F.transform("figure_captions", figure), ""), F.lit("</sec></body></article>"))
    a = jats.parse_articles(read_table(spark, d, "reference_record").filter("figure_captions is not null").select("row_id", xml.alias("xml")), "row_id", "xml")
    return jats.figures(a, "row_id", "F", labelled=True).select("row_id", "figure_id", "label", "caption", "href")


@query(f"""SELECT row_id, coalesce({plain_sql('title')} <> '' AND contains({plain_sql('citation_text')}, {plain_sql('title')}), false) AS held FROM reference_record""")
def anchor_containment(spark, d):
    """Whether a reference's title stands verbatim in its citation, typography aside (SC3, SC4)."""
    return read_table(spark, d, "reference_record").select("row_id", tx.contains_anchor(F.col("citation_text"), F.col("title")).alias("held"))


@query()
def audit_decode(spark, d):
    """Decision and schema version of every decodable audit (SC22, VA1, SRC11)."""
    records = nested.canonical_records(read_table(spark, d, "feasibility_audit"), "audit_id", "audit_json", nested.AUDIT_KEYS, declared=nested.AUDIT_LISTS)
    return records.select("audit_id", F.get_json_object("record", "$.schema_version").alias("schema_version"), F.upper(F.get_json_object("record", "$.decision")).alias("decision"))


@query()
def audit_violations(spark, d):
    """Audits whose decision is none of the two, or that lack facts, assessments or coverage (VA1, VA9)."""
    from quillmark.operators import validate

    records = nested.canonical_records(read_table(spark, d, "feasibility_audit"), "audit_id", "audit_json", nested.AUDIT_KEYS, declared=nested.AUDIT_LISTS)
    j = lambda p: F.get_json_object("record", p)
    return validate.violations(records, ["audit_id"], [
        ("decision", ~F.coalesce(F.upper(j("$.decision")).isin("INCLUDE", "EXCLUDE"), F.lit(False)), j("$.decision")),
        ("no_facts", j("$.candidate_reasoning.candidate_facts[0]").isNull(), F.lit("")),
        ("no_assessments", j("$.evidence_assessments[0]").isNull(), F.lit("")),
        ("no_coverage", j("$.fact_coverage[0]").isNull(), F.lit("")),
    ])


def _assessments(spark, d):
    from quillmark.operators import reasoning

    t = nested.audit_tables(read_table(spark, d, "feasibility_audit"))["$.evidence_assessments"]
    want = ["audit_id", "pos_1", "fact_id", "reference_id", "support_level", "article_type", "has_relevant_experimental_figure"]
    return reasoning.last_assessments(t.select(*[F.col(c) if c in t.columns else F.lit(None).cast("string").alias(c) for c in want]))


@query()
def audit_edges(spark, d):
    """The last assessment of every fact and reference of every audit that counts as evidence (JN9, FLT6)."""
    from quillmark.operators import reasoning

    return reasoning.direct_primary(_assessments(spark, d)).select("audit_id", "fact_id", "reference_id")


@query()
def audit_reviews(spark, d):
    """Reviews with direct support per audit, which are to be traced (FLT7, JN6)."""
    from quillmark.operators import reasoning

    return reasoning.direct_reviews(_assessments(spark, d)).groupBy("audit_id").agg(F.count(F.lit(1)).alias("n_reviews"), F.countDistinct("reference_id").alias("n_references"))
