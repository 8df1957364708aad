"""JATS articles as columns (PRJ1-PRJ12, PRJ16): one Arrow pass from XML text to nested structs, one row per article of a set.

Lists of mixed content have no equivalent among Spark's XML functions, so parsing is Python; everything after it (references,
paragraphs, citations, figures) is DataFrame operations. A text that is no XML, or has no article, gives no row.
"""

from __future__ import annotations

import html
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = """article_no int, pmcid string, pmid string, doi string, year int, title string, abstract string, journal string, article_types array<string>, license string, license_url string,
introduction string, methods string, results string, discussion string, conclusions string, full_text string, introduction_text string,
paragraphs array<struct<paragraph_index:int,text:string,citations:array<struct<reference_id:string,marker:string>>>>,
references array<struct<reference_id:string,ordinal:int,citation_text:string,title:string,journal:string,year:string,authors:string,pmid:string,pmcid:string,doi:string>>,
figures array<struct<figure_id:string,ordinal:int,label:string,caption:string,href:string>>"""
_COLUMNS = [x.split()[0] for x in SCHEMA.replace("\n", " ").split(", ")]

#: Section buckets in their order, with the words of a label that decide.
BUCKETS = {
    "introduction": ("introduction", "background"),
    "methods": ("method", "materials", "experimental procedure", "study design"),
    "results": ("result", "finding"),
    "discussion": ("discussion", "interpretation"),
    "conclusions": ("conclusion", "summary", "closing remarks"),
}
#: What tells an introduction, as part of a label or as the whole of a section's type or title.
PART_OF_LABEL, WHOLE_TYPE, WHOLE_TITLE = ("intro", "background"), ("intro", "introduction"), ("introduction", "background")
_HREF = "{http://www.w3.org/1999/xlink}href"


def node_text(node: ET.Element | None) -> str:
    """All text below a node with entities decoded, blanks collapsed and trimmed."""
    return "" if node is None else " ".join(html.unescape("".join(node.itertext())).split())


def _title(sec: ET.Element) -> str:
    return node_text(sec.find("title")).casefold()


def _type(sec: ET.Element) -> str:
    return (sec.get("sec-type") or "").casefold()


def _with_prefix(x: str) -> str:
    x = x.strip()
    return x if not x or x.upper().startswith("PMC") else "PMC" + x


def _int(x: str) -> int:
    return int(x) if x.strip().isdigit() else 0


def _link(node: ET.Element | None) -> str:
    return "" if node is None else node.get(_HREF) or node.get("href") or ""


def section_texts(body: ET.Element, by_type: bool) -> dict[str, str]:
    """The whole text of the top-level sections of each bucket, a blank line between them; the first bucket whose words stand
    in the title (by_type: in the section's type and title) has a section."""
    found: dict[str, list[str]] = {b: [] for b in BUCKETS}
    for sec in body.findall("sec"):
        label = f"{_type(sec)} {_title(sec)}" if by_type else _title(sec)
        bucket = next((b for b, words in BUCKETS.items() if any(w in label for w in words)), None)
        if bucket:
            found[bucket].append(node_text(sec))
    return {b: "\n\n".join(parts) for b, parts in found.items()}


def introduction_of(body: ET.Element, exact: bool = False) -> ET.Element:
    """The first section, in document order, that tells an introduction: by a word in its label, or (exact) by its whole type
    or title; else the first top-level section, also an empty one; else the body."""
    def tells(sec: ET.Element) -> bool:
        if exact:
            return _type(sec) in WHOLE_TYPE or _title(sec) in WHOLE_TITLE
        return any(w in f"{_type(sec)} {_title(sec)}" for w in PART_OF_LABEL)

    hit = next((s for s in body.iter("sec") if tells(s)), None)
    top = body.find("sec") if hit is None else hit
    return body if top is None else top


def _reference(ref: ET.Element, ordinal: int) -> dict:
    cite = next((c for tag in ("element-citation", "mixed-citation", "citation") if (c := ref.find(tag)) is not None), ref)
    ids = {(i.get("pub-id-type") or "").lower(): node_text(i) for i in cite.iter("pub-id")}
    names = [" ".join(x for x in (node_text(n.find("surname")), node_text(n.find("given-names"))) if x) for n in cite.iter("name")]
    return {
        "reference_id": ref.get("id") or f"R{ordinal}", "ordinal": ordinal, "citation_text": node_text(cite), "title": node_text(cite.find(".//article-title")), "journal": node_text(cite.find(".//source")),
        "year": node_text(cite.find(".//year")), "authors": "; ".join(x for x in names if x), "pmid": ids.get("pmid", ""), "pmcid": _with_prefix(ids.get("pmcid") or ids.get("pmc", "")), "doi": ids.get("doi", ""),
    }


def _types(article: ET.Element, meta: ET.Element) -> list[str]:
    """The article's own type, its subjects, and the types among its custom data."""
    custom = [c for c in meta.iter("custom-meta") if node_text(c.find("meta-name")) == "article-type"]
    found = [article.get("article-type") or "", *[node_text(s) for s in meta.findall("article-categories//subject")], *[node_text(c.find("meta-value")) for c in custom]]
    return [t for t in found if t]


def _license(meta: ET.Element) -> tuple[str, str]:
    """Text and address of the licence; the address is its own, or that of its reference, or the reference's text."""
    node = meta.find("permissions/license")
    if node is None:
        return "", ""
    ref = next((n for n in node.iter() if n.tag.rsplit("}", 1)[-1] in ("license-ref", "license_ref")), None)
    return node_text(node), _link(node) or _link(ref) or node_text(ref)


def parse_article(article: ET.Element, number: int = 1, by_type: bool = False, exact: bool = False) -> dict | None:
    meta = article.find("front/article-meta")
    if meta is None:
        return None
    ids = {(i.get("pub-id-type") or "").lower(): node_text(i) for i in meta.findall("article-id")}
    dates = meta.findall("pub-date")
    dated = sorted(dates, key=lambda p: not (p.get("pub-type") or p.get("date-type") or "").startswith("epub"))
    year = next((y for p in dated if (y := node_text(p.find("year")))), "")
    license_text, license_url = _license(meta)
    body = article.find("body")
    intro = None if body is None else introduction_of(body, exact)
    paragraphs = []
    for i, p in enumerate([] if intro is None else intro.iter("p"), 1):
        cited = [{"reference_id": r, "marker": node_text(x)} for x in p.iter("xref") if x.get("ref-type") == "bibr" for r in (x.get("rid") or "").split()]
        paragraphs.append({"paragraph_index": i, "text": node_text(p), "citations": cited})
    figures = [
        {"figure_id": f.get("id") or "", "ordinal": i, "label": node_text(f.find("label")), "caption": node_text(f.find("caption")), "href": _link(f.find(".//graphic"))}
        for i, f in enumerate(article.iter("fig"), 1)
    ]
    return {
        "article_no": number, "pmcid": _with_prefix(ids.get("pmc") or ids.get("pmcid", "")), "pmid": ids.get("pmid", ""), "doi": ids.get("doi", ""), "year": _int(year),
        "title": node_text(meta.find("title-group/article-title")), "abstract": " ".join(t for a in meta.findall("abstract") if (t := node_text(a))), "journal": node_text(article.find("front/journal-meta//journal-title")),
        "article_types": _types(article, meta), "license": license_text, "license_url": license_url, **(dict.fromkeys(BUCKETS, "") if body is None else section_texts(body, by_type)),
        "full_text": node_text(body), "introduction_text": node_text(intro), "paragraphs": paragraphs,
        "references": [_reference(r, i) for i, r in enumerate((r for back in article.findall("back") for lst in back.iter("ref-list") for r in lst.findall("ref")), 1)], "figures": figures,
    }


def parse_text(xml: str | None, by_type: bool = False, exact: bool = False) -> list[dict]:
    """All articles of a text, numbered as they stand; those without front matter are left out, their numbers too."""
    try:
        root = ET.fromstring(xml) if xml else None
    except ET.ParseError:
        return []
    found = [] if root is None else [root] if root.tag == "article" else root.findall(".//article")
    return [a for i, x in enumerate(found, 1) if (a := parse_article(x, i, by_type, exact))]


def parse_articles(df: DataFrame, key: str, xml: str, by_type: bool = False, exact: bool = False) -> DataFrame:
    """(key, article columns): one row per article of each text. by_type: sections are told by type and title, not by title
    alone. exact: the introduction is told by its whole type or title, not by a word in them."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{key: k, **a} for k, x in zip(pdf[key], pdf[xml]) for a in parse_text(x, by_type, exact)]
            yield pd.DataFrame(rows, columns=[key, *_COLUMNS])

    return df.select(key, xml).mapInPandas(run, f"`{key}` {kind}, {SCHEMA}")


def references(articles: DataFrame, key: str) -> DataFrame:
    """The references of parsed articles, one row each (PRJ9)."""
    return articles.select(key, "article_no", F.inline("references"))


def paragraphs(articles: DataFrame, key: str) -> DataFrame:
    """(key, article_no, paragraph_index, text, reference_ids): the introduction's paragraphs with the ids they cite, each once, in order."""
    each = articles.select(key, "article_no", F.inline("paragraphs"))
    return each.select(key, "article_no", "paragraph_index", "text", F.array_distinct(F.transform("citations", lambda c: c.reference_id)).alias("reference_ids"))


def citations(articles: DataFrame, key: str) -> DataFrame:
    """(key, article_no, paragraph_index, place, reference_id, marker, context): every citation in the introduction."""
    each = articles.select(key, "article_no", F.inline("paragraphs"))
    out = each.select(key, "article_no", "paragraph_index", F.col("text").alias("context"), F.posexplode("citations").alias("place", "c"))
    return out.select(key, "article_no", "paragraph_index", "place", "c.*", "context")


def contexts(articles: DataFrame, key: str) -> DataFrame:
    """(key, article_no, reference_id, contexts): for every reference that is cited the paragraphs that do, once per citation,
    in order (PRJ10, JN2, JN3). Citations of unknown references are dropped."""
    each = articles.select(key, "article_no", F.transform("references", lambda r: r.reference_id).alias("_known"), F.inline("paragraphs"))
    cited = each.select(key, "article_no", "_known", "paragraph_index", F.col("text").alias("context"), F.posexplode("citations").alias("place", "c"))
    cited = cited.filter(F.array_contains("_known", F.col("c.reference_id"))).select(key, "article_no", F.col("c.reference_id").alias("reference_id"), "paragraph_index", "place", "context")
    place = F.struct("paragraph_index", "place", "context")
    packed = cited.groupBy(key, "article_no", "reference_id").agg(F.array_sort(F.collect_list(place)).alias("x"))
    return packed.select(key, "article_no", "reference_id", F.transform("x", lambda c: F.struct(c.paragraph_index.alias("paragraph_index"), c.context.alias("context"))).alias("contexts"))


def mentions(articles: DataFrame, key: str) -> DataFrame:
    """(key, article_no, reference_id, paragraph_index, marker, context): the first citation of each reference in each paragraph (PRJ11)."""
    first = F.min_by(F.struct("marker", "context"), "place").alias("x")
    return citations(articles, key).groupBy(key, "article_no", "reference_id", "paragraph_index").agg(first).select(key, "article_no", "reference_id", "paragraph_index", "x.*")


def figures(articles: DataFrame, key: str, prefix: str = "fig", labelled: bool = False) -> DataFrame:
    """(key, article_no, figure_id, label, caption, href): figures, those without an id numbered with a prefix; labelled: those
    without a label get Figure and their number (PRJ12)."""
    each = articles.select(key, "article_no", F.inline("figures"))
    ident = F.when(F.col("figure_id") == "", F.concat(F.lit(prefix), F.col("ordinal").cast("string"))).otherwise(F.col("figure_id"))
    label = F.when((F.col("label") == "") & F.lit(labelled), F.concat(F.lit("Figure "), F.col("ordinal").cast("string"))).otherwise(F.col("label"))
    return each.select(key, "article_no", ident.alias("figure_id"), label.alias("label"), "caption", "href")
