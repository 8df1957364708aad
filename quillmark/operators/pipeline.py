"""Composed stages: resolution and look-ups over the memo, collection, screening, evidence payloads, final rows (PL3-PL11, EX7, EX8)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import doi_norm
from quillmark.operators.skew import skew_join

#: Characters of abstract and full text that a model is given, and the statuses of datasets that may be used.
ABSTRACT_CHARS, TEXT_CHARS, USABLE = 12_000, 30_000, ("READY", "CURATED")


def year_range(text: str, first: int = 1900, last: int = 2100) -> tuple[int, int]:
    """"Y" or "Y-Z", ascending, within the bounds (SC17)."""
    m = re.fullmatch(r"\s*(\d{4})\s*(?:-\s*(\d{4}))?\s*", text or "")
    a, b = (int(m.group(1)), int(m.group(2) or m.group(1))) if m else (0, 0)
    if not first <= a <= b <= last:
        raise ValueError(f"no range of years: {text!r}")
    return a, b


def share(text: str | float) -> float:
    """A number from 0 to 1 (SC17)."""
    x = float(text)
    if not 0 <= x <= 1:
        raise ValueError(f"no share: {text!r}")
    return x


def _filled(c: str) -> Column:
    return F.nullif(F.btrim(c), F.lit(""))


def resolved_ids(refs: DataFrame, key: str, memo: DataFrame) -> DataFrame:
    """(key, pmid, pmcid, found_by): identifiers of references, their own ones first, then those the memo has for their DOI
    and then for their PMID (EX7).

    memo: (kind, id, pmid, pmcid), kind doi or pmid, one row per id; an entry without ids is a failure that is remembered and
    resolves nothing. found_by: own, doi, pmid or none.
    """
    r = refs.select(F.col(key), _filled("pmid").alias("own_pmid"), _filled("pmcid").alias("own_pmcid"), doi_norm(F.col("doi")).alias("_doi"))
    by_doi = memo.filter("kind = 'doi'").select(F.col("id").alias("_doi"), _filled("pmid").alias("d_pmid"), _filled("pmcid").alias("d_pmcid"))
    j = skew_join(r, by_doi, ["_doi"], "left", key).withColumn("_pmid", F.coalesce("own_pmid", "d_pmid"))
    by_pmid = memo.filter("kind = 'pmid'").select(F.col("id").alias("_pmid"), _filled("pmcid").alias("p_pmcid"))
    j = skew_join(j, by_pmid, ["_pmid"], "left", key)
    found = F.when(F.col("own_pmcid").isNotNull(), "own").when(F.col("d_pmcid").isNotNull(), "doi").when(F.col("p_pmcid").isNotNull(), "pmid").otherwise("none")
    return j.select(key, F.coalesce("_pmid", F.lit("")).alias("pmid"), F.coalesce("own_pmcid", "d_pmcid", "p_pmcid", F.lit("")).alias("pmcid"), found.alias("found_by"))


def open_by_doi(refs: DataFrame, key: str, memo: DataFrame) -> DataFrame:
    """(key, is_open): whether the memo says that a reference's DOI is open; unknown ones and failures are not (EX8).

    memo: (doi, is_open), one row per DOI."""
    r = refs.select(F.col(key), doi_norm(F.col("doi")).alias("_doi"))
    j = skew_join(r, memo.select(F.col("doi").alias("_doi"), "is_open"), ["_doi"], "left", key)
    return j.select(key, F.coalesce("is_open", F.lit(False)).alias("is_open"))


def without_text(df: DataFrame, key: str, text: str, sections: list[str]) -> DataFrame:
    """The keys of rows that have neither a full text nor any section, which a screening must not start with (FLT9)."""
    blank = [F.coalesce(F.btrim(c), F.lit("")) == "" for c in (text, *sections)]
    out = blank[0]
    for b in blank[1:]:
        out = out & b
    return df.filter(out).select(key)


def collected(df: DataFrame, group: str, order: list[str], eligible: Column, quotas: dict) -> DataFrame:
    """The first eligible rows of every group up to its quota, with their rank: what looking at ever more candidates until the
    quota is filled comes to (PL1, PL3, SL3, WN3)."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(group)]
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    most = max(quotas.values(), default=0)
    return df.filter(F.col(group).isin([*quotas]) & F.coalesce(eligible, F.lit(False))).withColumn("rank", rank).filter(F.col("rank") <= most).filter(F.col("rank") <= quota)


def evidence_payload(records: DataFrame) -> DataFrame:
    """What a model is given of every reference: texts cut to their limits, whether there is a full text (PRJ14, SC6)."""
    text = F.coalesce("full_text", F.lit(""))
    return records.select(
        "row_id", "reference_id", F.coalesce("title", F.lit("")).alias("title"), F.substring(F.coalesce("abstract", F.lit("")), 1, ABSTRACT_CHARS).alias("abstract"),
        F.substring(text, 1, TEXT_CHARS).alias("full_text"), F.coalesce(F.size("figure_captions"), F.lit(0)).alias("n_figures"), (text != "").alias("full_text_available"),
    )


def required_pair_classes(facts: DataFrame, edges: DataFrame, dim: DataFrame) -> DataFrame:
    """(paper, fact_class, ref): the pairs of facts and references that need an assessment, in classes (JN5).

    A fact is in the class of its own key, in ``any`` and, if it names no reference, in ``unnamed``. It needs every reference
    of its classes: those near it, the traced ones, and all of its paper where it names none. A row per class and reference
    says the same as all pairs and stays linear in the references of a paper of any size; class_members lists the facts.

    facts: (fact_key, paper, n_ids); edges: (fact_key, paper, ref); dim: (paper, ref, trace_depth).
    """
    near = edges.select("paper", F.col("fact_key").cast("string").alias("fact_class"), "ref")
    traced = dim.filter("trace_depth > 0").select("paper", F.lit("any").alias("fact_class"), "ref")
    papers = facts.filter("n_ids = 0").select("paper").distinct()
    whole = dim.join(papers, "paper", "left_semi").select("paper", F.lit("unnamed").alias("fact_class"), "ref")
    return near.unionByName(traced).unionByName(whole).distinct()


def class_members(facts: DataFrame) -> DataFrame:
    """(paper, fact_class, fact_key): the classes of every fact."""
    names = F.array_compact(F.array(F.col("fact_key").cast("string"), F.lit("any"), F.when(F.col("n_ids") == 0, "unnamed")))
    return facts.select("paper", F.explode(names).alias("fact_class"), "fact_key")


def pairs_of(papers: DataFrame, facts: DataFrame, classes: DataFrame) -> DataFrame:
    """(fact_key, ref): the distinct pairs of the given papers, written out."""
    m, c = (x.join(papers.select("paper").distinct(), "paper", "left_semi") for x in (class_members(facts), classes))
    return m.join(c, ["paper", "fact_class"]).select("fact_key", "ref").distinct()


def final_rows(papers: DataFrame, coverage: DataFrame) -> DataFrame:
    """(paper, decision, n_facts, n_covered, failed): one row per paper: INCLUDE if it has facts and all are covered, NO_FACTS
    without any, else EXCLUDE; the facts that failed in their order (PL5, PRJ13, AG8, AG9).

    coverage: (fact_key, paper, covered). Failed facts are at most those of the paper; their keys are all that is gathered.
    """
    failed = F.array_sort(F.collect_list(F.when(~F.col("covered"), F.col("fact_key"))))
    per = coverage.groupBy("paper").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if("covered").alias("n_covered"), F.array_join(F.transform(failed, lambda x: x.cast("string")), ",").alias("failed"))
    j = papers.select("paper").distinct().join(per, "paper", "left")
    n = F.coalesce("n_facts", F.lit(0))
    return j.select("paper", F.when(n == 0, "NO_FACTS").when(F.col("n_facts") == F.col("n_covered"), "INCLUDE").otherwise("EXCLUDE").alias("decision"), n.alias("n_facts"), F.coalesce("n_covered", F.lit(0)).alias("n_covered"), F.coalesce("failed", F.lit("")).alias("failed"))


def usable(registry: DataFrame, status: str = "status") -> DataFrame:
    """Datasets that are ready or curated (FLT8)."""
    return registry.filter(F.col(status).isin(*USABLE))


def first_of_source(figures: DataFrame, scope: str, source: Column, order: list[str]) -> DataFrame:
    """The first figure of every source within its scope; figures without a source are kept (SO10)."""
    rest = [c for c in figures.columns if c != scope]
    keyed = figures.withColumn("_s", source)
    one = keyed.filter("_s <> ''").groupBy(scope, "_s").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(scope, "x.*")
    return one.unionByName(keyed.filter("_s is null or _s = ''").drop("_s"))


def dataset_audit(packages: DataFrame, files: DataFrame, package: str, name: str) -> DataFrame:
    """(package, n_files, n_missing, complete): files of every package that were not found (AG15). files: (package, name, found)."""
    n = files.groupBy(package).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.coalesce("found", F.lit(False))).alias("n_missing"))
    j = packages.select(package).distinct().join(n, package, "left")
    return j.select(package, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_files", "n_missing")], (F.coalesce("n_missing", F.lit(0)) == 0).alias("complete"))
