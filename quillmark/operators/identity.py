"""Identity, deduplication, merge and resume (SO1-SO10, JN15, JN16, SNK4, SNK5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.ids import paper_key, trimmed
from quillmark.functions.text import doi_norm
from quillmark.operators.ordinal import last_per_key
from quillmark.operators.skew import skew_join


def reference_identity() -> Column:
    """pmcid, else pmid, else doi, else a hash of the citation (SO7)."""
    filled = lambda c: F.nullif(trimmed(F.col(c)), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("pmcid:"), paper_key(F.col("pmcid"))), F.concat(F.lit("pmid:"), filled("pmid")), F.concat(F.lit("doi:"), doi_norm(F.col("doi"))),
        F.concat(F.lit("sha:"), F.sha2(F.lower(F.coalesce("citation_text", F.lit(""))), 256)),
    )


def paper_identity() -> Column:
    """pmcid, else doi, else pmid, else title, with a prefix (SO8); NULL where all are empty."""
    filled = lambda c: F.nullif(trimmed(F.col(c)), F.lit(""))
    return F.coalesce(F.concat(F.lit("pmcid:"), paper_key(F.col("pmcid"))), F.concat(F.lit("doi:"), doi_norm(F.col("doi"))), F.concat(F.lit("pmid:"), filled("pmid")), F.concat(F.lit("title:"), F.lower(filled("title"))))


def short_identity() -> Column:
    """pmcid, else doi, else title, without a prefix (SO8); NULL where all are empty."""
    return F.coalesce(paper_key(F.col("pmcid")), doi_norm(F.col("doi")), F.lower(F.nullif(trimmed(F.col("title")), F.lit(""))))


def without_identity(df: DataFrame, identity: Column) -> DataFrame:
    """Rows that nothing identifies, which are rejected: they are not one paper (SO8)."""
    return df.filter(identity.isNull())


def first_per_identity(df: DataFrame, scope: list[str], identity: Column, order: str) -> DataFrame:
    """(scope, identity, first, n): per scope and identity its first row's order value and its number of rows; rows without
    an identity are left out (without_identity has them)."""
    return df.withColumn("identity", identity).filter("identity is not null").groupBy(*scope, "identity").agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("n_rows"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Old and new rows, of each key the last (SO9). Columns only one side has are NULL on the other."""
    return last_per_key(old.unionByName(new, allowMissingColumns=True), keys, order)


def resume(requests: DataFrame, done: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """The requests not yet done (JN16)."""
    return skew_join(requests, done.select(*keys).distinct(), keys, "left_anti", row_id)
