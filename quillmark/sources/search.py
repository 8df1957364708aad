"""Keyword search over landed tables (SRC1-SRC5): query text, limited and monthly segmented search, counts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_text(mesh: list[str], text: list[str]) -> str:
    """The boolean query of a category: quoted terms with their fields, wildcard terms unquoted (SRC4)."""
    terms = [f'"{m}"[mh]' for m in mesh] + [(t if t.endswith("*") else f'"{t}"') + "[tiab]" for t in text]
    return "(" + " OR ".join(terms) + ")"


def matches(terms: list[str], fields: list[str]) -> Column:
    """Whether any field holds any term, without case; a trailing * is a prefix of a word."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t.rstrip("*").lower())) for t in terms], F.lit(False))


def search(df: DataFrame, terms: list[str], fields: list[str], year: Column, start: int, end: int, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The rows that match within the years; with a limit, the first of them in the given order."""
    hits = df.filter(year.between(start, end) & matches(terms, fields))
    return hits.orderBy(*order).limit(limit) if limit is not None and order else hits


def monthly_counts(df: DataFrame, terms: list[str], fields: list[str], time: str, start: int, end: int) -> DataFrame:
    """(month, hits): hits per half-open month window, so that no day is in two windows (SRC2, SRC3)."""
    inside = (F.col(time) >= F.lit(f"{start}-01-01").cast("timestamp_ntz")) & (F.col(time) < F.lit(f"{end + 1}-01-01").cast("timestamp_ntz"))
    return df.filter(inside & matches(terms, fields)).groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("hits"))


def image_urls(html: Column) -> Column:
    """Addresses of images in a page (SRC15)."""
    return F.regexp_extract_all(html, F.lit(r"(?i)(?:src|href)=[\"']([^\"']+\.(?:png|jpe?g|gif|tiff?))[\"']"), 1)


def normal_term(term: str) -> str:
    return re.sub(r"\s+", " ", term).strip().lower()
