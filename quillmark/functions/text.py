"""Scalar text functions as column expressions; Arrow UDFs only where Spark has no builtin."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What typographic normalisation maps, and to what.
TYPOGRAPHIC_FROM, TYPOGRAPHIC_TO = "‘’“”‐‑‒–— ", "''\"\"----- "


def collapse(c: Column) -> Column:
    """Runs of Unicode blanks become one space, none at the ends (SC1)."""
    return F.btrim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML entities decoded (SC2); NULL stays NULL."""
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", html.unescape(x)), na_action="ignore")


def normalize_anchor(c: Column) -> Column:
    """Entities decoded, NFKC, typographic quotes and dashes plain, blanks collapsed (SC3)."""
    return collapse(F.translate(_nfkc(c), TYPOGRAPHIC_FROM, TYPOGRAPHIC_TO))


def contains_anchor(text: Column, anchor: Column) -> Column:
    """Whether a text holds an anchor verbatim after normalisation (SC4); a blank anchor is not held."""
    a = normalize_anchor(anchor)
    return F.coalesce(F.contains(normalize_anchor(text), a) & (a != ""), F.lit(False))


def elide_middle(c: Column, most: int, marker: str = "\n[...]\n") -> Column:
    """Head and tail of half the limit each around a marker, where a text is longer than the limit (SC5)."""
    half = most // 2
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, half), F.lit(marker), F.right(c, F.lit(half)))).otherwise(c)


def doi_norm(c: Column) -> Column:
    """Lower case, without resolver address or doi: label, without trailing punctuation; anything else gives NULL (SC8)."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(c), r"10\.\d{4,9}/\S+", 0), r"[.,;]+$", ""), F.lit(""))


def stable_id(*parts: Column) -> Column:
    """First 20 hex digits of the SHA-256 of the parts joined by | (SC9, SC10); NULL counts as empty."""
    return F.left(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(20))


def first_filled(*cs: Column) -> Column:
    """The first that is neither NULL nor empty, else empty (SC12)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or NULL (SC13)."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def int_or_zero(c: Column) -> Column:
    return F.coalesce(F.try_to_number(F.btrim(c), F.lit("999999999")).cast("int"), F.lit(0))


def pipe_join(c: Column) -> Column:
    """A list as |-joined text, NULL as empty (SNK2)."""
    return F.coalesce(F.array_join(c, "|"), F.lit(""))


def pipe_split(c: Column) -> Column:
    """|-joined text as a list without empty entries (SRC9)."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")


def mime_of(name: Column) -> Column:
    """MIME type by suffix (SC19)."""
    x = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(x == "png", "image/png").when(x.isin("jpg", "jpeg"), "image/jpeg").when(x == "gif", "image/gif").when(x.isin("tif", "tiff"), "image/tiff").otherwise("application/octet-stream")


def data_url(binary: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(binary))


def safe_name(c: Column) -> Column:
    """Runs of characters unfit for file names become _ (PRJ15)."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")


def json_block(c: Column) -> Column:
    """The outermost {...} of a model's answer, fences and prose dropped (SC22); NULL where there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
