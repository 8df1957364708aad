"""Canonical forms of identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without leading and trailing blanks of any kind (Unicode White_Space)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def paper_key(c: Column) -> Column:
    """One key per paper: trimmed, upper case, without the prefix PMC; NULL stays NULL, blank becomes NULL."""
    return F.nullif(F.regexp_replace(F.upper(trimmed(c)), "^PMC", ""), F.lit(""))


def ref_key(c: Column) -> Column:
    """Reference id: trimmed and upper case; blank becomes NULL."""
    return F.nullif(F.upper(trimmed(c)), F.lit(""))


def id_list(c: Column) -> Column:
    """The distinct ids of a text that may hold several, parted by blanks or commas; NULL gives an empty list."""
    parts = F.split(F.upper(F.coalesce(c, F.lit(""))), r"(?U)[\s,]+")
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def label_key(c: Column) -> Column:
    """A label without case, blanks and punctuation; what is empty then becomes NULL."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit(""))
