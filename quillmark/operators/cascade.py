"""Decision cascades: ordered predicates of which the first that holds gives the code (FLT1-FLT4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[str, Column]]) -> Column:
    """The code of the first rule that is true; NULL if none is. A rule that is NULL does not hold."""
    out = F.lit(None).cast("string")
    for code, when in reversed(rules):
        out = F.when(F.coalesce(when, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def any_element(c: Column, pattern: str) -> Column:
    """Whether any element of a list matches a pattern; a NULL list has no elements."""
    return F.coalesce(F.exists(c, lambda x: F.coalesce(F.rlike(x, F.lit(pattern)), F.lit(False))), F.lit(False))


def all_hold(minima: dict[str, float]) -> Column:
    """The conjunction form of a cascade of minima (FLT4); a missing value counts as 0."""
    out = F.lit(True)
    for c, least in minima.items():
        out = out & (F.coalesce(F.col(c), F.lit(0)) >= F.lit(least))
    return out


def below_minimum(minima: Sequence[tuple[str, str, float]]) -> Column:
    """The cascade form (FLT3): the code of the first (code, column, minimum) whose column is below its minimum."""
    return first_match([(code, F.coalesce(F.col(c), F.lit(0)) < F.lit(least)) for code, c, least in minima])


def partitioned(df: DataFrame, decision: Column) -> tuple[DataFrame, DataFrame]:
    """The rows for which a decision holds and the others (FLT13); NULL counts as not holding."""
    d = F.coalesce(decision, F.lit(False))
    return df.filter(d), df.filter(~d)
