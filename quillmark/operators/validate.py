"""Integrity validators as relations of violations: (key, rule, detail), never an exception on an executor (VA1-VA10).

A validator is a list of rules, each a predicate that holds for a violation; the failing keys are taken out by an anti join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.skew import skew_join


def violations(df: DataFrame, key: list[str], rules: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(*key, rule, detail): one row per row of df and rule (name, predicate, detail) that is true; one pass, no shuffle."""
    each = F.array(*[F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, p, detail in rules])
    return df.select(*key, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("v")).select(*key, "v.rule", "v.detail")


def duplicates(df: DataFrame, scope: list[str], value: Column, rule: str) -> DataFrame:
    """(*scope, rule, detail): values that stand more than once within their scope, NULL and empty ones left out (SC18)."""
    n = df.withColumn("_v", value).filter("_v <> ''").groupBy(*scope, "_v").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return n.select(*scope, F.lit(rule).alias("rule"), F.col("_v").alias("detail"))


def unknown(df: DataFrame, known: DataFrame, scope: list[str], value: str, row_id: str, rule: str) -> DataFrame:
    """(*scope, rule, detail): distinct values without a row in known: A - B (SO3-SO5)."""
    bad = skew_join(df, known.select(*scope, value).distinct(), [*scope, value], "left_anti", row_id)
    return bad.select(*scope, F.lit(rule).alias("rule"), F.col(value).alias("detail")).distinct()


def both_ways(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, side): keys that only one side has - empty if and only if the sets are equal (SO4, JN17, JN20)."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    full = x.join(y, keys, "full")
    return full.filter("_a is null or _b is null").select(*keys, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("side"))


def passing(df: DataFrame, found: DataFrame, key: list[str], row_id: str) -> DataFrame:
    """The rows whose key has no violation."""
    return skew_join(df, found.select(*key).distinct(), key, "left_anti", row_id)


def sealed(df: DataFrame, prefixes: Sequence[str] = ("target_", "sealed_"), paths: Sequence[str] = ()) -> DataFrame:
    """df, after a check that no column is a sealed one and no file comes from a sealed path (VA10)."""
    bad = [c for c in df.columns if c.startswith(tuple(prefixes))]
    files = [f for f in (df.inputFiles() if paths else []) if any(p in f for p in paths)]
    if bad or files:
        raise ValueError(f"sealed columns {bad}, sealed files {files[:3]}")
    return df
