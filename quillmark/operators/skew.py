"""Joins that keep their balance when one key holds a large share of the rows.

The keys that hold at least ``1/MAX_HOT`` of all rows are found by a pre-aggregated count. There can be at most MAX_HOT
of them, whatever the data, so their list may be broadcast. Rows of a hot key are spread over SALTS partitions by a hash
of a row identifier, and the (unique) other side is repeated once per salt for these keys only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least 1/MAX_HOT of all rows counts as hot; its rows go to SALTS partitions.
MAX_HOT, SALTS, MIN_HOT_ROWS = 64, 32, 20_000


def hot_keys(df: DataFrame, keys: list[str], max_hot: int = MAX_HOT, min_rows: int = MIN_HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """The keys of df that hold at least 1/max_hot of its rows and at least min_rows rows; at most max_hot rows.

    counts: the number of rows of each key as _n, where it is known; df is not read again then. Keys that are left out of
    it hold few rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts
    total = counts.agg(F.sum("_n").alias("_t")).scalar()
    return counts.filter((F.col("_n") * max_hot >= total) & (F.col("_n") >= min_rows)).select(*keys).limit(max_hot)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, row_id: str, condition=None, salts: int = SALTS, counts: DataFrame | None = None) -> DataFrame:
    """left joined to right on keys, where right has each key once and left may have hot keys.

    how: inner, left, left_semi or left_anti. condition: a further predicate over columns of both sides. counts: rows of left
    per key as _n, where known. Null keys match nothing (as in SQL). An empty side gives the SQL result. The columns of left
    come first, those of right other than the keys follow (inner and left). Result rows do not depend on which keys are hot.
    """
    hot = F.broadcast(hot_keys(left, keys, counts=counts).withColumn("_hot", F.lit(True)))
    a = left.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(F.col(row_id)), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    ).drop("_hot")
    b = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    on = [*keys, "_salt"]
    if condition is None:
        return a.join(b, on, how).drop("_salt")
    b2 = b.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in b.columns if c not in on])
    cond = condition
    for k in on:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    out = a.join(b2, cond, how)
    return out.drop("_salt", *[f"_r_{k}" for k in on if f"_r_{k}" in out.columns])
