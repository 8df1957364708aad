"""Ordinal operators: positions, intervals, quotas, prefixes, early stop, renumbering (WN1-WN7, SL2, SL3, SL7, SL9).

Order is data: every operator takes explicit order columns that identify a row. Global positions over all rows come from
range partitions and a small table of offsets, not from one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import materialize


def global_position(df: DataFrame, order: list[str], name: str = "pos", weight: str | None = None) -> DataFrame:
    """df with the 1-based position of every row in a total order, or with the running sum of a weight, in parallel.

    Rows are range-partitioned and written once; per-partition totals (as many as partitions) give the offsets.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    value = F.col(weight) if weight else F.lit(1)
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_off") + F.sum(value).over(inside)).drop("_part", "_off")


def group_position(df: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """df with the 1-based position of every row within its group, however large a group is.

    Rows are range-partitioned by group and order; a group that spans several ranges gets the offsets of its earlier
    ranges. At most as many groups span ranges as there are ranges, so the table of offsets stays small.
    """
    ranged = materialize(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    spanning = counts.groupBy(*group).agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select(*group)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(F.broadcast(spanning), group).select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    placed = ranged.withColumn("_in", inside).join(F.broadcast(offsets), [*group, "_part"], "left")
    return placed.withColumn(name, F.coalesce("_off", F.lit(0)) + F.col("_in")).drop("_off", "_in", "_part")


def parse_interval(text: str) -> tuple[int, int]:
    """"N" is 1..N, "A-B" is A..B, 1-based and inclusive (WN2)."""
    m = re.fullmatch(r"\s*(?:(\d+)\s*-\s*)?(\d+)\s*", text)
    a, b = (int(m.group(1) or 1), int(m.group(2))) if m else (0, -1)
    if a < 1 or b < a:
        raise ValueError(f"no interval: {text!r}")
    return a, b


def interval(df: DataFrame, order: list[str], text: str, strict: bool = False) -> DataFrame:
    """The rows at the positions of an interval, with their position. strict: an interval beyond the end is an error."""
    a, b = parse_interval(text)
    placed = global_position(df, order)
    if strict and (n := placed.count()) < b:
        raise ValueError(f"interval {text} beyond the {n} rows")
    return placed.filter(F.col("pos").between(a, b))


def year_quotas(start: int, end: int, count: int) -> dict[int, int]:
    """count spread evenly over the years; the first years get what is left (SL2)."""
    years = range(start, end + 1)
    each, more = divmod(count, len(years))
    return {y: each + (i < more) for i, y in enumerate(years)}


def quota_prefix(df: DataFrame, group: str, order: list[str], quotas: dict) -> DataFrame:
    """The first rows of every group up to its quota (WN3, SL3): groups without a quota give none."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(group)]
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    most = max(quotas.values(), default=0)
    # the constant bound lets the rank limit run before the shuffle
    return df.filter(F.col(group).isin([*quotas])).withColumn("rank", rank).filter(F.col("rank") <= most).filter(F.col("rank") <= quota)


def until_target(df: DataFrame, order: list[str], hit: str, target: int, existing: int = 0) -> DataFrame:
    """The rows a scan reads before it has the target number of hits, carry-over included (WN4)."""
    flagged = df.withColumn("_hit", F.coalesce(F.col(hit), F.lit(False)).cast("int"))
    run = global_position(flagged, order, "_run", "_hit")
    return run.filter(F.col("_run") - F.col("_hit") + existing < target).drop("_run", "_hit")


def batches(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """df with the number of its batch of `size` rows within the group, from 0 (SL9)."""
    placed = group_position(df, [group], order, "_rank")
    return placed.withColumn("batch_no", F.floor((F.col("_rank") - 1) / size).cast("int")).drop("_rank")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key in the given order (WN6), by a partial aggregation rather than a sort per key."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row"))).alias("_m")
    return df.groupBy(*keys).agg(packed).select(*keys, "_m.row.*")
