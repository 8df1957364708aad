"""Assembly of reasoning datasets: packages, renumbering, remapping, figure files, registry (WN5, JN17-JN22, FLT14, PRJ15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import safe_name
from quillmark.operators.ordinal import global_position, group_position


def renumbered(items: DataFrame, scope: str, parent: str, order: list[str], prefix: str) -> DataFrame:
    """items with parent_no (dense number of the parent within the scope), item_no and new_id <prefix><parent>_<item> (WN5)."""
    parents = group_position(items.select(scope, parent).distinct(), [scope], [parent], "parent_no")
    placed = group_position(items, [scope, parent], order, "item_no")
    return placed.join(parents, [scope, parent]).withColumn(
        "new_id", F.concat(F.lit(prefix), F.col("parent_no").cast("string"), F.lit("_"), F.col("item_no").cast("string"))
    )


def remapped(rows: DataFrame, key: str, ids: str, mapping: DataFrame) -> DataFrame:
    """(key, ids): each id of a list replaced by all its new ones, or kept where it has none, each once in order (JN19).

    mapping: (key, old_id, new_ids array), one row per key and old id.
    """
    each = rows.select(key, F.posexplode(ids).alias("_pos", "old_id")).join(mapping, [key, "old_id"], "left")
    each = each.withColumn("_new", F.coalesce("new_ids", F.array("old_id")))
    return each.groupBy(key).agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_new"))), lambda x: x._new))).alias(ids))


def package_ids(papers: DataFrame, order: list[str], paper: str) -> DataFrame:
    """(paper, package_id): m<position>_<paper>, positions over the total order (PRJ15)."""
    placed = global_position(papers, order)
    return placed.select(paper, F.concat(F.lit("m"), F.col("pos").cast("string"), F.lit("_"), safe_name(F.col(paper))).alias("package_id"))


def matched_files(figures: DataFrame, members: DataFrame, scope: str) -> DataFrame:
    """figures (scope, figure_id, href) with member: the archive member of the same base name, else of the same stem, the
    first by name (JN18)."""
    base = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    m = members.select(scope, "member", base(F.col("member")).alias("_base")).withColumn("_stem", stem(F.col("_base")))
    exact = m.groupBy(scope, "_base").agg(F.min("member").alias("_exact"))
    loose = m.groupBy(scope, "_stem").agg(F.min("member").alias("_loose"))
    f = figures.withColumn("_base", base(F.col("href"))).withColumn("_stem", stem(F.col("_base")))
    out = f.join(exact, [scope, "_base"], "left").join(loose, [scope, "_stem"], "left")
    member = F.coalesce("_exact", F.when(F.col("_stem") != "", F.col("_loose")))
    return out.select(*figures.columns, member.alias("member"), F.when(member.isNull(), "MISSING").otherwise("FOUND").alias("status"))


def registry(expected: DataFrame, present: DataFrame, keys: list[str], found: str = "READY", absent: str = "SKIPPED") -> DataFrame:
    """(*keys, status): every expected item with whether it is present; absent ones are rows, not gaps (FLT14, JN21)."""
    return expected.join(present.select(*keys).distinct().withColumn("_p", F.lit(True)), keys, "left").select(*keys, F.when(F.col("_p"), found).otherwise(absent).alias("status"))


def replaced(rows: DataFrame, key: str, old: str, new: dict) -> DataFrame:
    """rows with the columns of the row of one key set to given values (JN22)."""
    return rows.select(*[F.when(F.col(key) == old, F.lit(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])
