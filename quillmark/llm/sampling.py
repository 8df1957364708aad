"""Sample matching target category proportions, by hierarchical top-down allocation.

The categories form a tree with one level per dimension (here: all papers, primary category, year). Quotas go down the
tree; what a node cannot fill passes first to its siblings, then to its cousins (nodes of the same value in other branches,
then any). At the leaves papers are drawn by permuted dense rank: the rank of a seeded hash within the leaf. Only counts per
leaf reach the driver; a rank is an offset of a hash range plus the rank within it, so a leaf of any size is ranked in
parallel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.ids import label_key, paper_key
from quillmark.session import materialize, read_table

#: Share of the distinct papers to draw, hash ranges a leaf is ranked in, the most target rows that are accepted, and the most
#: leaves with papers (their counts and quotas are on the driver).
SHARE, RANGES, MAX_TARGETS, MAX_LEAVES = 0.25, 1024, 10_000, 500_000
#: The levels of the tree: dimensions of the targets and the column each is about.
LEVELS = (("primary_category", "category"), ("year", "year"))
OTHER = ""
Leaf = tuple[str, ...]


@dataclass
class Target:
    dimension: str
    value: str
    key: str
    permille: int
    min_rows: int


def read_targets(targets: DataFrame) -> list[Target]:
    """The targets, at most MAX_TARGETS rows; rows without dimension or value are ignored, repeated values count once."""
    rows = targets.select("dimension", "value", label_key(F.col("value")).alias("key"), F.coalesce("target_permille", F.lit(0)).alias("p"), F.coalesce("min_rows", F.lit(0)).alias("m")).filter("dimension is not null and key is not null").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target rows")
    return list({(r.dimension, r.key): Target(r.dimension, r.value, r.key, int(r.p), int(r.m)) for r in reversed(rows)}.values())[::-1]


def distinct_papers(papers: DataFrame) -> DataFrame:
    """(paper, row_id, category, year): one row per paper; of several deliveries the first that has the value gives it.

    Rows without a pmcid are no papers. Category labels lose case, blanks and punctuation; year 0 is missing.
    """
    src = papers.select(paper_key(F.col("pmcid")).alias("paper"), F.col("row_id").cast("bigint").alias("row_id"), label_key(F.col("primary_category")).alias("c"), F.nullif(F.col("year"), F.lit(0)).cast("string").alias("y"))
    return src.filter(F.col("paper").isNotNull()).groupBy("paper").agg(
        F.min("row_id").alias("row_id"),
        F.min(F.when(F.col("c").isNotNull(), F.struct("row_id", "c"))).getField("c").alias("category"),
        F.min(F.when(F.col("y").isNotNull(), F.struct("row_id", "y"))).getField("y").alias("year"),
    )


def _shares(total: int, weights: dict[str, float]) -> dict[str, int]:
    """total in whole parts by weight; the largest remainders are rounded up, ties by key."""
    s = sum(weights.values()) or 1.0
    exact = {k: total * w / s for k, w in weights.items()}
    out = {k: math.floor(x + 1e-9) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


class Allocation:
    """Papers to draw per leaf. OTHER stands for values without a target; it is filled last.

    Running totals per value and per node make every step cost what it changes, so all of it is linear in the leaves (but
    for sorting).
    """

    def __init__(self, counts: dict[Leaf, int], n: int, levels: list[list[Target]]):
        self.counts, self.n, self.levels = counts, min(n, sum(counts.values())), levels
        self.quotas = [_shares(self.n, {t.key: t.permille for t in ts}) if ts else {OTHER: self.n} for ts in levels]
        self.got = dict.fromkeys(counts, 0)
        self.total = 0
        self.drawn: list[dict[str, int]] = [{} for _ in levels]
        self.under: dict[Leaf, int] = {}
        self.held: list[dict[str, int]] = [{} for _ in levels]
        self.children: dict[Leaf, list[str]] = {}
        self.leaves_of: list[dict[str, list[Leaf]]] = [{} for _ in levels]
        seen: set[Leaf] = set()
        for leaf in sorted(counts):
            for i, key in enumerate(leaf):
                self.held[i][key] = self.held[i].get(key, 0) + counts[leaf]
                self.leaves_of[i].setdefault(key, []).append(leaf)
                if leaf[:i + 1] not in seen:
                    seen.add(leaf[:i + 1])
                    self.children.setdefault(leaf[:i], []).append(key)

    def spare(self, leaf: Leaf) -> int:
        return self.counts[leaf] - self.got[leaf]

    def lacks(self, level: int, key: str) -> int:
        return self.quotas[level].get(key, 0) - self.drawn[level].get(key, 0)

    def take(self, leaf: Leaf, want: int) -> None:
        k = min(want, self.spare(leaf), self.n - self.total)
        if k > 0:
            self.got[leaf] += k
            self.total += k
            for i, key in enumerate(leaf):
                self.drawn[i][key] = self.drawn[i].get(key, 0) + k
                self.under[leaf[:i + 1]] = self.under.get(leaf[:i + 1], 0) + k

    def down(self, node: Leaf, quota: int) -> None:
        """Bring what is drawn under a node up to its quota, as far as its leaves and the quotas of their values allow."""
        level = len(node)
        missing = quota - self.under.get(node, 0) if node else quota - self.total
        if level == len(self.levels):
            self.take(node, min([missing, *[self.lacks(i, node[i]) for i in range(1, level)]]))
            return
        if missing <= 0:
            return
        keys = self.children.get(node, [])
        parts = _shares(quota, {k: self.quotas[level].get(k, 0) for k in self.quotas[level]})
        for key in sorted(keys, key=lambda k: (self.held[level][k], k)):  # the scarce ones first
            self.down((*node, key), parts.get(key, 0))
        for key in sorted(keys, key=lambda k: (-self.lacks(level, k), k == OTHER, k)):  # siblings, those that lack most first
            missing = quota - (self.under.get(node, 0) if node else self.total)
            if missing <= 0:
                break
            child = (*node, key)
            self.down(child, self.under.get(child, 0) + min(missing, self.lacks(level, key)))

    def run(self) -> dict[Leaf, int]:
        for i, ts in enumerate(self.levels):  # minima first, of the scarce values first, from the leaves with most papers
            for t in sorted(ts, key=lambda t: self.held[i].get(t.key, 0)):
                for leaf in sorted(self.leaves_of[i].get(t.key, []), key=lambda x: (-self.spare(x), x)):
                    self.take(leaf, t.min_rows - self.drawn[i].get(t.key, 0))
        self.down((), self.n)
        # within a branch its own quota comes before those of the values below
        for key in self.children.get((), []):
            for leaf in sorted(self.leaves_of[0][key], key=lambda x: (*[-self.lacks(i, x[i]) for i in range(1, len(x))], x)):
                self.take(leaf, self.lacks(0, key))
        # cousins: what a value still lacks, from branches that lack most; then any leaf
        for i in range(len(self.levels) - 1, 0, -1):
            for key in sorted(self.leaves_of[i], key=lambda k: (-self.lacks(i, k), k == OTHER, k)):
                for leaf in sorted(self.leaves_of[i][key], key=lambda x: (-self.lacks(0, x[0]), x[0] == OTHER, x)):
                    self.take(leaf, self.lacks(i, key))
        for leaf in sorted(self.counts, key=lambda x: (OTHER in x, -self.spare(x), x)):
            self.take(leaf, self.n)
        return self.got


def allocate(counts: dict[Leaf, int], n: int, levels: list[list[Target]]) -> dict[Leaf, int]:
    """Papers to draw per leaf, n in all if there are as many; levels: the targets of each level of the tree."""
    return Allocation(counts, n, levels).run()


def _leaves(level_count: int) -> list[str]:
    return [f"leaf_{i}" for i in range(1, level_count + 1)]


def _prepared(papers: DataFrame, targets: DataFrame, share: float, levels=LEVELS):
    ts = read_targets(targets)
    per_level = [[t for t in ts if t.dimension == d] for d, _ in levels]
    p = materialize(distinct_papers(papers), "papers")
    for name, (_, column), goal in zip(_leaves(len(levels)), levels, per_level):
        keys = [t.key for t in goal]
        p = p.withColumn(name, F.when(F.col(column).isin(keys), F.col(column)).otherwise(F.lit(OTHER)) if keys else F.lit(OTHER))
    names = _leaves(len(levels))
    rows = p.groupBy(*names).count().limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    counts = {tuple(r[x] for x in names): r["count"] for r in rows}
    return p, per_level, counts, math.floor(sum(counts.values()) * share)


def _drawn(p: DataFrame, got: dict[Leaf, int], seed: int) -> DataFrame:
    """The papers of the smallest ranks of every leaf, up to its quota, with the leaf's columns."""
    names = _leaves(len(next(iter(got), ("",) * len(LEVELS))))
    schema = ", ".join(f"{x} string" for x in names) + ", quota bigint"
    quotas = p.sparkSession.createDataFrame([(*leaf, int(k)) for leaf, k in got.items()], schema)  # at most MAX_LEAVES rows
    hashed = p.withColumn("h", F.xxhash64(F.lit(seed), "paper")).withColumn("range", F.shiftrightunsigned("h", 54).cast("int"))
    sizes = hashed.groupBy(*names, "range").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # ranges that begin within the quota; the others have no row that is drawn
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k").join(quotas, names).filter("offset < quota")
    inside = Window.partitionBy(*names, "range").orderBy("h", "paper")
    return hashed.join(offsets, [*names, "range"]).withColumn("rank", F.col("offset") + F.row_number().over(inside)).filter("rank <= quota")


def draw_sample(papers: DataFrame, targets: DataFrame, share: float = SHARE, seed: int = 20240) -> DataFrame:
    """(paper, row_id, category, year): a share of the distinct papers whose shares of categories and years match the targets.

    Papers without a category or year, or with one that has no target, are drawn only where the rest cannot fill the
    sample. An empty table gives an empty sample; without targets the sample is a plain draw. Ties of the hash are broken
    by the paper's id, so the sample is the same at every partitioning.
    """
    p, levels, counts, n = _prepared(papers, targets, share)
    return _drawn(p, allocate(counts, n, levels), seed).select("paper", "row_id", "category", "year")


def sample_report(papers: DataFrame, targets: DataFrame, share: float = SHARE, seed: int = 20240) -> DataFrame:
    """Per target: dimension, value, target_permille, min_rows, needed, available, sampled, is_short.

    needed: min_rows or, if larger, the target's share of the sample rounded up. sampled: what was drawn, counted in the
    sample. is_short: fewer distinct papers than needed.
    """
    p, levels, counts, n = _prepared(papers, targets, share)
    names = _leaves(len(levels))
    drawn = {tuple(r[x] for x in names): r["count"] for r in _drawn(p, allocate(counts, n, levels), seed).groupBy(*names).count().collect()}  # at most MAX_LEAVES rows
    rows = []
    for i, ts in enumerate(levels):
        sums: list[dict[str, int]] = [{}, {}]
        for out, values in zip(sums, (counts, drawn)):
            for leaf, k in values.items():
                out[leaf[i]] = out.get(leaf[i], 0) + k
        for t in ts:
            needed = max(t.min_rows, -(-n * t.permille // 1000))
            available, sampled = (x.get(t.key, 0) for x in sums)
            rows.append((t.dimension, t.value, t.permille, t.min_rows, needed, available, sampled, available < needed))
    return papers.sparkSession.createDataFrame(rows, "dimension string, value string, target_permille int, min_rows int, needed bigint, available bigint, sampled bigint, is_short boolean")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_report(spark, d).filter("is_short").select("dimension", "value")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return sample_report(read_table(spark, d, "paper"), read_table(spark, d, "sample_target"))


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return draw_sample(read_table(spark, d, "paper"), read_table(spark, d, "sample_target"))


_SQL = r"""
WITH p AS (
  SELECT regexp_replace(upper(trim(pmcid, E' \t\n\r')), '^PMC', '') AS paper,
         lower(regexp_replace(primary_category, '[^\p{L}\p{N}]+', '', 'g')) AS category, CAST("year" AS VARCHAR) AS year, row_id
  FROM paper WHERE pmcid IS NOT NULL
),
n AS (SELECT count(DISTINCT paper) // 4 AS n FROM p),
t AS (SELECT *, lower(regexp_replace(value, '[^\p{L}\p{N}]+', '', 'g')) AS key FROM sample_target),
r AS (
  SELECT t.dimension, t.value, greatest(t.min_rows, (n.n * t.target_permille + 999) // 1000) AS needed,
         (SELECT count(DISTINCT paper) FROM p WHERE t.key = CASE WHEN t.dimension = 'year' THEN p.year ELSE p.category END) AS available
  FROM t, n
)
"""
def p6_needs(spark: SparkSession, d: str) -> DataFrame:
    """The part of the report that does not depend on which papers are drawn."""
    return p6_report(spark, d).select("dimension", "value", "target_permille", "min_rows", "needed", "available", "is_short")


QUERIES = {"p6_found": p6_found, "p6_report": p6_report, "p6_needs": p6_needs, "p6_sample": p6_sample}
SQL = {
    "p6_found": _SQL + "SELECT dimension, value FROM r WHERE available < needed",
    "p6_needs": _SQL + "SELECT r.dimension, r.value, t.target_permille, t.min_rows, r.needed, r.available, r.available < r.needed AS is_short FROM r JOIN t USING (dimension, value)",
}
