"""Keyword scoring, multi-label weights and argmax (AG3-AG6, AG13, AG14, JN1).

The lexicon is a dimension table (ord, category, keyword) of at most MAX_LEXICON rows, which is checked before it is
broadcast; scoring is one pass without a shuffle: all keywords of a category fold into one expression per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LEXICON = 5_000


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a substring; of the empty word, none."""
    if not word:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")


def category_scores(df: DataFrame, key: str, text: Column, lexicon: list[tuple[int, str, list[str]]], labels: Column | None = None, bonus: int = 2) -> DataFrame:
    """(key, ord, category, score) for every row and category: substring counts in the lower-case text, plus a bonus where
    the category is among the row's labels. A NULL text scores 0."""
    if sum(len(ws) for _, _, ws in lexicon) > MAX_LEXICON:
        raise ValueError(f"the lexicon has more than {MAX_LEXICON} keywords")
    src = df.select(F.col(key), F.lower(F.coalesce(text, F.lit(""))).alias("_t"), (labels if labels is not None else F.array().cast("array<string>")).alias("_l"))
    parts = []
    for order, name, ws in lexicon:
        score = sum((occurrences(F.col("_t"), w.lower()) for w in ws), F.lit(0))
        extra = F.when(F.coalesce(F.array_contains("_l", name), F.lit(False)), bonus).otherwise(0)
        parts.append(F.struct(F.lit(order).alias("ord"), F.lit(name).alias("category"), (score + extra).cast("bigint").alias("score")))
    return src.select(key, F.inline(F.array(*parts)))


def best_category(scores: DataFrame, key: str) -> DataFrame:
    """The category of the greatest score per key; ties go to the smaller ord."""
    best = F.max(F.struct("score", (-F.col("ord")).alias("_o"), "category")).alias("_b")
    return scores.groupBy(key).agg(best).select(key, F.col("_b.category").alias("category"), F.col("_b.score").alias("score"))


def fractional_weights(df: DataFrame, key: str, labels: str) -> DataFrame:
    """(category, n_papers, weight): every row shares a weight of 1 among its distinct labels (AG3, AG4)."""
    one = df.select(key, F.array_distinct(F.filter(labels, lambda x: x.isNotNull() & (x != ""))).alias("_l")).filter(F.size("_l") > 0)
    return one.select(key, F.explode("_l").alias("category"), (1.0 / F.size("_l")).alias("_w")).groupBy("category").agg(
        F.countDistinct(key).alias("n_papers"), F.sum("_w").alias("weight")
    )


def population_weights(weights: DataFrame, hits: DataFrame) -> DataFrame:
    """(category, population): total hits x (fractional weight / retrieved), 0 where nothing was retrieved (AG5)."""
    j = hits.join(weights, "category", "left")
    return j.select("category", F.coalesce(F.col("hits") * F.try_divide(F.col("weight"), F.col("n_papers")), F.lit(0.0)).alias("population"))
