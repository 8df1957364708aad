"""Duplicates hidden by formatting differences, by progressive partition refinement.

Records are grouped by cheap invariants first, and costlier keys are computed only inside classes with several members:

- level 0, in the scan: hash of the stripped second field, length of the stripped first field;
- level 1, for members of level-0 classes of two and more: the letter histogram of the first field, which no reordering changes;
- level 2, for members of level-1 classes of two and more: title and date are taken out of the first field, and what is
  left, two fields in either order, is keyed by the least rotation of its letters, which both orders share.

Classes come from pre-aggregated counts, so no class, however large, meets in one task; members of hot classes are salted.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.skew import skew_join
from quillmark.session import materialize, read_table

_DATE = re.compile(r"(?<!\w)(?:1[6-9]|20)\d\d(?:\W+\d+){0,3}(?!\w)")


def stripped(s: str | None) -> str:
    """The letters and digits of a text in their order, without case."""
    return "".join(c for c in unicodedata.normalize("NFC", s or "").casefold() if c.isalnum())


def least_rotation(s: str) -> str:
    """The smallest of a text's rotations: the same for ab and ba, whatever a and b are. Linear in its length."""
    n, i, j, k = len(s), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = s[(i + k) % n], s[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        j += i == j
        k = 0
    return s[min(i, j):] + s[:min(i, j)]


def _without(text: str, field: str) -> tuple[str, str]:
    """The text without the letters of a field, and the field if it was there: where it stands between marks rather than
    between blanks, or else where it comes first."""
    letters = [(x, i) for i, c in enumerate(text) for x in c.casefold() if x.isalnum()]
    stream, at, places = "".join(x for x, _ in letters), -1, []
    while (at := stream.find(field, at + 1)) >= 0:
        a, b = letters[at][1], letters[at + len(field) - 1][1] + 1
        left, right = text[:a].rstrip(), text[b:].lstrip()
        loose = (left != "" and left[-1].isalnum()) + (right != "" and right[0].isalnum())
        places.append((loose, a, b))
        if not loose:
            break
    if not places:
        return text, ""
    _, a, b = min(places)
    return text[:a] + " | " + text[b:], field


def citation_key(citation: str | None, title: str | None) -> str:
    """The fields of a citation (authors, title, journal, date with volume and pages), each stripped, in a fixed order.

    The title is where the record's title stands in the citation; the date is the longest block of numbers that begins with
    a year. The rest is authors and journal, in either order; a citation whose title the record does not tell counts as
    having no more than these.
    """
    text, found, t = unicodedata.normalize("NFC", citation or ""), "", stripped(title)
    if t:
        text, found = _without(text, t)
    date = max(_DATE.finditer(text), key=lambda m: len(m.group(0)), default=None)
    if date:
        text = text[:date.start()] + " | " + text[date.end():]
    return "\x1f".join([found, stripped(date.group(0)) if date else "", least_rotation(stripped(text))])


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.upper(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", "")


def stripped_key(ordered: str, exact: str) -> Column:
    """The cheap invariant of a field whose parts may be reordered and of one that may not."""
    return F.xxhash64(_letters(F.col(exact)), F.length(_letters(F.col(ordered))))


def letter_histogram(c: str) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(F.split(_letters(F.col(c)), "")), ""))


def _members(df: DataFrame, keys: list[str], level: str) -> DataFrame:
    """The rows of df whose keys at least one other row has."""
    several = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), level)
    return skew_join(df, several.select(*keys), keys, "left_semi", "row_id", counts=several)


def duplicate_classes(df: DataFrame, row_id: str = "row_id", citation: str = "citation_text", title: str = "title") -> DataFrame:
    """(keep_id, row_id, copies): the members of every class of two and more rows that differ in formatting only.

    NULL counts as an empty text; rows without any letter in both fields are copies of each other; repeated rows are
    copies; texts of any length are read in full; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(citation).alias("c"), F.col(title).alias("t"))
    first = _members(rows.withColumn("k0", stripped_key("c", "t")), ["k0"], "level-0")
    second = _members(materialize(first.withColumn("k1", letter_histogram("c")), "members"), ["k0", "k1"], "level-1")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["key"] = [citation_key(c, t) for c, t in zip(pdf["c"], pdf["t"])]
            yield pdf[["row_id", "k0", "k1", "key"]]

    keys = second.mapInPandas(exact, "row_id bigint, k0 bigint, k1 bigint, key string")
    keys = materialize(keys.select("row_id", F.xxhash64("k0", "k1", "key").alias("h1"), F.xxhash64(F.lit(7), "key", "k1").alias("h2")), "classes")
    classes = materialize(keys.groupBy("h1", "h2").agg(F.min("row_id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "level-2")
    return skew_join(keys, classes, ["h1", "h2"], "inner", "row_id", counts=classes.select("h1", "h2", F.col("copies").alias("_n"))).select("keep_id", "row_id", "copies")


def collapse(df: DataFrame, row_id: str = "row_id", citation: str = "citation_text", title: str = "title") -> DataFrame:
    """One row per record, the one of the smallest id of its class, with the number of copies it had (1: none but itself)."""
    members = duplicate_classes(df, row_id, citation, title)
    drop = members.filter("row_id <> keep_id").select(F.col("row_id").alias(row_id))
    counts = members.filter("row_id = keep_id").select(F.col("row_id").alias(row_id), F.col("copies"))
    kept = df.join(drop, row_id, "left_anti").join(counts.withColumnRenamed("copies", "_copies"), row_id, "left")
    return kept.withColumn("n_copies", F.coalesce("_copies", F.lit(1)).cast("bigint")).drop("_copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members = duplicate_classes(read_table(spark, d, "reference_record"))
    return members.filter("row_id <> keep_id").select("keep_id", F.col("row_id").alias("copy_id"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """The collapsed records: id, paper and number of copies."""
    return collapse(read_table(spark, d, "reference_record")).select("row_id", "citing_pmcid", "reference_id", "n_copies")


QUERIES = {"p4_found": p4_found, "p4_records": p4_records}
SQL: dict[str, str] = {}
