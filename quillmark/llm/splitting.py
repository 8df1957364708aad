"""Splitting oversized texts at natural boundaries, by dynamic programming over boundary positions.

The cuts of a text minimise the sum of their penalties (by kind of boundary) and of the squared deviation of the pieces'
sizes from their mean, subject to the maximum length and an exact overlap between consecutive pieces.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.session import read_table

LIMIT, OVERLAP = 3000, 200
#: Kinds of boundaries with their penalties, the best first.
KINDS = {"paragraph": 0.0, "line": 0.4, "sentence": 0.8, "clause": 2.0, "blank": 4.0, "none": 12.0}
#: Weight of the squared relative deviation of a piece's size from the mean.
BALANCE = 4.0
#: A weaker kind of boundary is used only where better ones are further apart than this part of the limit.
REACH = 0.125

_PARAGRAPH = re.compile(r"\r?\n[^\S\n]*(?:\r?\n\s*)+| \s*")
_LINE = re.compile(r"\r\n|[\n\r \x0b\x0c]")
_SENTENCE = re.compile(r"(?:[.!?…؟۔।;][\"'”’»)\]]*\s+)|[。！？．｡][\"'”’」』）)]*")
_CLAUSE = re.compile(r"[,;:،؛]\s+|[，；：、]")
_BLANK = re.compile(r"\s+")


def boundaries(text: str, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which text may be cut (the next piece's new part begins there) and their kinds.

    Weaker kinds fill only the stretches in which better ones are more than REACH of the limit apart, so that positions
    stay few and a cut is always possible; where there is not even a blank, positions that part no combined character.
    """
    kinds: dict[int, int] = {}
    step = max(1, int(limit * REACH))
    n = len(text)

    def gaps() -> list[tuple[int, int]]:
        ps = [0, *sorted(kinds), n]
        return [(a, b) for a, b in zip(ps, ps[1:]) if b - a > step]

    for k, pattern in enumerate((_PARAGRAPH, _LINE, _SENTENCE)):
        for m in pattern.finditer(text):
            if 0 < m.end() < n:
                kinds.setdefault(m.end(), k)
    for k, pattern in ((3, _CLAUSE), (4, _BLANK)):
        for a, b in gaps():
            for m in pattern.finditer(text, a, b):
                if a < m.end() < b:
                    kinds.setdefault(m.end(), k)
    for a, b in gaps():
        for p in range(a + step, b, step):
            while p < b and (unicodedata.combining(text[p]) or text[p] in "‍︎️" or text[p - 1] == "‍"):
                p += 1
            if a < p < b:
                kinds.setdefault(p, 5)
    at = np.array(sorted(kinds), dtype=np.int64)
    return at, np.array([kinds[p] for p in at.tolist()], dtype=np.int64)


def split_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """[(start, end, kind of the boundary at its end)], code points; each piece but the first begins overlap before the last one's end.

    A text within the limit is one piece. Every piece has at most limit characters, and together they cover the text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    stride = limit - overlap
    at, kinds = boundaries(text, limit)
    ends = np.concatenate([at, [n]])
    penalty = np.array([*KINDS.values()])
    cost_of = np.concatenate([penalty[kinds], [0.0]])
    pieces = -(-(n - overlap) // stride)
    mean = (n + (pieces - 1) * overlap) / pieces
    best = np.full(len(ends), np.inf)
    back = np.full(len(ends), -1, dtype=np.int64)
    listed = ends.tolist()
    for i, e in enumerate(listed):
        if e <= limit:
            best[i] = cost_of[i] + BALANCE * ((e - mean) / limit) ** 2
        lo = bisect_left(listed, max(e - stride, overlap), 0, i)
        if lo < i:
            sizes = e - ends[lo:i] + overlap
            total = best[lo:i] + BALANCE * ((sizes - mean) / limit) ** 2
            j = int(total.argmin())
            if total[j] + cost_of[i] < best[i]:
                best[i], back[i] = total[j] + cost_of[i], lo + j
    names = [*KINDS]
    cuts, i = [], len(ends) - 1
    if not np.isfinite(best[i]):
        # only texts of combining characters longer than a piece come here: cut by length
        cuts = [(p, "none") for p in range(limit, n, stride)] + [(n, "end")]
    else:
        while i >= 0:
            cuts.append((listed[i], "end" if i == len(ends) - 1 else names[kinds[i]]))
            i = int(back[i])
        cuts.reverse()
    return [(0 if k == 0 else cuts[k - 1][0] - overlap, e, name) for k, (e, name) in enumerate(cuts)]


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, n_pieces, start_pos, end_pos, cut, piece): the pieces of every text.

    Texts within the limit come out as they are, without leaving the JVM; NULL gives no piece, an empty text one empty
    piece. Repeated rows come out repeated. Other columns of df are ignored. Offsets count code points from 0.
    """
    schema = "piece_no int, n_pieces int, start_pos bigint, end_pos bigint, cut string"
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, s in zip(pdf["_key"], pdf["_text"]):
                spans = split_spans(s, limit, overlap)
                rows.extend((k, i, len(spans), a, b, c, s[a:b]) for i, (a, b, c) in enumerate(spans, 1))
            yield pd.DataFrame(rows, columns=["_key", "piece_no", "n_pieces", "start_pos", "end_pos", "cut", "piece"])

    src = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    small = src.filter(F.length("_text") <= limit).select(
        "_key", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("bigint").alias("start_pos"), F.length("_text").cast("bigint").alias("end_pos"), F.lit("end").alias("cut"), F.col("_text").alias("piece")
    )
    large = src.filter(F.length("_text") > limit).mapInPandas(run, f"_key {kind}, {schema}, piece string")
    return small.unionByName(large).withColumnRenamed("_key", key)


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of full_text of paper and reference_record."""
    parts = [split_texts(read_table(spark, d, t), "row_id", "full_text").select(F.lit(t).alias("item_table"), F.col("row_id").alias("item_id"), "piece_no", "n_pieces", "start_pos", "end_pos", "cut", "piece") for t in ("paper", "reference_record")]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The items that had to be split: those with a second piece."""
    return p1_pieces(spark, d).filter("piece_no = 2").select("item_table", "item_id")


def p1_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every text put together again from its pieces, and the length of the longest piece."""
    new = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.substring("piece", OVERLAP + 1, LIMIT))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", new.alias("new"))))
    out = p1_pieces(spark, d).groupBy("item_table", "item_id").agg(parts.alias("p"), F.max(F.length("piece")).alias("longest"))
    return out.select("item_table", "item_id", F.sha2(F.array_join(F.transform("p", lambda x: x.new), ""), 256).alias("digest"), (F.col("longest") <= LIMIT).alias("within_limit"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_roundtrip": p1_roundtrip}
SQL = {
    "p1_roundtrip": """SELECT 'paper' AS item_table, row_id AS item_id, sha256(full_text) AS digest, true AS within_limit FROM paper WHERE full_text IS NOT NULL
UNION ALL SELECT 'reference_record', row_id, sha256(full_text), true FROM reference_record WHERE full_text IS NOT NULL""",
    "p1_found": """SELECT 'paper' AS item_table, row_id AS item_id FROM paper WHERE length(full_text) > 3000
UNION ALL SELECT 'reference_record', row_id FROM reference_record WHERE length(full_text) > 3000""",
}
