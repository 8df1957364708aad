"""Evaluation texts leaking into training text, by latent semantic retrieval.

1. Every document becomes the terms it shares with the evaluation items (all others cannot add to a similarity with an
   item) and where they stand, counted in words, half a word for a character of scripts without blanks. Passages are
   windows of PASSAGE words, STRIDE apart: a run of up to STRIDE words lies wholly in one.
2. TF-IDF over all passages of the corpus; a distributed randomised SVD (range finder with power iterations, partial
   products summed on the executors) gives the latent space. Items' passages are rows of the matrix too, weighted so
   that the queries, not only the bulk of the corpus, shape the space.
3. Cosine search: a passage is compared with an item if it shares at least SHARED of the least weight any run of the item
   has (a bound from inverted lists of the items' rarer terms). A latent cosine of COSINE with a passage of the item makes
   a candidate (document, item), if a passage holds enough of a run and the document enough of its neighbouring words side
   by side, or if the document repeats enough telling terms. Items of a few words are too short for a cosine with a passage,
   so an item of fewer words than a run is also a candidate wherever a passage holds enough of it.
4. Check of each candidate over the whole document: longest run of consecutive words, longest common subsequence, and
   the share of the item's telling terms (names, codes, numbers) that the document repeats, for paraphrases.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.session import materialize, read_table, spread

#: Words of a document's passage and their distance; of an item's passage and their distance.
PASSAGE, STRIDE, ITEM_PASSAGE, ITEM_STRIDE = 24, 12, 12, 4
RANK, OVERSAMPLE, POWER, COSINE = 192, 16, 1, 0.42
#: Share of a run's weight that a passage must hold for a cosine; shares of its weight and of its neighbouring words that tell
#: a run itself (with slack for words that are parted otherwise); terms in more than this share of the items are common.
SHARED, SHARED_RUN, SIDE_BY_SIDE, COMMON = 0.3, 0.6, 0.4, 0.05
#: Words (characters for Chinese items) of a run that count as a leak; bounds of what is sent to every executor.
RUN_WORDS, RUN_CHARS, MAX_ITEMS, MAX_TERMS = 12, 24, 5_000, 120_000
#: A paraphrase: at least this share of the item's words in order and of its telling terms (those it has).
LCS_SHARE, ANSWER_SHARE = 0.6, 0.6
#: Terms of passages that are multiplied at a time.
BLOCK = 12_000

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_DENSE = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]")


def reader_form(text: str) -> str:
    """The text as a reader sees it: typographic forms folded, case dropped, nothing invisible."""
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).casefold()


_SPLIT = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]+|[^぀-ヿ㐀-䶿一-鿿豈-﫿]+")


def units(text: str) -> list[str]:
    """Words; of runs of Chinese or Japanese characters, each pair of neighbours."""
    out = []
    for w in _WORD.findall(_BROKEN.sub("", reader_form(text))):
        if not _DENSE.search(w):
            out.append(w)
            continue
        for part in _SPLIT.findall(w):
            if _DENSE.match(part):
                out.extend(part[i:i + 2] for i in range(max(1, len(part) - 1)))
            else:
                out.append(part)
    return out


def placed(text: str) -> Iterator[tuple[str, float]]:
    """The units of a text with where they stand, in words. A word with marks inside, as one broken at a line's end, comes in
    its parts and as a whole, as the item may have it either way."""
    form, at, before = _BROKEN.sub("-", reader_form(text)), 0.0, ""
    dense = _DENSE.search(form) is not None
    for token in form.split():
        if token.isalnum() and not dense:
            yield token, at
            at += 1
            continue
        parts = _WORD.findall(token)
        if len(parts) > 1:
            yield "".join(parts), at
        if not (dense and _DENSE.search(token)):
            for w in parts:
                yield w, at
            at += 1.0 if parts else 0.0
            before = ""
            continue
        for part in (x for w in parts for x in _SPLIT.findall(w)):
            if _DENSE.match(part):
                if before and _DENSE.match(before[-1]):  # neighbours across punctuation or a line's end
                    yield before[-1] + part[0], max(0.0, at - 0.5)
                for i in range(max(1, len(part) - 1)):
                    yield part[i:i + 2], at + i / 2
            else:
                yield part, at
                if before and before[-1].isdigit() and part[0].isdigit():  # decimals
                    yield before + part, max(0.0, at - len(before) / 2)
            at, before = at + len(part) / 2, part


def letters(text: str) -> tuple[str, set[int]]:
    """The letters and digits of a text in reader form without anything between them, and where words begin."""
    out, starts, at = [], set(), 0
    for m in _WORD.finditer(reader_form(text)):
        out.append(m.group())
        starts.add(at)
        at += len(m.group())
    starts.add(at)
    return "".join(out), starts


class Item:
    """An evaluation item, prepared for the check."""

    def __init__(self, item_id: int, text: str, lang: str | None):
        self.item_id = item_id
        self.words = [w for x in reader_form(text).split() if (w := "".join(_WORD.findall(x)))]
        self.stream = "".join(self.words)
        self.dense = (lang or "").casefold()[:2] == "zh" or len(_DENSE.findall(self.stream)) > len(self.stream) / 3
        self.units = units(text)
        self.placed = [*placed(text)]
        self.telling = {u for u in self.units if any(c.isdigit() for c in u) or (len(u) > 9 and not _DENSE.search(u))}
        # every shortest run that counts, for a quick look before the run is measured
        self.size, self.least = (len(self.stream), RUN_CHARS) if self.dense else (len(self.words), RUN_WORDS)
        k, seq = min(self.least, self.size), self.stream if self.dense else self.words
        self.pieces = {"".join(seq[p:p + k]) for p in range(self.size - k + 1)}
        masks: dict[str, int] = {}
        for i, u in enumerate(self.units):
            masks[u] = masks.get(u, 0) | 1 << i
        self.masks = masks

    def run(self, stream: str, starts: set[int]) -> int:
        """The longest run of consecutive words (characters of dense items) of the item in a document's letters."""
        best = 0
        if self.dense:
            s = self.stream
            for p in range(len(s)):
                while p + best < len(s) and s[p:p + best + 1] in stream:
                    best += 1
            return best
        n = len(self.words)
        for p in range(n):
            while p + best < n:
                piece, at = "".join(self.words[p:p + best + 1]), 0
                while (at := stream.find(piece, at)) >= 0 and not (at in starts and at + len(piece) in starts):
                    at += 1
                if at < 0:
                    break
                best += 1
        return best

    def common(self, us: list[str]) -> int:
        """Length of the longest common subsequence with a list of units (bit-parallel)."""
        n, full = len(self.units), (1 << len(self.units)) - 1
        v = full
        for u in us:
            if m := self.masks.get(u):
                x = v & m
                v = ((v + x) | (v - x)) & full
        return n - bin(v).count("1")


def load_items(items: DataFrame) -> list[Item]:
    """The items with text, at most MAX_ITEMS (ValueError beyond): the evaluation set is bounded and goes to every executor."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text", "lang").filter("text is not null").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} evaluation items")
    return [x for r in rows if (x := Item(r.item_id, r.text, r.lang)).stream]


def in_windows(doc: np.ndarray, at: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """For terms of texts (sorted by text) and where they stand: the window each falls into and the term's index, once per
    window; windows are numbered over all texts in order. The last windows of a text that lie within the one before are left out."""
    at = at.astype(np.int64)
    last = np.zeros(doc.max() + 1 if len(doc) else 0, dtype=np.int64)
    np.maximum.at(last, doc, at)
    number = np.maximum(0, -(-(last + 1 - size) // stride)) + 1
    base = np.r_[0, np.cumsum(number)]
    rows, terms = [], []
    for back in range(-(-size // stride)):
        k = at // stride - back
        ok = (k >= 0) & (k < number[doc]) & (at < k * stride + size)
        rows.append((base[doc] + k)[ok])
        terms.append(np.flatnonzero(ok))
    row, term = np.concatenate(rows), np.concatenate(terms)
    order = np.argsort(row, kind="stable")
    return row[order], term[order]


def shared_terms(documents: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, terms, at): what each document shares with the vocabulary and where; documents that share nothing are left out."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for pdf in batches:
            ids, terms, at = [], [], []
            for d, s in zip(pdf["doc_id"], pdf["text"]):
                hits = [(known[u], x) for u, x in placed(s) if u in known]
                if hits:
                    t, x = zip(*hits)
                    ids.append(d)
                    terms.append(np.array(t, dtype=np.int32))
                    at.append(np.array(x).astype(np.int32))
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "terms": pd.Series(terms, dtype=object), "at": pd.Series(at, dtype=object)})

    src = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null and text <> ''")
    return spread(src).mapInPandas(run, "doc_id bigint, terms array<int>, at array<int>")


def _blocks(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """The passages of a batch of shared_terms, some BLOCK terms at a time: rows of the batch, term and passage of every
    entry, number of passages. owner[i] is the row of the batch that passage i belongs to."""
    sizes = pdf["terms"].map(len).to_numpy() if len(pdf) else np.zeros(0, dtype=int)
    begin = 0
    while begin < len(pdf):
        end, total = begin, 0
        while end < len(pdf) and (end == begin or total + sizes[end] <= BLOCK):
            total += sizes[end]
            end += 1
        doc = np.repeat(np.arange(end - begin), sizes[begin:end])
        term, at = (np.concatenate(pdf[c].iloc[begin:end].tolist()) for c in ("terms", "at"))
        row, entry = in_windows(doc, at, PASSAGE, STRIDE)
        n = int(row[-1]) + 1 if len(row) else 0
        owner = np.zeros(n, dtype=np.int64)
        owner[row] = begin + doc[entry]
        yield owner, term[entry], row, n
        begin = end


def _weights(row: np.ndarray, term: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF (log tf) of n passages, each of length 1: passage, term and weight of every distinct entry."""
    key, tf = np.unique(row * np.int64(len(idf)) + term, return_counts=True)
    row, term = key // len(idf), key % len(idf)
    w = (1 + np.log(tf)) * idf[term]
    norm = np.sqrt(np.bincount(row, w * w, minlength=n))
    return row, term, (w / np.maximum(norm[row], 1e-12)).astype(np.float32)


def _times(row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """A @ basis for the sparse A of _weights (entries sorted by row)."""
    out = np.zeros((n, basis.shape[1]), dtype=np.float32)
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(basis[term] * w[:, None], first, axis=0)
    return out


def _transposed_times(row: np.ndarray, term: np.ndarray, w: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of A.T @ z that are not zero: their terms and values."""
    order = np.argsort(term, kind="stable")
    row, term, w = row[order], term[order], w[order]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    return term[first], np.add.reduceat(z[row] * w[:, None], first, axis=0)


def _document_frequencies(rows: DataFrame, n_terms: int) -> tuple[int, np.ndarray]:
    """The number of passages, and of those with each term."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, passages = np.zeros(n_terms, dtype=np.int64), 0
        for pdf in batches:
            for _, term, row, n in _blocks(pdf):
                passages += n
                total += np.bincount(np.unique(row * np.int64(n_terms) + term) % n_terms, minlength=n_terms)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.r_[-1, used].astype(np.int32), "c": np.r_[passages, total[used]]})

    df, n = np.zeros(n_terms), 0
    for r in rows.mapInPandas(run, "term int, c bigint").groupBy("term").agg(F.sum("c").alias("c")).collect():  # at most MAX_TERMS rows
        if r.term < 0:
            n = r.c
        else:
            df[r.term] = r.c
    return n, df


def _gram_times(rows: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """(A.T A) @ basis over all passages; each task sums its part, the sums per term are added up by a shuffle."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((idf, basis))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf_, basis_ = shared.value
        total = np.zeros_like(basis_)
        for pdf in batches:
            for _, term, row, n in _blocks(pdf):
                row, term, w = _weights(row, term, n, idf_)
                t, v = _transposed_times(row, term, w, _times(row, term, w, n, basis_))
                total[t] += v
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pd.DataFrame({"term": used.astype(np.int32), "v": pd.Series([*total[used]], dtype=object)})

    k = basis.shape[1]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            for t, v in zip(pdf["term"], pdf["v"]):
                acc[t] = acc[t] + v if t in acc else np.array(v, dtype=np.float64)
        yield pd.DataFrame({"term": pd.Series([*acc], dtype="int32"), "v": pd.Series([x.astype(np.float32) for x in acc.values()], dtype=object)})

    # every task's sum is as large as the basis, so there are at most as many tasks as cores; reducers share the terms
    parts = rows.coalesce(spark.sparkContext.defaultParallelism).mapInPandas(run, "term int, v array<float>")
    summed = parts.repartition("term").mapInPandas(add, "term int, v array<float>")
    out = np.zeros((len(idf), k), dtype=np.float64)
    for r in summed.toLocalIterator():  # at most MAX_TERMS rows of k numbers
        out[r.term] = r.v
    return out


class LatentSpace:
    """Vocabulary, idf and basis fitted on all passages, the items' passages in it, and what a passage must share with an item."""

    def __init__(self, documents: DataFrame, items: list[Item], rank: int = RANK, power: int = POWER, seed: int = 5):
        terms = sorted({u for it in items for u, _ in it.placed})
        if len(terms) > MAX_TERMS:
            raise ValueError(f"the items have more than {MAX_TERMS} terms")
        vocabulary = {t: i for i, t in enumerate(terms)}
        self.rows = materialize(shared_terms(documents, vocabulary), "terms")
        self.telling = [frozenset(vocabulary[t] for t in it.telling if t in vocabulary) for it in items]
        n, df = _document_frequencies(self.rows, len(terms))
        self.idf = np.log((n + 1) / (df + 1)) + 1
        doc = np.repeat(np.arange(len(items)), [len(it.placed) for it in items])
        term = np.array([vocabulary[u] for it in items for u, _ in it.placed], dtype=np.int64)
        at = np.array([x for it in items for _, x in it.placed])
        row, entry = in_windows(doc, at, ITEM_PASSAGE, ITEM_STRIDE)
        own = int(row[-1]) + 1
        self.owners = np.zeros(own, dtype=np.int64)
        self.owners[row] = doc[entry]
        self._bounds(items, doc, term, at)
        row, term, w = _weights(row, term[entry], own, self.idf)
        rng = np.random.default_rng(seed)
        size = min(rank + OVERSAMPLE, len(terms))
        basis = rng.standard_normal((len(terms), size)).astype(np.float32)
        weight = max(1.0, n / own)
        for step in range(power + 1):
            y = _gram_times(self.rows, self.idf, basis)
            t, v = _transposed_times(row, term, w, _times(row, term, w, own, basis))
            y[t] += weight * v
            if step < power:
                basis = np.linalg.qr(y)[0].astype(np.float32)
        # the left singular vectors of the last product, by energy, are the latent directions
        self.basis = np.linalg.svd(y, full_matrices=False)[0][:, :rank].astype(np.float32)
        self.queries = _unit(_times(row, term, w, own, self.basis))

    def _bounds(self, items: list[Item], doc: np.ndarray, term: np.ndarray, at: np.ndarray) -> None:
        """Inverted lists of the items' rarer terms, and per item the least weight of them that a run which counts has. An
        item with runs of common terms only is listed with all its terms."""
        common = np.bincount(np.unique(doc * np.int64(len(self.idf)) + term) % len(self.idf), minlength=len(self.idf)) > max(1.0, COMMON * len(items))
        self.need, self.short = np.zeros(len(items)), np.array([it.size < it.least for it in items])
        self.pairs, self.least_pairs = [], np.zeros(len(items))
        pairs: list[tuple[int, int]] = []
        for i in range(len(items)):
            t, x = term[doc == i], at[doc == i]
            begins = [p for p in np.unique(x) if p == 0 or p + STRIDE <= x.max() + 1]
            self.pairs.append(frozenset((t[:-1] * np.int64(len(self.idf)) + t[1:]).tolist()))
            self.least_pairs[i] = SIDE_BY_SIDE * min(len(np.unique((t[:-1] * np.int64(len(self.idf)) + t[1:])[(x[:-1] >= p) & (x[1:] < p + STRIDE)])) for p in begins)
            for kept in (~common[t], np.ones(len(t), dtype=bool)):
                runs = [np.unique(t[kept & (x >= p) & (x < p + STRIDE)]) for p in begins]
                self.need[i] = min(self.idf[r].sum() for r in runs)
                if self.need[i] > 0:
                    break
            pairs.extend((k, i) for k in np.unique(t[kept]).tolist())
        lists = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.list_items = lists[:, 1]
        self.list_from = np.searchsorted(lists[:, 0], np.arange(len(self.idf) + 1))

    def neighbours(self, terms: np.ndarray) -> set[int]:
        """The pairs of neighbouring units of a document."""
        t = np.asarray(terms, dtype=np.int64)
        return set((t[:-1] * len(self.idf) + t[1:]).tolist())

    def searcher(self) -> "LatentSpace":
        """What the executors need of it."""
        out = object.__new__(LatentSpace)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k != "rows"}
        return out

    def search(self, row: np.ndarray, term: np.ndarray, n: int, cosine: float) -> tuple[np.ndarray, ...]:
        """The pairs of a passage and an item that are candidates, with their cosine and the share of a run's weight held."""
        seen = np.unique(row * np.int64(len(self.idf)) + term)
        r, t = seen // len(self.idf), seen % len(self.idf)
        many = self.list_from[t + 1] - self.list_from[t]
        begin = np.repeat(self.list_from[t] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        key, where = np.unique(np.repeat(r, many) * len(self.need) + self.list_items[begin], return_inverse=True)
        held = np.bincount(where, np.repeat(self.idf[t], many), minlength=len(key))
        share = held / self.need[key % len(self.need)]
        key, share = key[share >= SHARED], share[share >= SHARED]
        passage, item = key // len(self.need), key % len(self.need)
        if not len(key):
            return passage, item, np.zeros(0), share
        alike, number = np.unique(passage, return_inverse=True)
        mine = np.isin(row, alike)
        row2, term2, w = _weights(np.searchsorted(alike, row[mine]), term[mine], len(alike), self.idf)
        sims = self.queries @ _unit(_times(row2, term2, w, len(alike), self.basis)).T
        best = np.maximum.reduceat(sims, np.flatnonzero(np.r_[True, self.owners[1:] != self.owners[:-1]]), axis=0)[item, number]
        ok = (best >= cosine) | self.short[item] & (share >= SHARED_RUN)
        return passage[ok], item[ok], best[ok], share[ok]


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def candidates(space: LatentSpace, cosine: float = COSINE) -> DataFrame:
    """(doc_id, items, cosines): the items each document may hold, as numbers, by the cosine search."""
    shared = space.rows.sparkSession.sparkContext.broadcast(space.searcher())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space_ = shared.value
        for pdf in batches:
            hits: dict[tuple[int, int], tuple[float, float]] = {}
            for owner, term, row, n in _blocks(pdf):
                for p, i, c, share in zip(*(x.tolist() for x in space_.search(row, term, n, cosine))):
                    key = (int(owner[p]), i)
                    hits[key] = tuple(map(max, (c, share), hits.get(key, (-1.0, 0.0))))
            ids, terms, rows, known = pdf["doc_id"].to_numpy(), pdf["terms"].to_numpy(), [], {}
            for (k, i), (c, share) in hits.items():
                if k not in known:
                    known[k] = set(terms[k].tolist()), space_.neighbours(terms[k])
                mine, beside = known[k]
                if (share >= SHARED_RUN and len(space_.pairs[i] & beside) >= space_.least_pairs[i]) or len(space_.telling[i] & mine) >= ANSWER_SHARE * len(space_.telling[i]):
                    rows.append((ids[k], i, c))
            yield pd.DataFrame(rows, columns=["doc_id", "item", "cosine"]).astype({"doc_id": "int64", "item": "int32", "cosine": "float64"})

    found = space.rows.mapInPandas(run, "doc_id bigint, item int, cosine double")
    # a document delivered in several rows is one; its items are at most MAX_ITEMS
    best = found.groupBy("doc_id", "item").agg(F.max("cosine").alias("cosine"))
    return materialize(best.groupBy("doc_id").agg(F.collect_list(F.struct("item", "cosine")).alias("hits")), "candidates")


def leaks(documents: DataFrame, items: DataFrame, cosine: float = COSINE, rank: int = RANK) -> DataFrame:
    """(item_id, doc_id, cosine, run, item_size, lcs_share, answer_share, kind): every document with a passage of an item.

    run: longest run of consecutive words of the item (characters of Chinese items), item_size: all it has. kind: ``whole``,
    ``part`` (a run of RUN_WORDS or RUN_CHARS at least, or a shorter item as a whole) or ``paraphrase`` (no such run, but the
    shares of words in order and of telling terms reach LCS_SHARE and ANSWER_SHARE; an item without telling terms is decided
    by its words). NULL and empty texts contain nothing; redelivered documents come out each; whole texts are read, however
    long; empty tables give no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    listed = load_items(items)
    schema = "item_id bigint, doc_id bigint, cosine double, run int, item_size int, lcs_share double, answer_share double, kind string"
    if not listed:
        return spark.createDataFrame([], schema)
    hits = candidates(LatentSpace(documents, listed, rank), cosine)
    shared = spark.sparkContext.broadcast(listed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for d, s, hs in zip(pdf["doc_id"], pdf["text"], pdf["hits"]):
                doc = Document(s)
                found.extend(checked(shared.value[h["item"]], d, h["cosine"], doc) for h in hs)
            yield pd.DataFrame([f for f in found if f[-1]], columns=["item_id", "doc_id", "cosine", "run", "item_size", "lcs_share", "answer_share", "kind"])

    src = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null and text <> ''")
    return src.join(hits, "doc_id").mapInPandas(run, schema)


class Document:
    """A document for the check; its units are looked for only when needed."""

    def __init__(self, text: str):
        self.text = text
        self.stream, self.starts = letters(text)

    @cached_property
    def units(self) -> list[str]:
        return units(self.text)

    @cached_property
    def known(self) -> set[str]:
        return set(self.units)


def checked(it: Item, doc_id: int, cosine: float, doc: Document) -> tuple:
    """The check of one candidate over the whole document; kind is "" if it does not hold."""
    kind, run, lcs, answer = "", 0, 0.0, 0.0
    if any(p in doc.stream for p in it.pieces):
        run = it.run(doc.stream, doc.starts)
        kind = "whole" if run == it.size else "part" if run >= it.least else ""
    # a unit of the document is part of its letters, so this share is no smaller than that of its units
    if kind or sum(t in doc.stream for t in it.telling) >= ANSWER_SHARE * len(it.telling):
        answer = len(it.telling & doc.known) / len(it.telling) if it.telling else 1.0
        if kind or answer >= ANSWER_SHARE:
            lcs = it.common(doc.units) / len(it.units)
        if not kind and answer >= ANSWER_SHARE and lcs >= LCS_SHARE:
            kind, run = "paraphrase", run or it.run(doc.stream, doc.starts)
    return it.item_id, doc_id, round(float(cosine), 6), run, it.size, round(lcs, 6), round(answer, 6), kind


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_item"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).filter("kind in ('whole', 'part')").select("item_id", "doc_id")


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks}
SQL: dict[str, str] = {}
