"""Mixing sources to target weights, as a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1] whose mean is its target share: linear, with the slopes
chosen so that the weights of all sources add up to 1 at every t. Its integral is the source's cumulative token demand.
Every use of a document stands for a stretch of its source's tokens; inverting the demand at the middle of that stretch
gives the use its training position, and a range sort by position gives the training order.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.ids import label_key
from quillmark.session import materialize, read_table

#: The tokenizer's vocabulary (ranks in base64) and its splitting pattern; the path is a parameter everywhere.
TOKENIZER = os.environ.get("QUILLMARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Steepest relative slope of a schedule, hash ranges a source is ordered in, and the most target rows that are accepted.
RAMP, RANGES, MAX_SOURCES = 0.5, 1024, 1000
_encodings: dict[str, object] = {}
_shipped: set[tuple[str, str]] = set()


def _ship(spark: SparkSession, path: str) -> None:
    """Give the vocabulary file to every executor, once per application."""
    app = (spark.sparkContext.applicationId, path)
    if app not in _shipped:
        _shipped.add(app)
        spark.sparkContext.addFile(path)


def encoding(path: str):
    """The tokenizer of a vocabulary file, built once per Python worker, from the copy that came with the job."""
    if path not in _encodings:
        import tiktoken

        own = SparkFiles.get(os.path.basename(path))
        with open(own if os.path.exists(own) else path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def with_tokens(df: DataFrame, key: str, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """(key, *keep, n_tokens): tokens of the whole text; NULL has none."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [key, *keep])
    _ship(df.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            pdf["n_tokens"] = [len(enc.encode_ordinary(s)) if s else 0 for s in pdf[text]]
            yield pdf[[key, *keep, "n_tokens"]]

    return df.select(key, *keep, text).mapInPandas(run, kinds + ", n_tokens bigint")


def schedules(shares: dict[str, float], ramp: float = RAMP) -> dict[str, float]:
    """Relative slopes: weight of a source at t is share * (1 + slope * (2t - 1)). Small sources rise, large ones fall.

    The slopes are centred by share, so the weights add up to the same at every t, and scaled to at most ramp.
    """
    if not shares:
        return {}
    raw = {s: -math.log(x) if x > 0 else 0.0 for s, x in shares.items()}
    total = sum(shares.values()) or 1.0
    mean = sum(shares[s] * raw[s] for s in shares) / total
    most = max(abs(raw[s] - mean) for s in shares) or 1.0
    return {s: ramp * (raw[s] - mean) / most for s in shares}


def plan(docs: DataFrame, targets: DataFrame, total: int | None = None, ramp: float = RAMP):
    """What the driver decides: per source share, tokens, demand and slope. Only sums per source come to the driver."""
    rows = targets.select(label_key(F.col("source")).alias("key"), "source", "target_share", "max_repeats").filter("key is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    want = {r.key: (r.source, float(r.target_share or 0), max(0, int(r.max_repeats or 0))) for r in reversed(rows)}
    have = {r.key: (r.t, r.n) for r in docs.filter(F.col("key").isin([*want])).groupBy("key").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()} if want else {}
    live = {k: w for k, w in want.items() if w[1] > 0 and w[2] > 0 and have.get(k, (0, 0))[0]}
    if total is None:
        total = math.floor(min((w[2] * have[k][0] / w[1] for k, w in live.items()), default=0))
        demand = {k: w[1] * total for k, w in live.items()}
    else:
        demand = demands({k: w[1] for k, w in live.items()}, {k: w[2] * have[k][0] for k, w in live.items()}, total)
    slopes = schedules({k: w[1] for k, w in live.items()}, ramp)
    return [(k, w[0], w[1], w[2], *(have.get(k, (0, 0))), float(demand.get(k, 0.0)), slopes.get(k, 0.0)) for k, w in want.items()], total


def demands(shares: dict[str, float], most: dict[str, float], total: float) -> dict[str, float]:
    """Tokens per source: a total by shares; what a source cannot give with all its repeats goes to the others by their shares."""
    out: dict[str, float] = {}
    rest = dict(shares)
    while rest:
        left, whole = total - sum(out.values()), sum(rest.values())
        full = [k for k, s in rest.items() if left * s / whole >= most[k]]
        if not full:
            return out | {k: left * s / whole for k, s in rest.items()}
        for k in full:
            out[k] = most[k]
            del rest[k]
    return out


def tokenized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, key, n_tokens): the distinct documents with tokens. A text delivered again counts once, by its smallest id per source."""
    src = documents.filter("text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), label_key(F.col("source")).alias("key"), "text")
    src = src.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    counted = with_tokens(src, "doc_id", "text", ["key", "h1", "h2"], path)
    return materialize(counted.groupBy("key", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens")).filter("n_tokens > 0").select("doc_id", "key", "n_tokens"), "tokens")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, ramp: float = RAMP, path: str = TOKENIZER, seed: int = 77, docs: DataFrame | None = None) -> DataFrame:
    """(position, doc_id, source, use_no, n_tokens): the mixture, range-sorted by training position in [0, 1].

    total: tokens of the mixture; by default the most at which every source with documents can fill its share. With a larger
    total, what a source cannot fill goes to the others by their shares. docs: the result of tokenized, if it is there. Sources
    without a target are left out; targets without documents get nothing (the report says so). A document is used at most
    max_repeats times. A use belongs to the mixture if its middle lies within the source's demand, so a source misses its
    demand by at most half a document. NULL and empty texts are never used; empty tables give an empty mixture.
    """
    docs = tokenized(documents, path) if docs is None else docs
    rows, _ = plan(docs, targets, total, ramp)
    spark = documents.sparkSession
    sources = F.broadcast(spark.createDataFrame(rows, "key string, source string, share double, repeats int, tokens bigint, n_docs bigint, demand double, slope double"))
    hashed = docs.join(sources, "key").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("range", F.shiftrightunsigned("h", 54).cast("int"))
    sizes = hashed.groupBy("key", "range").agg(F.sum("n_tokens").alias("k"))  # at most MAX_SOURCES x RANGES rows
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    inside = Window.partitionBy("key", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hashed.join(F.broadcast(offsets), ["key", "range"]).withColumn("upto", F.col("offset") + F.sum("n_tokens").over(inside))
    # only the uses whose middle lies within the demand are written out
    uses = F.least(F.col("repeats").cast("bigint"), F.floor((F.col("demand") - F.col("upto") + F.col("n_tokens") / 2) / F.col("tokens")) + 1)
    used = placed.withColumn("uses", uses).filter("uses > 0").withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    used = used.withColumn("middle", (F.col("use_no") - 1) * F.col("tokens") + F.col("upto") - F.col("n_tokens") / 2)
    # demand up to t is demand * (t + slope * (t^2 - t)); its inverse at x = middle / demand
    x, s = F.col("middle") / F.col("demand"), F.col("slope")
    t = 2 * x / ((1 - s) + F.sqrt((1 - s) * (1 - s) + 4 * s * x))
    out = used.select(t.alias("position"), "doc_id", "source", F.col("use_no").cast("int").alias("use_no"), "n_tokens")
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixture_report(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str = TOKENIZER) -> DataFrame:
    """Per target source: target_share, max_repeats, n_docs, available_tokens, n_uses, used_tokens, reached_share, is_short."""
    tokens = tokenized(documents, path)
    mixed = mix(documents, targets, total, path=path, docs=tokens).groupBy("source").agg(F.count(F.lit(1)).alias("n_uses"), F.sum("n_tokens").alias("used_tokens"), F.max("use_no").alias("most_uses"))
    mixed = materialize(mixed, "mixture")
    docs = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("available_tokens"))
    whole = mixed.agg(F.sum("used_tokens")).scalar()
    t = targets.select("source", label_key(F.col("source")).alias("key"), "target_share", "max_repeats")
    out = t.join(docs, "key", "left").join(mixed, "source", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_docs", "available_tokens", "n_uses", "used_tokens", "most_uses")}
    out = out.select("source", "target_share", "max_repeats", *zero.values())
    reached = F.coalesce(F.round(F.col("used_tokens") / whole, 6), F.lit(0.0))
    return out.withColumn("reached_share", reached).withColumn("is_short", F.col("reached_share") < F.col("target_share") - 0.005)


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(read_table(spark, d, "documents"), read_table(spark, d, "source_target"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture_report(read_table(spark, d, "documents"), read_table(spark, d, "source_target"))


QUERIES = {"p8_mixture": p8_mixture, "p8_report": p8_report}
SQL: dict[str, str] = {}
