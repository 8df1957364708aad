"""Sources (SRC6-SRC16): JSON lines, CSV, JSON documents, manifests, memo tables, archives."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from quillmark.functions.text import pipe_split
from quillmark.operators.jats import parse_articles
from quillmark.session import ship_package

LIST_COLUMNS = ("article_types", "source_categories")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, a missing path is an error (SRC7)."""
    schema = spark.read.json(path).schema if schema is None else schema
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*$"))
    return lines.select(F.from_json("value", schema).alias("_d")).select("_d.*")


def read_jsonl_if_exists(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, or no rows where the path does not exist (SRC8)."""
    try:
        return read_jsonl(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_csv_rows(spark: SparkSession, path: str, lists: tuple[str, ...] = LIST_COLUMNS) -> DataFrame:
    """CSV with header, byte-order mark, quoted line breaks and fields of any size; piped lists decoded (SRC9, SRC10)."""
    df = spark.read.options(header=True, multiLine=True, escape='"', maxCharsPerColumn=-1, encoding="UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*[pipe_split(F.col(c)).alias(c) if c in lists else F.col(c) for c in df.columns])


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document per file, byte-order mark tolerated (SRC11)."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    schema = text.agg(F.schema_of_variant_agg(F.parse_json("value"))).first()[0]
    return text.select(F.from_json("value", schema.replace("OBJECT<", "STRUCT<")).alias("d")).select("d.*")


def read_manifest(spark: SparkSession, csv_path: str, json_path: str) -> DataFrame:
    """The CSV manifest if it exists, else packages[] of the JSON one (SRC12)."""
    try:
        return read_csv_rows(spark, csv_path, ())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return read_json_document(spark, json_path).select(F.inline("packages"))


def memo_prefix(memo: DataFrame, prefix: str) -> DataFrame:
    """Memo rows whose key has a prefix, with the rest of the key as id (SRC14)."""
    return memo.filter(F.col("key").startswith(prefix)).withColumn("id", F.split_part(F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key")), F.lit(":"), F.lit(1)))


def safe_member(name: str) -> bool:
    """Whether an archive member stays below the directory it is extracted to (VA11)."""
    p = PurePosixPath(name.replace("\\", "/"))
    return not p.is_absolute() and ".." not in p.parts and ":" not in (p.parts[0] if p.parts else "")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, base, content, safe): the files of .tgz archives; unsafe ones come without content (SRC13).

    An archive that cannot be read gives one row with a NULL member.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                        for m in t:
                            if m.isfile():
                                ok = safe_member(m.name)
                                rows.append((p, m.name, PurePosixPath(m.name).name.lower(), t.extractfile(m).read() if ok else None, ok))
                except (tarfile.TarError, EOFError, OSError):
                    rows = [(p, None, None, None, False)]
                yield pd.DataFrame(rows, columns=["archive", "member", "base", "content", "safe"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, base string, content binary, safe boolean")


def article_member(members: DataFrame) -> DataFrame:
    """(archive, member, xml): the first XML member, by name, that has article metadata (SRC16)."""
    x = members.filter(F.col("base").rlike(r"\.n?xml$") & F.col("content").isNotNull()).withColumn("xml", F.decode("content", "UTF-8"))
    return x.filter(F.contains("xml", F.lit("<article-meta"))).groupBy("archive").agg(F.min("member").alias("member"), F.min_by("xml", "member").alias("xml"))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Parsed JATS files, one row per file that holds an article, with its path (SRC6)."""
    ship_package(spark)
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("xml"))
    return parse_articles(files, "file", "xml")
