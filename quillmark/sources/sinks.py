"""Sinks (SNK1-SNK11)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.text import pipe_join


#: Ending of the path a table is set aside at while it is replaced.
ASIDE = ".aside"


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; mode append for a durable log whose files appear when complete (SNK1, SNK4, SNK5)."""
    df.write.mode(mode).json(path)


def flat(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df as CSV can hold it: the given columns (absent ones empty), text lists piped, other nested values as JSON (SNK2)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in columns or df.columns:
        t = kinds.get(c)
        if t is None:
            out.append(F.lit(None).cast("string").alias(c))
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            out.append(pipe_join(F.col(c)).alias(c))
        elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    flat(df, columns).write.mode("overwrite").options(header=True, escape='"', quoteAll=False).csv(path)


def write_csv_union(dfs: list[DataFrame], path: str, header: str = "pmcid") -> None:
    """The union of tables with differing columns, its header sorted; of no tables, a header of one column (SNK3)."""
    dfs = dfs or [SparkSession.active().createDataFrame([], f"{header} string")]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [flat(x) for x in dfs])
    both.select(*sorted(both.columns)).write.mode("overwrite").options(header=True, escape='"').csv(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table as a whole (SNK6): written beside it, the old one renamed aside, the new one into its place, and only
    then the old one deleted. Whenever it breaks off, one of the two is there whole; restore_table puts it back."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    new, old, aside = at(f"{path}-{uuid.uuid4().hex}"), at(path), at(path + ASIDE)
    restore_table(spark, path)
    df.write.parquet(new.toString())
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(new, old):
        restore_table(spark, path)
        raise OSError(f"{new} could not be renamed to {path}")
    fs.delete(aside, True)


def restore_table(spark, path: str) -> bool:
    """Put back a table that a broken-off replacement has set aside; whether there was one to put back."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    old, aside = at(path), at(path + ASIDE)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(aside):
        return False
    if fs.exists(old):  # the new table got into its place
        fs.delete(aside, True)
        return False
    return fs.rename(aside, old)


def write_by_category(df: DataFrame, categories: DataFrame, column: str, path: str) -> None:
    """One folder per category, those without rows included as one row of NULLs marked _empty (SNK7)."""
    all_ = categories.select(column).distinct().join(df, column, "left")
    marker = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in df.columns if c != column], F.lit(True))
    all_.withColumn("_empty", marker).write.mode("overwrite").partitionBy(column).json(path)


def write_sealed(df: DataFrame, sealed_columns: list[str], key: list[str], open_path: str, sealed_path: str) -> None:
    """The open columns and, at a path of its own, the sealed ones with the key (SNK9)."""
    if sealed_path.startswith(open_path) or open_path.startswith(sealed_path):
        raise ValueError("the sealed path must lie apart from the open one")
    df.drop(*sealed_columns).write.mode("overwrite").parquet(open_path)
    df.select(*key, *sealed_columns).write.mode("overwrite").parquet(sealed_path)


def write_summary(df: DataFrame, path: str) -> None:
    """A small table, one JSON file (SNK10)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_packages(tables: dict[str, DataFrame], path: str, key: str = "package_id") -> None:
    """Packages as related tables, each partitioned by nothing but keyed by the package, instead of a folder per paper (SNK8)."""
    missing = [n for n, t in tables.items() if key not in t.columns]
    if missing:
        raise ValueError(f"tables without {key}: {missing}")
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def snapshot(source: str, target: str, spark) -> None:
    """A copy of an input beside the results, for provenance (SNK11); an existing one is an error."""
    jvm = spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    conf = spark._jsc.hadoopConfiguration()
    fs = b.getFileSystem(conf)
    if fs.exists(b):
        raise FileExistsError(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, fs, b, False, conf)
