"""Resumable incremental runs as a stream: a file source, an upsert per micro-batch, the checkpoint as the log of what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmark.operators.identity import upsert


#: Parts of the state; a micro-batch rewrites only those its keys fall into.
BUCKETS = 64


def _parts(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The newest folder of every part: each version is a folder with the parts that changed, complete once marked so."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    root = at(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, str] = {}
    names = sorted(f.getPath().getName() for f in fs.listStatus(root)) if fs.exists(root) else []
    for name in names:
        if (before is None or int(name[1:]) < before) and fs.exists(at(f"{path}/{name}/_SUCCESS")):
            for f in fs.listStatus(at(f"{path}/{name}")):
                part = f.getPath().getName()
                if part.startswith("_part="):
                    found[int(part.partition("=")[2])] = f"{path}/{name}/{part}"
    return found


def state_of(spark: SparkSession, path: str, schema, parts: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The state: the newest version of every part, or of the given ones, or as it was before a version."""
    found = [p for k, p in sorted(_parts(spark, path, before).items()) if parts is None or k in parts]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def upsert_stream(source: DataFrame, state_path: str, checkpoint: str, keys: list[str], order: list[str], available_now: bool = True) -> StreamingQuery:
    """Keep the last row of every key of a stream in a versioned table of BUCKETS parts.

    A batch that is run again after a failure starts from the state before it and writes the same version again, so the
    state is the same as without the failure.
    """
    schema = source.schema
    part = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(BUCKETS)).cast("int")

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        touched = [r.p for r in batch.select(part.alias("p")).distinct().collect()]  # at most BUCKETS rows
        old = state_of(spark, state_path, schema, touched, number)
        new = upsert(old, batch, keys, order).select(*schema.names).withColumn("_part", part)
        new.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{state_path}/v{number:012d}")
        batch.unpersist()

    w = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def pending(requests: DataFrame, state: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Requests without a current result: the anti join behind resuming (FLT10, FLT11)."""
    done = state if version is None else state.filter(F.col("version") == version)
    return requests.join(done.select(*keys).distinct(), keys, "left_anti")
