"""Session factory, shared-folder handling and table reading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_written: dict[str, list[str]] = {}
_blocks = threading.local()


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings this engine is tested under."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUILLMARK_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one where that is unset in a local run (tests). A
    cluster without it is an error, as no folder of one machine would do."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="quillmark-shared-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def table_path(spark: SparkSession, name: str) -> str:
    """Where a new table may stand in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "stage", path: str | None = None) -> DataFrame:
    """Cut the lineage of df with a table written to the shared folder.

    The table survives the loss of executors, is columnar and compressed, and is read back with column pruning and
    statistics of its size, which Spark's join planning then uses. path: of a table that df is added to.
    """
    spark = df.sparkSession
    at = path or table_path(spark, name)
    if path is None and getattr(_blocks, "open", None):
        _blocks.open[-1].append(at)
    df.write.mode("append" if path else "errorifexists").option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize writes in this block, but those at a given path, are deleted at its end. Shuffle files of each
    go as soon as it stands; outside, they stay until the driver collects its garbage."""
    conf, blocks = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", _blocks.__dict__.setdefault("open", [])
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, "true")
    blocks.append([])
    try:
        yield
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
        gone = blocks.pop()
        written = _written.get(spark.sparkContext.applicationId, [])
        written[:] = [p for p in written if p not in gone]
        _delete(spark, gone)


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """df with enough partitions to keep all cores busy in a costly Python stage.

    Only a table of few partitions (a few large files) is redistributed; a large one comes in many splits and stays as it is.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def release(spark: SparkSession) -> int:
    """Delete the tables materialize wrote for this application; results not yet written out must not depend on them. Returns their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillmark-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/quillmark-package.zip", "w") as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.join("quillmark", os.path.relpath(os.path.join(at, f), root)))
    spark.sparkContext.addPyFile(f"{folder}/quillmark-package.zip")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
