"""Spark session settings the panel jobs are written for."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "tidepanel", **conf: str) -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter builds the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", os.environ.get("TIDEPANEL_DRIVER_MEMORY", "12g"))
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Rows that Spark hands a Python worker at a time where rows hold whole texts.
TEXT_BATCH_ROWS = 1024


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Have the session hand over at most ``rows`` rows at a time: an executor and its Python
    workers each hold a batch of every running task. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:  # 0 and less: no limit
        spark.conf.set(name, rows)


# Bytes that Spark hands a Python worker at a time where a row holds many values.
BATCH_BYTES = 4 << 20


def small_batch_bytes(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Have the session hand over a batch once it holds ``most`` bytes: an executor has
    several copies of a batch of every running task. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may go without one; it gets a folder under /tmp.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/tidepanel-shared"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidepanel/{name}-{uuid.uuid4().hex[:12]}"


# Parquet options where a row is large: a page and a group of rows end when they are full,
# not after the hundred rows that are else written before their size is looked at.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and gives the planner the
    real size on disk, so it broadcasts the result only when it is small.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Bytes a table may take in memory to be sent to every executor.
BROADCAST_BYTES = 128 << 20


def small_side(df: DataFrame, name: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Stage a table and mark it for broadcast only if its rows turn out to take few
    bytes; a larger one is left for the planner to join by shuffle."""
    staged = stage(df, name)
    row = sum(64 if t in ("string", "binary") or "<" in t else 8 for _, t in staged.dtypes) + 16
    return F.broadcast(staged) if staged.count() * row <= max_bytes else staged
