"""Incremental refresh: price bars, quality counters and drift checks.

Each job is the batch aggregation on a stream. Results go to a folder per micro-batch,
written with overwrite, so a batch that is replayed after a failure replaces itself;
readers take the newest version of every key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepanel.operators import drift
from tidepanel.operators.quality import last_rows_of_panel


def price_bars(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Open, high, low, close and tick count per (asset, window). Works on batch and
    streaming input; ties in time are settled by event_id."""
    at = F.struct("ts", "event_id")
    bars = ticks.groupBy("asset", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.count("*").alias("n"),
    )
    return bars.select("asset", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "n")


def streaming_bars(ticks: DataFrame, width: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """Bars of a stream. Without ``lateness`` every tick counts whenever it comes, and the
    state holds every bar; with it, bars older than that are closed and later ticks for
    them are lost, so it must exceed the disorder of the source (files of a backfill may
    be in any order)."""
    return price_bars(ticks.withWatermark("ts", lateness) if lateness else ticks, width)


def quality_counters(ticks: DataFrame) -> DataFrame:
    """Per asset: rows, zeros (NULL counts as zero) and the last event time. Counters
    only grow, so state is one row per asset."""
    zero = (F.coalesce("price", F.lit(0.0)) == 0.0).cast("long")
    return ticks.groupBy("asset").agg(
        F.count("*").alias("n_rows"), F.sum(zero).alias("n_zero"), F.max("ts").alias("last_seen")
    )


def with_flags(counters: DataFrame, as_of, stale_days: int = 30) -> DataFrame:
    """Zero share and staleness as of a given time."""
    return counters.withColumns(
        {
            "zero_pct": F.col("n_zero") / F.col("n_rows"),
            "stale": F.datediff(as_of, F.col("last_seen")) > stale_days,
        }
    )


def event_ticks(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Tick stream from a folder or glob of parquet files with an explicit schema."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))


def versioned_sink(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write every micro-batch's changed rows as a version of their own."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def latest(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key."""
    rows = spark.read.schema(f"{schema}, version INT").parquet(path)
    values = [n for n in rows.columns if n not in (*keys, "version")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("s")).select(*keys, "s.*")


TAIL_DAYS = 504
TAIL = "asset STRING, date DATE, ret DOUBLE"
ALERTS = "type STRING, asset STRING, delta DOUBLE, threshold DOUBLE"


def drift_alerts(
    returns: DataFrame, baseline: DataFrame, reference: str, path: str, checkpoint: str, tail: int = TAIL_DAYS, emit: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Check the last ``tail`` days of (asset, date, ret) against the baseline after each
    micro-batch. The days seen so far are carried from batch to batch in a table of at
    most ``tail`` days, so a batch of a single day is judged with its history; a day that
    comes again replaces itself. Each batch writes its tail and its findings as a version;
    a replayed batch starts from the version before it."""

    def check(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select("asset", "date", "ret").groupBy("asset", "date").agg(F.max("ret").alias("ret"))
        if batch_id:
            before = spark.read.schema(TAIL).parquet(f"{path}/tail/version={batch_id - 1}")
            new = new.unionByName(before.join(new, ["asset", "date"], "left_anti"))
        kept = f"{path}/tail/version={batch_id}"
        last_rows_of_panel(new, tail).select("asset", "date", "ret").write.mode("overwrite").parquet(kept)
        found = drift.violations(drift.fingerprint(spark.read.schema(TAIL).parquet(kept), reference), baseline)
        found = emit(found) if emit else found
        found.write.mode("overwrite").parquet(f"{path}/found/version={batch_id}")

    return (
        returns.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(check)
        .start()
    )


def current_alerts(spark: SparkSession, path: str) -> DataFrame:
    """What the newest batch found."""
    rows = spark.read.schema(f"{ALERTS}, version INT").parquet(f"{path}/found")
    newest = spark.read.schema(f"{TAIL}, version INT").parquet(f"{path}/tail").agg(F.max("version").alias("v")).scalar()
    return rows.where(F.col("version") == newest).drop("version")


def drain(query: StreamingQuery) -> None:
    """Wait for an available-now query and surface its failure, if any."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
