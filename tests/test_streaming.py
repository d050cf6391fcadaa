import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import drift
from tidepanel.session import fresh_path
from tidepanel.streaming import jobs as J

SCHEMA = "event_id BIGINT, ts TIMESTAMP, event_type STRING, value DOUBLE"
BARS = "asset STRING, bar_start TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, n BIGINT"


def write_batches(spark, parts=4, interleaved=False):
    rnd = random.Random(1)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i, seconds=rnd.randint(0, 59)), rnd.choice("AB"), float(rnd.randint(0, 5))) for i in range(400)]
    path = fresh_path(spark, "test-ticks")
    step = len(rows) // parts
    for k in range(parts):
        chunk = spark.createDataFrame(rows[k::parts] if interleaved else rows[k * step : (k + 1) * step], SCHEMA).coalesce(1)
        chunk.write.mode("append").parquet(path)
    return path


def batch(spark, path):
    return spark.read.parquet(path).selectExpr("event_type AS asset", "ts", "event_id", "value AS price")


@pytest.mark.parametrize("interleaved", [False, True])
def test_streamed_bars_equal_batch_bars(spark, interleaved):
    path = write_batches(spark, 4, interleaved)
    out, state = fresh_path(spark, "t-bars"), fresh_path(spark, "t-bars-state")
    ticks = J.event_ticks(spark, path, SCHEMA)
    J.drain(J.versioned_sink(J.streaming_bars(ticks), out, state))
    got = J.latest(spark, out, BARS, ["asset", "bar_start"])
    want = J.price_bars(batch(spark, path))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert spark.read.parquet(out).select("version").distinct().count() >= 2


def test_streamed_counters_equal_batch(spark):
    path = write_batches(spark)
    out, state = fresh_path(spark, "t-count"), fresh_path(spark, "t-count-state")
    J.drain(J.versioned_sink(J.quality_counters(J.event_ticks(spark, path, SCHEMA)), out, state))
    got = J.latest(spark, out, "asset STRING, n_rows BIGINT, n_zero BIGINT, last_seen TIMESTAMP", ["asset"])
    want = J.quality_counters(batch(spark, path))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_restart_reads_only_new_files(spark):
    path = write_batches(spark, 2)
    out, state = fresh_path(spark, "t-re"), fresh_path(spark, "t-re-state")
    run = lambda: J.drain(J.versioned_sink(J.quality_counters(J.event_ticks(spark, path, SCHEMA)), out, state))
    run()
    spark.createDataFrame([(9999, dt.datetime(2024, 3, 1), "A", 0.0)], SCHEMA).write.mode("append").parquet(path)
    run()
    got = J.latest(spark, out, "asset STRING, n_rows BIGINT, n_zero BIGINT, last_seen TIMESTAMP", ["asset"])
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in J.quality_counters(batch(spark, path)).collect()}


def test_drift_is_judged_with_the_days_before(spark):
    """Single-day batches, some of them twice: same findings as the tail in one piece."""
    rnd, day = random.Random(8), dt.date(2020, 1, 1)
    rows = [(a, day + dt.timedelta(days=k), rnd.gauss(0.001 if k < 60 else 0.02, 0.01)) for k in range(90) for a in "AB"]
    panel = spark.createDataFrame(rows, J.TAIL)
    baseline = drift.fingerprint(panel.where("date < '2020-02-15'"), "A")
    source, out, state = (fresh_path(spark, n) for n in ("t-ret", "t-alert", "t-alert-state"))
    for low, high in ((0, 80), (75, 85), (84, 85), (85, 90)):
        spark.createDataFrame(rows[2 * low : 2 * high], J.TAIL).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(J.TAIL).option("maxFilesPerTrigger", 1).parquet(source)
    J.drain(J.drift_alerts(stream, baseline, "A", out, state, tail=30))
    want = drift.violations(drift.fingerprint(panel, "A", 30), baseline)
    got = J.current_alerts(spark, out)
    key = lambda df: sorted(tuple(r) for r in df.select("type", "asset", F.round("delta", 6)).collect())
    assert key(got) == key(want) and key(got)
