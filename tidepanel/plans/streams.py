"""Registered streaming queries: each drains a stream over the given tables, and its
SQL twin states the same result in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.expr import rnd
from tidepanel.plans import parameters as K
from tidepanel.plans.alignment import returns
from tidepanel.plans.registry import RETS, ctes, query, r
from tidepanel.plans.statistics import BASE_FP, FP, VIOL, baseline_fingerprint
from tidepanel.session import fresh_path
from tidepanel.sources import panels as P
from tidepanel.streaming import jobs as J

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
BARS = "asset STRING, bar_start TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, n BIGINT"

BARS_SQL = """WITH t AS (SELECT event_type AS asset, date_trunc('hour', ts) AS b, value, row_number() OVER w AS first, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS last
 FROM events WINDOW w AS (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id))
SELECT asset, strftime(b, '%Y-%m-%d %H:%M:%S') AS bar_start, max(value) FILTER (first = 1) AS open, max(value) AS high, min(value) AS low, max(value) FILTER (last = 1) AS close, count(*) AS n FROM t GROUP BY asset, b"""


def _text(bars):
    return bars.withColumn("bar_start", F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss"))


@query("str_01_price_bars", BARS_SQL)
def str_01(spark, sf):
    return _text(J.price_bars(P.ticks(spark, sf)))


def interleaved_events(spark, sf, files=3):
    """All events, dealt over several files that each span the whole time."""
    path = fresh_path(spark, "events")
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.repartition(files, F.pmod(F.xxhash64("event_id"), F.lit(files))).write.parquet(path)
    return path


@query("str_01b_price_bars_stream", BARS_SQL)
def str_01b(spark, sf):
    out, state = fresh_path(spark, "bars"), fresh_path(spark, "bars-state")
    ticks = J.event_ticks(spark, interleaved_events(spark, sf), EVENTS)
    J.drain(J.versioned_sink(J.streaming_bars(ticks), out, state))
    return _text(J.latest(spark, out, BARS, ["asset", "bar_start"]))


@query(
    "str_02_quality_counters_stream",
    f"WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_type AS asset, count(*) AS n_rows, {r('avg(CASE WHEN coalesce(value, 0) = 0 THEN 1.0 ELSE 0.0 END)')} AS zero_pct, date_diff('day', max(ts), any_value(t)) > 30 AS stale FROM events, m GROUP BY event_type",
)
def str_02(spark, sf):
    out, state = fresh_path(spark, "counters"), fresh_path(spark, "counters-state")
    ticks = J.event_ticks(spark, f"{sf}/events*.parquet", EVENTS)
    J.drain(J.versioned_sink(J.quality_counters(ticks), out, state))
    now = J.latest(spark, out, "asset STRING, n_rows BIGINT, n_zero BIGINT, last_seen TIMESTAMP", ["asset"])
    as_of = now.agg(F.max("last_seen").alias("t")).scalar()
    return J.with_flags(now, as_of).select("asset", "n_rows", rnd("zero_pct").alias("zero_pct"), "stale")


@query("str_03_drift_alerts_stream", ctes(RETS, FP, BASE_FP, VIOL) + f"SELECT type, asset, {r('delta', 4)} AS delta, threshold FROM vl WHERE delta > threshold")
def str_03(spark, sf):
    """One file per year, in any order."""
    source, out, state = (fresh_path(spark, n) for n in ("returns", "alerts", "alerts-state"))
    returns(spark, sf).select("asset", "date", "ret").repartition(F.year("date")).write.parquet(source)
    stream = spark.readStream.schema(J.TAIL).option("maxFilesPerTrigger", 1).parquet(source)
    J.drain(J.drift_alerts(stream, baseline_fingerprint(spark, sf), K.FOCUS, out, state))
    return J.current_alerts(spark, out)
