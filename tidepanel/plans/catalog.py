"""All registered queries in one place, and the flagship report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.expr import rnd
from tidepanel.operators import backtest as B
from tidepanel.operators import risk as R
from tidepanel.plans import (  # noqa: F401
    alignment,
    books,
    completion,
    decisions,
    learning,
    statistics,
    streams,
    windows,
)
from tidepanel.plans import parameters as K
from tidepanel.plans.registry import ORACLES, QUERIES, RETS, ctes, d, query, r
from tidepanel.sources import panels as P
from tidepanel.sources.panels import ASSETS

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    return QUERIES["flagship_monthly_report"](spark, sf_dir)


def equal_weight_drift(spark, sf_dir):
    """Net daily returns of an equal-weight book that drifts, is rebalanced on the first
    trading day after each quarter end and pays for its turnover. Days on which an
    asset does not trade count as a 0 return for it."""
    rets = alignment.returns(spark, sf_dir).filter("ret IS NOT NULL")
    reb = B.rebalance_dates(rets.select("date").distinct())
    mix = spark.createDataFrame([("equal", a, 1.0 / len(ASSETS)) for a in ASSETS], "book STRING, asset STRING, w DOUBLE")
    return B.drift_rebalance(mix, rets, reb, K.COST_BPS, ASSETS)


FLAGSHIP_SQL = (
    ctes(
        RETS,
        "days AS (SELECT DISTINCT date FROM rets WHERE ret IS NOT NULL)",
        books.SEGS.replace(f"SELECT date FROM days WHERE date >= DATE '{K.EVAL_START}'", "SELECT date FROM days"),
        f"""full_p AS (SELECT a.asset, days.date, coalesce(r.ret, 0.0) AS ret FROM days CROSS JOIN (SELECT DISTINCT asset FROM rets) a LEFT JOIN rets r ON r.asset = a.asset AND r.date = days.date),
dm AS (SELECT date, coalesce(sum(r) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg, r FROM (SELECT date, CASE WHEN date IN (SELECT rd FROM rb) THEN 1 ELSE 0 END AS r FROM days)),
dg AS (SELECT asset, p.date, seg, r, product(1 + ret) OVER (PARTITION BY asset, seg ORDER BY p.date ROWS UNBOUNDED PRECEDING) AS g FROM full_p p JOIN dm ON dm.date = p.date),
dv AS (SELECT date, seg, r, sum(0.2 * g) AS v FROM dg GROUP BY 1, 2, 3),
dt AS (SELECT dv.date, sum(abs(0.2 * g / v - 0.2)) AS turnover FROM dv JOIN dg ON dg.date = dv.date WHERE dv.r = 1 GROUP BY 1),
dr AS (SELECT dv.date, v / coalesce(lag(v) OVER (PARTITION BY seg ORDER BY dv.date), 1.0) - 1 - coalesce(turnover, 0.0) * {K.COST_BPS} / 10000 AS ret FROM dv LEFT JOIN dt ON dt.date = dv.date),
gc AS (SELECT *, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM dr),
dc AS (SELECT *, g / max(g) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM gc)""",
    )
    + f"SELECT 'equal' AS book, {d('last_day(date)')} AS month_end, count(*) AS n_days, {r('product(1 + ret) - 1')} AS month_return, {r('arg_max(g, date) - 1')} AS cum, {r('min(dd)')} AS drawdown FROM dc GROUP BY last_day(date)"
)


@query("flagship_monthly_report", FLAGSHIP_SQL)
def flagship_report(spark, sf_dir):
    """Net return, cumulative growth and worst drawdown per month."""
    c = R.with_curves(equal_weight_drift(spark, sf_dir), ["book"])
    return c.groupBy("book", F.last_day("date").alias("month_end")).agg(
        F.count("*").alias("n_days"),
        rnd(F.product(1 + F.col("ret")) - 1).alias("month_return"),
        rnd(F.max_by("growth", "date") - 1).alias("cum"),
        rnd(F.min("drawdown")).alias("drawdown"),
    )
