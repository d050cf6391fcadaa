"""Yields, currency and inflation: anchor tables, interpolation, real returns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.expr import AF, clip

DEFAULT_YIELD = 0.255


def yield_on(df: DataFrame, schedule: DataFrame, default: float = DEFAULT_YIELD, date: str = "date") -> DataFrame:
    """Annual yield of the date's year from a (year_from, year_to, yield) schedule.

    The few intervals are spelled out per year, which turns the range lookup into an
    equi-join with a table no longer than the span of years.
    """
    years = schedule.select(F.explode(F.sequence("year_from", "year_to")).alias("__y"), "yield")
    keyed = df.withColumn("__y", F.year(date))
    return (
        keyed.join(F.broadcast(years), "__y", "left")
        .withColumn("yield", F.coalesce("yield", F.lit(default)))
        .drop("__y")
    )


def daily_holding_return(annual_yield: Column) -> Column:
    return F.pow(1 + annual_yield, F.lit(1.0 / AF)) - 1


def interpolate(date: Column, anchors: Sequence[tuple[dt.date, float]], log: bool = False) -> Column:
    """Piecewise-linear value at ``date`` between dated anchors, held flat outside.

    Anchors are a short parameter list, so the lookup is a CASE inside the
    projection: no join, no shuffle. ``log`` interpolates the logarithm.
    """
    points = sorted(anchors)
    tr = F.log if log else (lambda x: x)
    first, last = points[0], points[-1]
    expr = F.when(date <= F.lit(first[0]), F.lit(float(first[1])))
    for (d0, v0), (d1, v1) in zip(points, points[1:]):
        span = float((d1 - d0).days)
        a, b = tr(F.lit(float(v0))), tr(F.lit(float(v1)))
        inside = a + (b - a) * (F.datediff(date, F.lit(d0)) / F.lit(span))
        expr = expr.when(date <= F.lit(d1), F.exp(inside) if log else inside)
    return F.when(date.isNotNull(), expr.otherwise(F.lit(float(last[1]))))


def interpolate_table(df: DataFrame, anchors: DataFrame, log: bool = False, out: str = "level") -> DataFrame:
    """The same against an anchor *table* of any length: each day takes the anchor
    at or before it and the one after it from a single ordered pass."""
    tagged = df.select("date").distinct().withColumn("v", F.lit(None).cast("double"))
    pts = anchors.select("date", F.col("level").alias("v"))
    rows = tagged.unionByName(pts).withColumn("__a", F.when(F.col("v").isNotNull(), F.struct("date", "v")))
    prev = F.last("__a", ignorenulls=True).over(Window.orderBy("date").rangeBetween(Window.unboundedPreceding, 0))
    nxt = F.first("__a", ignorenulls=True).over(Window.orderBy("date").rangeBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"__p": prev, "__n": nxt}).filter("v IS NULL")
    f = F.log if log else (lambda x: x)
    span = F.datediff("__n.date", "__p.date")
    a, b = f(F.col("__p.v")), f(F.col("__n.v"))
    mid = a + (b - a) * (F.datediff("date", "__p.date") / span)
    mid = F.exp(mid) if log else mid
    value = F.when(F.col("__p").isNull(), F.col("__n.v")).when(F.col("__n").isNull() | (span == 0), F.col("__p.v")).otherwise(mid)
    return df.join(rows.select("date", value.alias(out)), "date", "left")


def fx_returns(levels: DataFrame) -> DataFrame:
    """Daily currency moves from a date-keyed level: first 0, clipped to [-30%, 40%].
    One row per calendar day, so the ordered pass is bounded."""
    w = Window.orderBy("date")
    move = F.coalesce(F.col("level") / F.lag("level").over(w) - 1, F.lit(0.0))
    return levels.withColumn("fx_ret", clip(move, -0.30, 0.40))


def real_return(local: Column, fx: Column) -> Column:
    return (1 + local) / (1 + fx) - 1


def price_level(daily_yoy: DataFrame, base: float = 100.0) -> DataFrame:
    """Compounded price level from a date-keyed year-on-year rate."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily_yoy.withColumn("level", F.product(F.pow(1 + F.col("yoy"), F.lit(1.0 / AF))).over(w) * base)


def real_yield(yields: DataFrame, yoy: DataFrame) -> DataFrame:
    """Yield minus inflation, the latter carried forward over missing days."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    j = yields.join(yoy, "date", "left").withColumn("yoy", F.last("yoy", ignorenulls=True).over(w))
    return j.withColumn("real_yield", F.col("yield") - F.col("yoy"))


def _weekday_on_or_after(d: Column) -> Column:
    dow = F.dayofweek(d)  # 1 = Sunday ... 7 = Saturday
    return F.date_add(d, F.when(dow == 7, 2).when(dow == 1, 1).otherwise(0))


def _weekday_on_or_before(d: Column) -> Column:
    dow = F.dayofweek(d)
    return F.date_sub(d, F.when(dow == 7, 1).when(dow == 1, 2).otherwise(0))


def inflation_regime(df: DataFrame, anchors: Sequence[tuple[dt.date, float]], date: str = "date", lookback_days: int = 90) -> DataFrame:
    """low / rising / high / elevated_falling from the level and its change over the
    look-back window, both read on business days."""
    end = _weekday_on_or_before(F.col(date))
    start = _weekday_on_or_after(F.date_sub(F.col(date), lookback_days))
    yoy = interpolate(end, anchors)
    trend = yoy - interpolate(start, anchors)
    name = (
        F.when(yoy < 0.08, "low")
        .when(yoy < 0.15, F.when(trend > 0, "rising").otherwise("low"))
        .otherwise(F.when(trend > 0, "high").otherwise("elevated_falling"))
    )
    return df.withColumns({"yoy": yoy, "yoy_trend": trend, "inflation_regime": name})
