"""Walk-forward backtests in which segments are rows.

A rebalance schedule is a table of segments; one range join on the calendar (days x
quarters, both small) tags every day with its role, and all segments are then
estimated, invested and measured together, grouped by segment. Nothing loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.expr import AF, one_row, ratio, rnd
from tidepanel.operators import capital, risk, search
from tidepanel.operators.align import wide
from tidepanel.operators.portfolio import wide_weights
from tidepanel.session import small_side, stage

MIN_TRAIN_DAYS = 120


def quarter_end_on_or_before(day: Column) -> Column:
    own = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    return F.when(day == own, own).otherwise(F.date_sub(F.to_date(F.trunc(day, "quarter")), 1))


def next_quarter_end(day: Column) -> Column:
    """First quarter end strictly after ``day``."""
    own = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    return F.when(day >= own, F.last_day(F.add_months(own, 3))).otherwise(own)


def rebalance_dates(days: DataFrame) -> DataFrame:
    """First trading day on or after each quarter end within the calendar.

    Each day belongs to the latest quarter end before it, so the schedule is a plain
    grouped minimum; quarters without trading drop out by themselves.
    """
    first = one_row(days.agg(F.min("date").alias("d")), "d")
    return (
        days.select("date")
        .withColumn("qe", quarter_end_on_or_before(F.col("date")))
        .filter(F.col("qe") >= first)
        .groupBy("qe")
        .agg(F.min("date").alias("rebalance_date"))
        .select("rebalance_date")
        .distinct()
    )


def segments(days: DataFrame, eval_start: str) -> DataFrame:
    """(segment, kind, train_before, after, until): train on date < train_before, test
    on after < date <= until. Row 0 is the opening stretch before the first
    rebalance; the last segment runs to the end of the calendar."""
    window = days.filter(F.col("date") >= F.lit(eval_start).cast("date"))
    ends = window.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    lo, hi = one_row(ends, "lo"), one_row(ends, "hi")
    # One row per quarter.
    w = Window.orderBy("rebalance_date")
    reb = rebalance_dates(window)
    regular = reb.select(
        F.row_number().over(w).alias("segment"),
        F.lit("quarterly").alias("kind"),
        F.col("rebalance_date").alias("train_before"),
        F.col("rebalance_date").alias("after"),
        F.coalesce(F.lead("rebalance_date").over(w), hi).alias("until"),
    )
    opening = reb.agg(F.min("rebalance_date").alias("r")).filter("r IS NOT NULL").select(
        F.lit(0).alias("segment"),
        F.lit("inaugural").alias("kind"),
        lo.alias("train_before"),
        F.date_sub(lo, 1).alias("after"),
        F.col("r").alias("until"),
    )
    return opening.unionByName(regular)


def calendar_roles(days: DataFrame, segs: DataFrame, min_train: int = MIN_TRAIN_DAYS) -> DataFrame:
    """(segment, date, role) for every usable segment: at least ``min_train`` training
    days and a non-empty test stretch."""
    seg = F.broadcast(segs)
    in_train, in_test = days["date"] < seg["train_before"], (days["date"] > seg["after"]) & (days["date"] <= seg["until"])
    tagged = days.join(seg, in_train | in_test).select(
        "segment", "kind", "date", F.when(F.col("date") < F.col("train_before"), "train").otherwise("test").alias("role")
    )
    w = Window.partitionBy("segment")
    n_train = F.sum((F.col("role") == "train").cast("int")).over(w)
    n_test = F.sum((F.col("role") == "test").cast("int")).over(w)
    ok = tagged.withColumns({"__a": n_train, "__b": n_test}).filter((F.col("__a") >= min_train) & (F.col("__b") > 0))
    return ok.drop("__a", "__b")


def leakage_checks(roles: DataFrame) -> DataFrame:
    """Last training day against first test day of every segment."""
    d = F.col("date")
    checks = roles.groupBy("segment", "kind").agg(
        F.max(F.when(F.col("role") == "train", d)).alias("train_end"),
        F.min(F.when(F.col("role") == "test", d)).alias("test_start"),
        F.sum((F.col("role") == "train").cast("long")).alias("train_days"),
        F.sum((F.col("role") == "test").cast("long")).alias("test_days"),
    )
    return checks.withColumn("overlap", F.col("train_end") >= F.col("test_start"))


def expand(panel: DataFrame, roles: DataFrame, role: str) -> DataFrame:
    """Panel rows of one role, once per segment that uses them."""
    return panel.join(roles.filter(F.col("role") == role).select("segment", "date"), "date")


def inverse_vol_targets(train: DataFrame) -> DataFrame:
    """(segment, asset, w): 1/sigma weights learnt on each segment's training rows."""
    vols = train.groupBy("segment", "asset").agg(F.stddev_samp("ret").alias("vol"))
    return search.inverse_volatility(vols, ("segment",)).select("segment", "asset", "w")


def tangency_targets(train: DataFrame, assets: Sequence[str], rf: float, steps: int = 20, **options) -> DataFrame:
    """(segment, asset, w): the maximum-Sharpe mix of each segment's training rows.
    Segments are handed to the search as books, so all are solved in one pass."""
    panel = train.select(F.col("segment").cast("string").alias("book"), "asset", "date", "ret")
    cma = capital.assumptions(panel, assets, rf, **options)
    p = len(assets)
    top = search.max_sharpe(search.score(search.lattice(cma, p, steps), p, rf), p)
    cells = F.array(*[F.struct(F.lit(a).alias("asset"), F.col(f"w{i}").alias("w")) for i, a in enumerate(assets)])
    return top.select(F.col("book").cast("int").alias("segment"), F.inline(cells))


def tactical_overlay(weights: DataFrame, signals: DataFrame, focus: str, sinks: Sequence[str]) -> DataFrame:
    """Tilt the focus asset by 3 % x confidence x size x signal, funded pro rata by
    the sinks. ``signals(segment, signal, confidence, size)``; weak or neutral
    signals leave the weights alone."""
    w = Window.partitionBy("segment")
    x = weights.join(signals, "segment", "left")
    acts = (F.coalesce("signal", F.lit(0)) != 0) & (F.col("confidence") >= 0.45)
    delta = 0.03 * F.col("confidence") * F.least(F.col("size"), F.lit(1.0)) * F.col("signal")
    is_focus, is_sink = F.col("asset") == focus, F.col("asset").isin(*sinks)
    lifted = F.greatest(F.col("w") + delta, F.lit(0.0))
    floor = F.greatest(F.col("w"), F.lit(1e-9))
    x = x.withColumns(
        {
            "__offset": F.sum(F.when(is_focus, lifted - F.col("w"))).over(w),
            "__pool": F.sum(F.when(is_sink, floor)).over(w),
        }
    )
    paid = F.greatest(F.col("w") - F.col("__offset") * (floor / F.col("__pool")), F.lit(0.0))
    moved = F.when(is_focus, lifted).when(is_sink, paid).otherwise(F.col("w"))
    x = x.withColumn("__n", F.when(acts & F.col("__offset").isNotNull(), moved).otherwise(F.col("w")))
    scaled = F.col("__n") / F.greatest(F.sum("__n").over(w), F.lit(1e-12))
    return x.select("segment", "asset", F.when(acts & F.col("__offset").isNotNull(), scaled).otherwise(F.col("w")).alias("w"))


def risk_state(weights: DataFrame, train: DataFrame, target_vol: float, dd_tol: float, tail: int = 126) -> DataFrame:
    """Trailing volatility and closing drawdown of each segment's mix on its own
    training rows, and whether they breach the budget."""
    port = train.join(weights, ["segment", "asset"]).groupBy("segment", "date").agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))
    x = risk.with_curves(port, ["segment"])
    recent = F.row_number().over(Window.partitionBy("segment").orderBy(F.col("date").desc())) <= tail
    x = x.withColumn("__recent", recent)
    s = x.groupBy("segment").agg(
        (F.stddev_samp(F.when(F.col("__recent"), F.col("ret"))) * risk.ROOT).alias("train_realized_vol"),
        (ratio(F.max_by("growth", "date"), F.max("growth")) - 1).alias("train_drawdown"),
    )
    return s.withColumns(
        {
            "vol_breach": F.col("train_realized_vol") > target_vol * 1.25,
            "drawdown_breach": F.col("train_drawdown") < -abs(dd_tol),
        }
    )


def risk_controls(weights: DataFrame, state: DataFrame, cash: str) -> DataFrame:
    """Scale risky weights down on a breach and park the difference in cash."""
    w = Window.partitionBy("segment")
    x = weights.join(state.select("segment", "vol_breach", "drawdown_breach"), "segment")
    scale = F.when(F.col("vol_breach"), 0.75).otherwise(0.85) * F.when(F.col("drawdown_breach"), 0.80).otherwise(1.0)
    breach = F.col("vol_breach") | F.col("drawdown_breach")
    risky = F.col("asset") != cash
    shifted = F.sum(F.when(risky, F.col("w") * (1 - scale)).otherwise(0.0)).over(w)
    moved = F.when(risky, F.col("w") * scale).otherwise(F.col("w") + shifted)
    x = x.withColumn("w", F.when(breach, moved).otherwise(F.col("w")))
    x = x.withColumn("w", F.least(F.greatest("w", F.lit(0.0)), F.lit(1.0)))
    total = F.sum("w").over(w)
    equal = 1.0 / F.count("*").over(w)
    return x.select("segment", "asset", F.when(total <= 1e-12, equal).otherwise(F.col("w") / total).alias("w"))


def turnover(weights: DataFrame, cost_bps: float) -> DataFrame:
    """Gross change against the previous segment's weights (the first pays for the
    whole book) and its cost. An asset that was absent before counts from 0; one
    that drops out should appear with weight 0."""
    prev = F.lag("w").over(Window.partitionBy("asset").orderBy("segment"))
    return (
        weights.withColumn("__p", F.coalesce(prev, F.lit(0.0)))
        .groupBy("segment")
        .agg(F.sum(F.abs(F.col("w") - F.col("__p"))).alias("turnover"))
        .withColumn("cost", F.col("turnover") * (cost_bps / 10_000.0))
    )


def segment_returns(weights: DataFrame, test: DataFrame, costs: DataFrame) -> DataFrame:
    """Daily return of each segment's mix on its test days; the cost of getting there
    is charged to the first day."""
    r = test.join(weights, ["segment", "asset"]).groupBy("segment", "date").agg(F.sum(F.col("w") * F.col("ret")).alias("gross"))
    first = F.min("date").over(Window.partitionBy("segment"))
    return (
        r.withColumn("__f", first)
        .join(costs.select("segment", "cost"), "segment")
        .withColumn("ret", F.col("gross") - F.when(F.col("date") == F.col("__f"), F.col("cost")).otherwise(0.0))
        .drop("__f")
    )


def segment_metrics(daily: DataFrame, rf: float) -> DataFrame:
    vol = F.stddev_samp("ret") * risk.ROOT
    return daily.groupBy("segment").agg(
        F.count("*").alias("oos_days"),
        rnd(F.product(1 + F.col("ret")) - 1, 6).alias("segment_total_return"),
        rnd((F.avg("ret") * AF - rf) / (vol + risk.EPS), 4).alias("segment_sharpe"),
        rnd(vol, 4).alias("segment_volatility"),
    )


def summarise_segments(m: DataFrame) -> DataFrame:
    s = F.col("segment_sharpe")
    return m.agg(
        F.count("*").alias("n_segments"),
        rnd(F.avg(s), 4).alias("mean_segment_sharpe"),
        rnd(F.when(F.count("*") > 1, F.stddev_pop(s)).otherwise(0.0), 4).alias("std_segment_sharpe"),
        rnd(F.avg("segment_total_return"), 6).alias("mean_segment_total_return"),
        rnd(F.min(s), 4).alias("min_segment_sharpe"),
        rnd(F.max(s), 4).alias("max_segment_sharpe"),
    )


def walk_forward(
    panel: DataFrame,
    roles: DataFrame,
    assets: Sequence[str],
    signals,
    rf: float,
    cost_bps: float,
    focus: str,
    sinks: Sequence[str],
    cash: str,
    target_vol: float,
    dd_tol: float,
    steps: int = 20,
    **mu_options,
) -> DataFrame:
    """Daily out-of-sample returns: tangency weights per segment, tactical overlay,
    risk guard, turnover cost. ``signals(train, weights)`` gives the overlay's table.

    Training rows and weights are read several times, so they are staged once; the
    weights are one row per segment and asset.
    """
    train, test = stage(expand(panel, roles, "train"), "train"), expand(panel, roles, "test")
    w = stage(tangency_targets(train, assets, rf, steps, **mu_options), "targets")
    w = stage(tactical_overlay(w, signals(train, w), focus, sinks), "overlay")
    w = stage(risk_controls(w, risk_state(w, train, target_vol, dd_tol), cash), "weights")
    return segment_returns(w, test, turnover(w, cost_bps))


def curves(daily: DataFrame, days: DataFrame, series: Sequence[str], key: str = "series") -> DataFrame:
    """Cumulative return and drawdown of every series on the full calendar; days a
    series does not trade count as a 0 return."""
    grid = days.select("date", F.explode(F.array(*[F.lit(s) for s in series])).alias(key))
    full = grid.join(daily.select(key, "date", "ret"), [key, "date"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    x = risk.with_curves(full, [key])
    return x.select(key, "date", "ret", (F.col("growth") - 1).alias("cum"), "drawdown")


def drift_rebalance(weights: DataFrame, returns: DataFrame, rebalances: DataFrame, cost_bps: float, assets: Sequence[str]) -> DataFrame:
    """Daily net return of books that drift between rebalances and pay for turnover.

    Between two rebalances a book is worth sum_i w_i G_i, with G_i the asset's growth
    since the stretch began, so no day depends on a loop over the days before it.
    Growth is worked out once on the calendar-sized panel (a missing return counts as
    0); each book is one wide row that unfolds those days in place, without a join or
    a window over its own days. Where a stretch's value falls to zero or below, that
    day returns 0 and the book starts again from its targets; such stretches alone are
    followed day by day.
    """
    n = range(len(assets))
    days = wide(returns.filter("ret IS NOT NULL"), assets)
    days = days.select("date", *[F.coalesce(f"a{i}", F.lit(0.0)).alias(f"a{i}") for i in n])
    marks = rebalances.select(F.col("rebalance_date").alias("date"), F.lit(1).alias("is_reb"))
    days = days.join(F.broadcast(marks), "date", "left").withColumn("is_reb", F.coalesce("is_reb", F.lit(0)))
    # A stretch ends on the rebalance day itself.
    past = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("segment", F.coalesce(F.sum("is_reb").over(past), F.lit(0)))
    order = Window.partitionBy("segment").orderBy("date")
    days = days.withColumns({f"g{i}": F.product(1 + F.col(f"a{i}")).over(order.rowsBetween(Window.unboundedPreceding, 0)) for i in n})
    days = days.withColumns({f"h{i}": F.lag(f"g{i}").over(order) for i in n})
    arrays = [F.array(*[f"{x}{i}" for i in n]).alias(x) for x in "ga"]
    row = F.struct("date", "is_reb", *arrays, F.when(F.col("h0").isNotNull(), F.array(*[f"h{i}" for i in n])).alias("h"))
    stretches = days.groupBy("segment").agg(F.sort_array(F.collect_list(row)).alias("days"))
    staged = small_side(stretches, "stretches")
    # stretches are numbered from 0 without gaps: a book meets each by its number
    numbers = F.explode(F.sequence(F.lit(0), F.lit(max(staged.count(), 1) - 1))).alias("segment")
    x = wide_weights(weights, assets).select("*", numbers).join(staged, "segment")
    mix = lambda a: "(" + " + ".join(f"w{i} * d.{a}[{i}]" for i in n) + ")"
    moved = " + ".join(f"abs(w{i} * d.g[{i}] / {mix('g')} - w{i})" for i in n)
    plain = (
        f"transform(days, d -> struct(d.date AS date, {mix('g')} AS value, {mix('g')} / IF(d.h IS NULL, 1D, {mix('h')}) - 1 AS gross, "
        f"IF(d.is_reb = 1, {moved}, 0D) AS turnover))"
    )
    target = "array(" + ", ".join(f"w{i}" for i in n) + ")"
    # let-bindings: an array of one, transformed
    stepped = (
        f"aggregate(days, named_struct('w', {target}, 'value', 1D, 'out', cast(array() AS array<struct<date:date,value:double,gross:double,turnover:double>>)), (s, d) -> "
        "transform(array(zip_with(s.w, d.a, (w, r) -> w * (1 + r))), grown -> "
        "transform(array(aggregate(grown, 0D, (t, v) -> t + v)), total -> "
        f"IF(total <= 0, named_struct('w', {target}, 'value', 1D, 'out', array_append(s.out, named_struct('date', d.date, 'value', 0D, 'gross', 0D, 'turnover', 0D))), "
        "transform(array(transform(grown, v -> v / total)), now -> "
        f"named_struct('w', IF(d.is_reb = 1, {target}, now), 'value', s.value * total, 'out', array_append(s.out, named_struct('date', d.date, 'value', s.value * total, 'gross', total - 1, "
        f"'turnover', IF(d.is_reb = 1, aggregate(zip_with(now, {target}, (a, b) -> abs(a - b)), 0D, (t, v) -> t + v), 0D)))))[0]))[0])[0], s -> s.out)"
    )
    falls = f"exists(days, d -> {mix('g')} <= 0)"
    x = x.selectExpr("book", "segment", f"inline(IF({falls}, {stepped}, {plain}))")
    return x.withColumn("ret", F.col("gross") - F.col("turnover") * (cost_bps / 10_000.0))
