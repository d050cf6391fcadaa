"""Per-asset time-series features over a long (asset, date, price, ret) panel.

All windows share one (asset, date) sort, so Spark shuffles the panel once however
many features are asked for. Frames count trading rows, never calendar days.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.expr import (
    AF,
    clip,
    correlation,
    finite,
    last_rows,
    ratio,
    rolling,
    sd,
    series,
    to_date_rows,
    whole,
)

EMA_CHUNK = 256


def simple_return(df: DataFrame, price: str = "price", out: str = "ret") -> DataFrame:
    """p / previous p - 1. Rows without a price are dropped first, not padded."""
    return df.filter(F.col(price).isNotNull()).withColumn(
        out, ratio(price, F.lag(price).over(series())) - 1
    )


def lags(df: DataFrame, col: str = "ret", k: int = 3) -> DataFrame:
    w = series()
    return df.withColumns({f"{col}_lag{i}": F.lag(col, i).over(w) for i in range(1, k + 1)})


def moving_average_distance(df: DataFrame, windows=(5, 20)) -> DataFrame:
    w = series()
    out: dict[str, Column] = {}
    for n in windows:
        sma = rolling(F.avg, "price", n, w)
        out[f"ma_{n}"] = sma
        out[f"dist_to_ma{n}"] = ratio("price", sma) - 1
    return df.withColumns(out)


def rolling_volatility(df: DataFrame, n: int = 20, annualise: bool = False, out: str | None = None) -> DataFrame:
    vol = rolling(sd, "ret", n, series())
    if annualise:
        vol = vol * math.sqrt(AF)
    return df.withColumn(out or f"volatility_{n}", vol)


def ema(df: DataFrame, col: str, span: int, out: str, chunk: int = EMA_CHUNK) -> DataFrame:
    """Recursive exponential mean y_t = q y_{t-1} + (1-q) x_t with y_0 = x_0.

    The recurrence is linear, so a series is cut into chunks: inside a chunk a plain
    running sum of x_j q^-j gives the local part, and the state carried into a chunk
    folds the few earlier chunk ends. No Python, one sort per window.
    """
    if span <= 1:
        return df.withColumn(out, F.col(col))
    alpha = 2.0 / (span + 1.0)
    q = 1.0 - alpha
    w = series()
    pos = (F.row_number().over(w) - 1).cast("int")
    tmp = {k: f"__{out}_{k}" for k in ("i", "c", "k", "y", "x0", "ends")}
    step = (
        df.withColumn(tmp["i"], pos)
        .withColumn(tmp["c"], F.floor(F.col(tmp["i"]) / chunk))
        .withColumn(tmp["k"], F.col(tmp["i"]) % chunk)
        .withColumn(tmp["x0"], F.first(col).over(to_date_rows(w)))
    )
    local = to_date_rows(series(("asset", tmp["c"]), "date"))
    scaled = F.sum(F.col(col) * alpha * F.pow(F.lit(q), -F.col(tmp["k"]))).over(local)
    step = step.withColumn(tmp["y"], F.pow(F.lit(q), F.col(tmp["k"])) * scaled)
    ends = F.collect_list(F.when(F.col(tmp["k"]) == chunk - 1, F.col(tmp["y"])))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    step = step.withColumn(tmp["ends"], ends.over(before))
    carry = F.aggregate(F.col(tmp["ends"]), F.col(tmp["x0"]), lambda acc, e: e + F.lit(q**chunk) * acc)
    return step.withColumn(
        out, F.col(tmp["y"]) + F.pow(F.lit(q), F.col(tmp["k"]) + 1) * carry
    ).drop(*tmp.values())


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ema(df, "price", fast, "__fast")
    df = ema(df, "price", slow, "__slow")
    df = df.withColumn("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    df = ema(df, "macd", signal, "macd_signal")
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    w = series()
    mid, dev = rolling(F.avg, "price", n, w), rolling(sd, "price", n, w)
    lower = mid - dev * k
    return df.withColumns(
        {
            "bb_pb": finite(F.try_divide(F.col("price") - lower, dev * (2 * k))),
            "bb_bandwidth": finite(F.try_divide(dev * (2 * k), mid)),
        }
    )


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Simple-mean RSI: no losses gives 100, no movement at all gives NULL."""
    w = series()
    df = df.withColumn("__d", F.col("price") - F.lag("price").over(w))
    zero = F.lit(0.0)
    gain = rolling(F.avg, F.when(F.col("__d").isNotNull(), F.greatest(F.col("__d"), zero)), n, w)
    loss = rolling(F.avg, F.when(F.col("__d").isNotNull(), F.greatest(-F.col("__d"), zero)), n, w)
    value = (
        F.when((loss == 0) & (gain == 0), F.lit(None).cast("double"))
        .when(loss == 0, F.lit(100.0))
        .otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    )
    return df.withColumn("rsi", value).drop("__d")


def next_day_label(df: DataFrame, threshold: float = 0.005) -> DataFrame:
    up = F.coalesce(F.lead("ret").over(series()) > threshold, F.lit(False))
    return df.withColumn("label", up.cast("int"))


def yield_label(df: DataFrame, n: int = 20) -> DataFrame:
    above = F.coalesce(F.col("ret") > rolling(sd, "ret", n, series()), F.lit(False))
    return df.withColumn("label", above.cast("int"))


def technical_features(df: DataFrame) -> DataFrame:
    """The full feature set on a price panel, complete rows only, followed by the
    30-row annualised volatility that is measured on those complete rows."""
    df = simple_return(df)
    df = lags(df, "ret", 2)
    df = moving_average_distance(df)
    df = rolling_volatility(df, 20)
    df = macd(df)
    df = rsi(bollinger(df))
    df = next_day_label(df)
    df = df.dropna()
    return rolling_volatility(df, 30, annualise=True, out="rolling_volatility")


def growth_index(df: DataFrame, ret: str = "ret", out: str = "growth", keys=("asset",)) -> DataFrame:
    return df.withColumn(out, F.product(1 + F.col(ret)).over(to_date_rows(series(keys))))


def rebase(df: DataFrame, start: str, end: str, base: float = 100.0) -> DataFrame:
    """Price relative to the first one inside the date slice."""
    sliced = df.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    first = F.first("price", ignorenulls=True).over(to_date_rows(series()))
    return sliced.withColumn("rebased", ratio("price", first) * base)


def drawdown(df: DataFrame, index: str = "growth", out: str = "drawdown", keys=("asset",), start_at_one: bool = False) -> DataFrame:
    peak = F.max(index).over(to_date_rows(series(keys)))
    if start_at_one:
        peak = F.greatest(peak, F.lit(1.0))
    return df.withColumn(out, ratio(index, peak) - 1)


def forward_return(df: DataFrame, horizon: int = 63, out: str = "target") -> DataFrame:
    """Compounded return over the next ``horizon`` rows; NULL where fewer remain."""
    frame = series().rowsBetween(1, horizon)
    full = F.count("ret").over(frame) == horizon
    return df.withColumn(out, F.when(full, F.product(1 + F.col("ret")).over(frame) - 1))


def ternary_label(df: DataFrame, lo: float = 0.33, hi: float = 0.67, fit_on: Column | None = None) -> DataFrame:
    """-1 / 0 / 1 by the quantiles of the next return.

    ``fit_on`` limits the rows the thresholds are learnt from (train rows); left
    out, the whole series is used. Falls back to the 0/1 label when the split does
    not yield three classes; a label that already has three or more stays as it is.
    """
    nxt = F.lead("ret").over(series())
    df = df.withColumn("__nxt", nxt)
    fit = F.when(fit_on, F.col("__nxt")) if fit_on is not None else F.col("__nxt")
    w = whole()
    df = df.withColumns({"__lo": F.percentile(fit, lo).over(w), "__hi": F.percentile(fit, hi).over(w)})
    tri = (
        F.when(F.col("__nxt") >= F.col("__hi"), 1)
        .when(F.col("__nxt") <= F.col("__lo"), -1)
        .otherwise(0)
    )
    df = df.withColumn("__tri", tri)
    classes = F.size(F.collect_set("__tri").over(w))
    own = F.size(F.collect_set("label").over(w))
    return df.withColumn(
        "tri_label", F.when((classes >= 3) & (own < 3), F.col("__tri")).otherwise(F.col("label"))
    ).drop("__nxt", "__lo", "__hi", "__tri")


def momentum(df: DataFrame) -> DataFrame:
    """5/21/63-row momentum as of every date (the newest row is the live one)."""
    w = series()
    df = df.filter(F.col("ret").isNotNull())
    n = F.count("ret").over(to_date_rows(w))
    short, medium = F.avg("ret").over(last_rows(w, 5)), F.avg("ret").over(last_rows(w, 21))
    long_ = F.when(n >= 63, F.avg("ret").over(last_rows(w, 63))).otherwise(medium)
    sigma = F.stddev_samp("ret").over(last_rows(w, 63))
    zero = F.lit(0.0)
    ready = n >= 30
    df = df.withColumns(
        {
            "short_mean": F.when(ready, short).otherwise(zero),
            "medium_mean": F.when(ready, medium).otherwise(zero),
            "long_mean": F.when(ready, long_).otherwise(zero),
            "strength": F.when(ready, (short - medium) / (sigma + 1e-9)).otherwise(zero),
        }
    )
    s, m = F.col("short_mean"), F.col("medium_mean")
    signal = (
        F.when((s > 0) & (m > 0) & (s > m), 1).when((s < 0) & (m < 0) & (s < m), -1).otherwise(0)
    )
    return df.withColumn("signal", signal)


def regime(df: DataFrame) -> DataFrame:
    """Volatility / trend / drawdown regime as of every date."""
    w = series()
    root = math.sqrt(AF)
    df = df.filter(F.col("ret").isNotNull())
    df = growth_index(df, out="__g")
    n = F.count("ret").over(to_date_rows(w))
    ready = n >= 30
    full = F.stddev_samp("ret").over(to_date_rows(w))
    long_vol = F.when(n >= 120, F.stddev_samp("ret").over(last_rows(w, 120))).otherwise(full) * root
    zero = F.lit(0.0)
    df = df.withColumns(
        {
            "realized_vol": F.when(ready, F.stddev_samp("ret").over(last_rows(w, 20)) * root).otherwise(zero),
            "long_vol": F.when(ready, long_vol).otherwise(zero),
            "trend": F.when(ready, F.avg("ret").over(last_rows(w, 20))).otherwise(zero),
            "regime_drawdown": F.when(
                ready, ratio("__g", F.max("__g").over(last_rows(w, 252))) - 1
            ).otherwise(zero),
            "__ready": ready,
        }
    ).drop("__g")
    rv, lv, tr, dd = (F.col(x) for x in ("realized_vol", "long_vol", "trend", "regime_drawdown"))
    risk_off = F.col("__ready") & (rv > 1.30 * (lv + 1e-9)) & ((tr < 0) | (dd < -0.08))
    name = (
        F.when(~F.col("__ready"), "uncertain")
        .when(F.col("risk_off"), "high_volatility_risk_off")
        .when((tr > 0) & (rv < lv * 1.10), "bull_trend")
        .when(tr < 0, "bear_trend")
        .otherwise("sideways")
    )
    return df.withColumn("risk_off", risk_off).withColumn("regime", name).drop("__ready")


def latest_complete(df: DataFrame, cols) -> DataFrame:
    """Newest row per asset on which every listed column is present."""
    cols = list(cols)
    packed = F.struct("date", *cols)
    newest = df.dropna(subset=cols).groupBy("asset").agg(F.max_by(packed, F.col("date")).alias("s"))
    return newest.select("asset", "s.*")


def macro_trend(df: DataFrame, n: int = 63, inflation_like: str = "gold", rates_like: str = "tbill") -> DataFrame:
    """tanh trend score per asset plus two name-matched pressure readings."""
    tail = tail_rows(df.filter(F.col("ret").isNotNull()), n)
    per = tail.groupBy("asset").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    name = F.lower("asset")
    everyone = per.groupBy().agg(
        F.coalesce(F.avg(F.when(name.contains(inflation_like), F.col("m"))), F.lit(0.0)).alias("inflation_pressure"),
        F.coalesce(F.avg(F.when(name.contains(rates_like), F.col("m"))), F.lit(0.0)).alias("rates_pressure"),
    )
    return per.select(
        "asset",
        F.tanh(F.col("m") / (F.col("s") + 1e-9)).alias("trend_score"),
        everyone.select("inflation_pressure").scalar().alias("inflation_pressure"),
        everyone.select("rates_pressure").scalar().alias("rates_pressure"),
    )


def tail_rows(df: DataFrame, n: int) -> DataFrame:
    """Last ``n`` rows of every asset."""
    w = whole().orderBy(F.col("date").desc())
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def autocorrelation(df: DataFrame) -> DataFrame:
    """Lag-1 autocorrelation of the non-null returns, with the row count."""
    x = df.filter(F.col("ret").isNotNull()).withColumn("__p", F.lag("ret").over(series()))
    return x.groupBy("asset").agg(F.count("ret").alias("n"), correlation("ret", "__p").alias("rho"))


def unsmooth(df: DataFrame, max_rho: float = 0.85, min_rho: float = 0.10, min_rows: int = 30) -> DataFrame:
    """Remove appraisal smoothing: (r - rho r_prev) / (1 - rho), where it pays."""
    x = df.filter(F.col("ret").isNotNull()).withColumn("__p", F.lag("ret").over(series()))
    w = whole()
    # Windowed aggregates are combined after the fact, so the parts are named first.
    both = F.col("__p").isNotNull()
    sides = {
        "__c": F.covar_samp("ret", "__p").over(w),
        "__s": F.stddev_samp(F.when(both, F.col("ret"))).over(w) * F.stddev_samp("__p").over(w),
        "__n": F.count("ret").over(w),
    }
    rho = clip(F.coalesce(F.try_divide("__c", "__s"), F.lit(0.0)), 0.0, max_rho)
    x = x.withColumns(sides).withColumn("__rho", rho).drop("__c", "__s")
    rho = F.col("__rho")
    value = F.when((F.col("__n") < min_rows) | (rho < min_rho), F.col("ret")).otherwise(
        (F.col("ret") - rho * F.col("__p")) / (1 - rho)
    )
    return x.withColumn("unsmoothed", value).withColumn("rho", rho).drop("__p", "__n", "__rho")

