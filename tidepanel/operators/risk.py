"""Performance and risk measures of return series, grouped by any key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.expr import (
    AF,
    ann_mean,
    ann_vol,
    finite,
    ratio,
    rnd,
    sample_kurtosis,
    sample_skew,
    series,
    to_date_rows,
    whole,
)

ROOT = math.sqrt(AF)
# Standard normal quantiles at 5 % and 1 %.
Z05, Z01 = -1.6448536269514729, -2.3263478740408408
EPS = 1e-12


def with_curves(df: DataFrame, keys: Sequence[str], ret: str = "ret") -> DataFrame:
    """Compounded growth and its drawdown from the running peak."""
    w = to_date_rows(series(keys))
    x = df.filter(F.col(ret).isNotNull()).withColumn("growth", F.product(1 + F.col(ret)).over(w))
    return x.withColumn("drawdown", ratio("growth", F.max("growth").over(w)) - 1)


def performance(df: DataFrame, keys: Sequence[str], rf: float, ret: str = "ret") -> DataFrame:
    """Total return, CAGR, volatility, Sharpe and maximum drawdown, to 4 places."""
    x = with_curves(df, keys, ret)
    r = F.col(ret)
    total = F.product(1 + r)
    years = F.greatest(F.count(r) / AF, F.lit(1.0 / AF))
    vol = ann_vol(r)
    out = x.groupBy(*keys).agg(
        F.count(r).alias("n"),
        (total - 1).alias("total_return"),
        (F.pow(total, 1 / years) - 1).alias("cagr"),
        vol.alias("volatility"),
        ((ann_mean(r) - rf) / (vol + EPS)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
    )
    names = ("total_return", "cagr", "volatility", "sharpe", "max_drawdown")
    return out.select(*keys, "n", *[rnd(n, 4).alias(n) for n in names])


def parametric_var(mean: Column, std: Column, z: float) -> Column:
    return -(mean + z * std)


def parametric_cvar(mean: Column, std: Column, z: float, alpha: float) -> Column:
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return -mean + std * (density / alpha)


def downside_deviation(ret: Column, target: float) -> Column:
    return F.sqrt(F.avg(F.pow(F.least(ret - target, F.lit(0.0)), F.lit(2.0)))) * ROOT


def historical_tail(df: DataFrame, keys: Sequence[str], alpha: float = 0.05, ret: str = "ret") -> DataFrame:
    """Empirical VaR (linear quantile) and the mean loss at or beyond it."""
    x = _with_cut(df.filter(F.col(ret).isNotNull()), keys, alpha, ret)
    return x.groupBy(*keys).agg(*_tail(ret))


def _with_cut(df: DataFrame, keys: Sequence[str], alpha: float, ret: str) -> DataFrame:
    # A key's rows are its days, so the quantile comes from the same partition.
    return df.withColumn("__q", F.percentile(ret, alpha).over(whole(keys)))


def _tail(ret: str) -> list[Column]:
    tail = F.avg(F.when(F.col(ret) <= F.col("__q"), F.col(ret)))
    return [(-F.first("__q")).alias("hist_var"), (-tail).alias("hist_cvar")]


def active_risk(df: DataFrame, keys: Sequence[str], bench: str = "bench", ret: str = "ret", min_rows: int = 30) -> DataFrame:
    """Beta, tracking error and information ratio over jointly observed rows."""
    r, b = F.col(ret), F.col(bench)
    a = r - b
    n = F.count("*")
    te = F.stddev_samp(a) * ROOT
    return df.dropna(subset=[ret, bench]).groupBy(*keys).agg(
        n.alias("n_joint"),
        F.when(n > min_rows, F.covar_samp(r, b) / (F.var_samp(b) + EPS)).alias("beta"),
        F.when(n > min_rows, te).alias("tracking_error"),
        F.when(n > min_rows, F.avg(a) * AF / (te + EPS)).alias("information_ratio"),
    )


def risk_pack(df: DataFrame, keys: Sequence[str], rf: float, ret: str = "ret") -> DataFrame:
    """The full profile of one return series per key."""
    x = _with_cut(with_curves(df, keys, ret), keys, 0.05, ret)
    r = F.col(ret)
    m, s = F.avg(r), F.stddev_samp(r)
    base = x.groupBy(*keys).agg(
        ann_mean(r).alias("annualized_return"),
        ann_vol(r).alias("annualized_volatility"),
        downside_deviation(r, rf / AF).alias("__down"),
        F.min("drawdown").alias("max_drawdown"),
        finite(sample_skew(r)).alias("skew"),
        finite(sample_kurtosis(r)).alias("kurtosis"),
        parametric_var(m, s, Z05).alias("var_95"),
        parametric_var(m, s, Z01).alias("var_99"),
        parametric_cvar(m, s, Z05, 0.05).alias("cvar_95"),
        parametric_cvar(m, s, Z01, 0.01).alias("cvar_99"),
        *_tail(ret),
    )
    excess = F.col("annualized_return") - rf
    base = base.withColumns(
        {
            "sharpe": excess / (F.col("annualized_volatility") + EPS),
            "sortino": excess / (F.col("__down") + EPS),
            "calmar": F.when(
                F.col("max_drawdown") < 0, F.col("annualized_return") / (F.abs("max_drawdown") + EPS)
            ),
        }
    ).drop("__down")
    return base.withColumnsRenamed({"hist_var": "historical_var_95", "hist_cvar": "historical_cvar_95"})


def month_end(df: DataFrame, keys: Sequence[str], value: str, n_series: int) -> DataFrame:
    """Last value per month, for months in which every series has one."""
    last = df.groupBy(*keys, F.last_day("date").alias("month_end")).agg(F.max_by(value, "date").alias(value))
    full = last.groupBy("month_end").agg(F.count(value).alias("n")).filter(F.col("n") == n_series)
    return last.join(F.broadcast(full.select("month_end")), "month_end", "left_semi")
