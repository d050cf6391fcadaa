"""Capital-market assumptions: expected returns and covariance, per book.

Every function takes long (book, asset, date, ret) rows; a single panel is simply
one book. The result is one row per book with a mean array and a flat covariance
array in asset order, which is what the portfolio search reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.expr import AF, clip
from tidepanel.operators.align import wide

WINSOR = (0.005, 0.995)


def _book():
    return Window.partitionBy("book")



def prior(asset: Column, rf: float, premium: float, cash_like: Sequence[str] = (), fx_like: Sequence[str] = ()) -> Column:
    """Cash earns the risk-free rate, currency nothing, the rest a premium on top."""
    return (
        F.when(asset.isin(*cash_like) if cash_like else F.lit(False), rf)
        .when(asset.isin(*fx_like) if fx_like else F.lit(False), 0.0)
        .otherwise(rf + premium)
    )


def expected_returns(
    history: DataFrame,
    rf: float,
    premium: float = 0.06,
    shrinkage: float = 0.30,
    cash_like: Sequence[str] = (),
    fx_like: Sequence[str] = (),
    extras: DataFrame | None = None,
    imputed_threshold: float = 0.35,
    forecast_cap: float = 0.04,
    blend: float = 0.10,
) -> DataFrame:
    """Annual expected return per (book, asset).

    Winsorised sample mean, shrunk to the prior; mostly-imputed assets are pulled
    further; a daily forecast is kept within +-cap of history and blended in.
    ``extras(book, asset, imputed_fraction, forecast_daily)`` is optional.
    """
    obs = history.filter("ret IS NOT NULL")
    keys = ["book", "asset"]
    b = F.percentile("ret", F.array(*[F.lit(q) for q in WINSOR])).over(Window.partitionBy(*keys))
    x = F.least(F.greatest(F.col("ret"), F.col("b")[0]), F.col("b")[1])
    per = obs.withColumn("b", b).groupBy(*keys).agg((F.avg(x) * AF).alias("sample_mean"))
    pr = prior(F.col("asset"), rf, premium, cash_like, fx_like)
    per = per.withColumn("prior", pr).withColumn("hist_mu", (1 - shrinkage) * F.col("sample_mean") + shrinkage * F.col("prior"))
    if extras is None:
        return per.withColumn("mu", clip("hist_mu", -0.10, 0.55))
    per = per.join(extras, keys, "left")
    frac = F.coalesce("imputed_fraction", F.lit(0.0))
    pull = F.when(frac >= imputed_threshold, clip((frac - imputed_threshold) / (1.0 - imputed_threshold), 0.0, 1.0)).otherwise(0.0)
    per = per.withColumn("hist_mu", (1 - pull) * F.col("hist_mu") + pull * F.col("prior"))
    fc = F.coalesce(F.col("forecast_daily") * AF, F.col("hist_mu"))
    fc = F.least(F.greatest(fc, F.col("hist_mu") - forecast_cap), F.col("hist_mu") + forecast_cap)
    mu = (1 - blend) * F.col("hist_mu") + blend * fc
    return per.withColumn("forecast_mu", fc).withColumn("mu", clip(mu, -0.10, 0.55))


def covariance(panel: DataFrame, assets: Sequence[str]) -> DataFrame:
    """(book, n, cov): annual shrunk covariance of the winsorised panel as a flat
    array. Complete dates are used; a book with fewer than max(20, 2p) of them uses
    every date with any value and 0 for the missing cells."""
    p = len(assets)
    names = [f"a{i}" for i in range(p)]
    rows = wide(panel, assets, keys=("book",))
    present = " + ".join(f"CAST({n} IS NOT NULL AS INT)" for n in names)
    rows = rows.withColumn("__k", F.expr(present)).filter("__k > 0")
    enough = F.sum((F.col("__k") == p).cast("long")).over(_book()) >= max(20, 2 * p)
    rows = rows.withColumn("__e", enough).filter((F.col("__k") == p) | ~F.col("__e"))
    rows = rows.selectExpr("book", *[f"coalesce({n}, 0D) AS {n}" for n in names])
    lo, hi = WINSOR
    # A book has one wide row per day, already clustered by book for the count above:
    # bounds come from the same partitions instead of a second pass and a join.
    bounds = [f"percentile({n}, array({lo}D, {hi}D)) OVER (PARTITION BY book) AS b{n}" for n in names]
    cut = rows.selectExpr("*", *bounds).selectExpr(
        "book", *[f"least(greatest({n}, b{n}[0]), b{n}[1]) AS {n}" for n in names]
    )
    sums = [f"covar_samp(a{i}, a{j}) AS c{i}_{j}" for i in range(p) for j in range(i, p)]
    s = cut.groupBy("book").agg(F.count("*").alias("n"), *[F.expr(e) for e in sums])

    def cell(i: int, j: int) -> str:
        if i == j:
            return f"IF(c{i}_{i} > 0, c{i}_{i}, 1e-12D) * {AF} + 1e-10D"
        return f"(1 - {float(p)}D / ({p} + greatest(n, 1))) * c{min(i, j)}_{max(i, j)} * {AF}"

    cells = ", ".join(cell(i, j) for i in range(p) for j in range(p))
    return s.selectExpr("book", "n", f"array({cells}) AS cov")


def assumptions(panel: DataFrame, assets: Sequence[str], rf: float, **mu_options) -> DataFrame:
    """(book, n, mu, cov) rows, ready for the search."""
    mu = expected_returns(panel, rf, **mu_options)
    one = mu.groupBy("book").agg(
        F.array(*[F.max(F.when(F.col("asset") == a, F.col("mu"))) for a in assets]).alias("mu")
    )
    # Both sides have one small row per book: put together by one aggregate, no join.
    both = covariance(panel, assets).unionByName(one, allowMissingColumns=True)
    return both.groupBy("book").agg(*[F.max(x).alias(x) for x in ("n", "mu", "cov")]).dropna()
