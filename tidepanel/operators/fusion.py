"""Fusing the strategic and the tactical layer into one decision per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.expr import clip, rnd


def decisions(df: DataFrame, matrix: DataFrame, fallback: tuple[str, float]) -> DataFrame:
    """Action and base confidence for (bias, signal); unknown cells take the fallback."""
    j = df.join(F.broadcast(matrix), ["bias", "signal"], "left")
    return j.withColumns(
        {"action": F.coalesce("action", F.lit(fallback[0])), "base_conf": F.coalesce("base_conf", F.lit(fallback[1]))}
    )


def fused_confidence(base: Column, tactical: Column, strategic: Column) -> Column:
    return clip(base * (0.55 + 0.45 * tactical) * (0.65 + 0.35 * strategic), 0.05, 0.99)


def net_tilts(df: DataFrame, keys: list[str], safe: tuple[str, str]) -> DataFrame:
    """(keys, asset, tilt): the tilts of all assets' decisions in one book on one day, each
    towards or away from its own asset, added up; assets whose tilts cancel out stay."""
    parts = base_tilt(df.withColumnRenamed("asset", "__focus"), F.col("__focus"), safe)
    return parts.groupBy(*keys, "asset").agg(F.sum("tilt").alias("tilt"))


def base_tilt(df: DataFrame, focus: str | Column, safe: tuple[str, str]) -> DataFrame:
    """(…, asset, tilt): shift towards or away from the focus asset, funded half and
    half by the safe assets; tiny tilts and neutral signals give no rows."""
    size = F.round(0.05 * F.col("confidence") * F.col("size"), 4)
    m = size * F.col("signal")
    focus = F.lit(focus) if isinstance(focus, str) else focus
    rows = F.array(
        F.struct(focus.alias("asset"), m.alias("tilt")),
        *[F.struct(F.lit(a).alias("asset"), (-m * 0.5).alias("tilt")) for a in safe],
    )
    acting = df.filter((F.col("signal") != 0) & (size >= 0.005))
    return acting.select("*", F.inline(rows))


def inflation_modifier(tilts: DataFrame, multipliers: DataFrame, keys: list[str], cash: str, digits: int = 4) -> DataFrame:
    """Scale tilts by the inflation regime, refuse to add cash at a negative real
    yield, and spread the residual so the tilt nets to zero."""
    w = Window.partitionBy(*keys)
    j = tilts.join(F.broadcast(multipliers), ["inflation_regime", "asset"], "left")
    j = j.withColumn("tilt", F.col("tilt") * F.coalesce("multiplier", F.lit(1.0)))
    no_cash = (F.col("asset") == cash) & (F.col("real_yield") < 0) & (F.col("tilt") > 0)
    j = j.withColumn("tilt", F.when(no_cash, 0.0).otherwise(F.col("tilt")))
    j = j.withColumns({"__t": F.sum("tilt").over(w), "__a": F.sum(F.abs("tilt")).over(w)})
    spread = F.col("tilt") - F.col("__t") * F.abs("tilt") / F.when(F.col("__a") == 0, 1.0).otherwise(F.col("__a"))
    j = j.withColumn("tilt", F.when(F.abs("__t") > 1e-9, spread).otherwise(F.col("tilt")))
    return j.filter(F.abs("tilt") > 1e-4).withColumn("tilt", rnd("tilt", digits)).drop("__t", "__a", "multiplier")


def allocation_confidence(downside: Column, forecast: Column) -> Column:
    return clip(0.55 * (1 - downside) + 0.45 * forecast, 0.05, 0.98)


def rebalance_note(profile: Column, inflation: Column, rates: Column, limit: float = 0.0005) -> Column:
    base = F.concat(F.lit("Quarterly strategic rebalance for "), profile, F.lit(" profile."))
    return (
        F.when(inflation > limit, F.concat(base, F.lit(" Inflation pressure positive: tilt toward Gold and short-duration T-Bills.")))
        .when(rates > limit, F.concat(base, F.lit(" Real-yield pressure rising: keep TBills near upper bound.")))
        .otherwise(F.concat(base, F.lit(" Macro environment neutral: keep risk budget on profile target.")))
    )


def choose_profile(df: DataFrame) -> DataFrame:
    """The book with the best sharpe + .2 conf - .65 downside - .35 breach."""
    score = F.col("sharpe") + 0.2 * F.col("confidence") - 0.65 * F.col("downside") - 0.35 * F.col("breach")
    x = df.withColumn("score", score)
    return x.groupBy().agg(F.max_by(F.struct("book", "score"), F.struct("score", "book")).alias("s")).select("s.*")
