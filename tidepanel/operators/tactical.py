"""Rule-based tactical signals. Every function is a projection or a small join over
rows that already carry their inputs; the date is a column, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.expr import clip


def strategic_bias(weights: DataFrame, roles: DataFrame, margin: float = 0.05) -> DataFrame:
    """bullish / defensive / neutral per book from its equity and safe weight."""
    j = weights.join(F.broadcast(roles), "asset", "left")
    s = j.groupBy("book").agg(
        F.sum(F.when(F.col("role") == "equity", F.col("w")).otherwise(0.0)).alias("equity_weight"),
        F.sum(F.when(F.col("role") == "safe", F.col("w")).otherwise(0.0)).alias("safe_weight"),
    )
    eq, safe = F.col("equity_weight"), F.col("safe_weight")
    bias = F.when(eq > safe + margin, "bullish").when(safe > eq + margin, "defensive").otherwise("neutral")
    return s.withColumn("bias", bias)


def in_rebalance_window(as_of: Column, next_rebalance: Column, days: int = 14) -> Column:
    return F.datediff(next_rebalance, as_of).between(0, days)


def vol_target_size(vol: Column, target: float) -> Column:
    return F.when(vol <= 1e-6, 1.0).otherwise(clip(F.try_divide(F.lit(target), vol), 0.20, 1.50))


def quality_scale(warnings: DataFrame, flags: DataFrame) -> DataFrame:
    """One row ``scale``: confidence multiplier for the panel's warnings. Critical
    ones are reported but cost nothing."""
    w = warnings.agg(
        F.sum((F.lower("severity") == "high").cast("int")).alias("high"),
        F.sum((F.lower("severity") == "medium").cast("int")).alias("medium"),
    )
    stale = flags.agg(F.sum(F.col("stale_series_flag").cast("int")).alias("n")).scalar()
    n = F.coalesce(stale, F.lit(0))
    raw = F.pow(F.lit(0.94), F.coalesce("high", F.lit(0))) * F.pow(F.lit(0.97), F.coalesce("medium", F.lit(0)))
    raw = raw * F.when(n > 0, F.greatest(F.lit(0.72), 1 - 0.035 * n)).otherwise(1.0)
    return w.select(clip(raw, 0.62, 1.0).alias("scale"))


def blend(classifier: Column, momentum: Column) -> Column:
    """0.6 / 0.4 vote, halves to even, within -1..1."""
    return clip(F.rint(0.6 * classifier + 0.4 * momentum), -1, 1).cast("int")


def decide(df: DataFrame, target_vol: float = 0.18) -> DataFrame:
    """Signal, confidence and size from the classifier, momentum and regime.

    Reads cls_signal, cls_confidence, mom_signal, mom_strength, regime, risk_off,
    realized_vol, long_vol, regime_drawdown, bias, as_of, next_rebalance, rsi and
    quality_scale.
    """
    risk_off = F.col("risk_off")
    df = df.withColumn("__s0", blend(F.col("cls_signal"), F.col("mom_signal")))
    fights = ~risk_off & (F.col("regime") == "bear_trend") & (F.col("__s0") > 0)
    df = df.withColumns(
        {
            "__s1": F.when(risk_off, -1).when(fights, 0).otherwise(F.col("__s0")),
            "__c1": F.when(risk_off, F.greatest("cls_confidence", F.lit(0.7)))
            .when(fights, F.col("cls_confidence") * 0.85)
            .otherwise(F.col("cls_confidence")),
        }
    )
    df = align_with_strategy(df, "__s1", "__c1")
    size = vol_target_size(F.col("realized_vol"), target_vol)
    size = F.when(F.col("signal") == -1, size * 0.5).otherwise(size)
    size = F.when(risk_off, F.least(size, F.lit(0.3))).otherwise(size)
    df = df.withColumns({"size": size, "confidence": clip(F.col("confidence") * F.col("quality_scale"), 0.05, 0.98)})
    return df.drop("__s0", "__s1", "__c1")


def align_with_strategy(df: DataFrame, signal: str, confidence: str) -> DataFrame:
    """Near a rebalance, reward signals that agree with the book's bias, penalise the
    rest, and drop a long signal against a defensive book. Also the replay step for
    a stored signal against another book's weights."""
    s, c, bias = F.col(signal), F.col(confidence), F.col("bias")
    active = F.coalesce(in_rebalance_window(F.col("as_of"), F.col("next_rebalance")), F.lit(False))
    agrees = ((bias == "bullish") & (s >= 0)) | ((bias == "defensive") & (s <= 0)) | (bias == "neutral")
    adjusted = clip(c * F.when(agrees, 1.10).otherwise(0.85), 0.05, 0.98)
    drop = active & ~agrees & (s == 1) & (bias == "defensive")
    return df.withColumns(
        {
            "rebalance_window_active": active,
            "signal": F.when(drop, 0).otherwise(s),
            "confidence": F.when(active, adjusted).otherwise(c),
        }
    )


def rationale(df: DataFrame) -> DataFrame:
    """The reasons behind a decision as a list of short strings."""
    f3 = lambda n: F.format_string("%.3f", F.col(n))
    parts = [
        F.concat(F.lit("Regime="), "regime"),
        F.concat(F.lit("RealizedVolAnn="), f3("realized_vol")),
        F.concat(F.lit("LongVolAnn="), f3("long_vol")),
        F.concat(F.lit("Drawdown="), f3("regime_drawdown")),
        F.concat(F.lit("Classifier="), F.col("cls_signal").cast("string")),
        F.concat(F.lit("MomentumSignal="), F.col("mom_signal").cast("string")),
        F.concat(F.lit("MomentumStrength="), f3("mom_strength")),
        F.concat(F.lit("RSI="), F.format_string("%.2f", F.coalesce("rsi", F.lit(50.0)))),
        F.concat(F.lit("RebalanceWindow="), F.initcap(F.col("rebalance_window_active").cast("string"))),
        F.concat(F.lit("PanelQualityScale="), f3("quality_scale")),
    ]
    return df.withColumn("rationale", F.array(*parts))
