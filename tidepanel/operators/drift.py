"""Distribution drift: fingerprints and their comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.expr import ann_mean, ann_vol, correlation, finite
from tidepanel.operators.quality import last_rows_of_panel

REL_MEAN = 0.50
REL_VOL = 0.45
CORR_SHIFT = 0.22
MIN_JOINT = 40


def fingerprint(df: DataFrame, reference: str, tail: int | None = None) -> DataFrame:
    """(asset, mean_ann, vol_ann, corr_ref), rounded to 6 places, over the last
    ``tail`` dates. The reference asset has no correlation with itself."""
    if tail:
        df = last_rows_of_panel(df, tail)
    # One row per calendar day, so the reference series can be broadcast; the panel
    # is then only shuffled as partial aggregates per asset.
    ref = df.filter((F.col("asset") == reference) & F.col("ret").isNotNull()).select("date", F.col("ret").alias("__ref"))
    x = df.filter("ret IS NOT NULL").join(F.broadcast(ref), "date", "left")
    joint = F.count(F.when(F.col("__ref").isNotNull(), 1))
    corr = F.when((F.col("asset") != reference) & (joint >= MIN_JOINT), correlation("ret", "__ref"))
    stats = x.groupBy("asset").agg(
        F.round(ann_mean("ret"), 6).alias("mean_ann"),
        F.round(ann_vol("ret"), 6).alias("vol_ann"),
        F.round(finite(corr), 6).alias("corr_ref"),
    )
    return stats.filter("mean_ann IS NOT NULL AND vol_ann IS NOT NULL")


def write_fingerprint(fp: DataFrame, path: str, generated_at: str) -> None:
    """One JSON document; a fingerprint has one entry per asset of the universe."""
    doc = fp.groupBy().agg(F.sort_array(F.collect_list(F.struct("asset", "mean_ann", "vol_ann", "corr_ref"))).alias("per_asset"))
    doc.select(
        F.lit(1).alias("schema_version"),
        F.lit(generated_at).alias("generated_at_utc"),
        F.struct("per_asset").alias("fingerprint"),
    ).coalesce(1).write.mode("overwrite").json(path)


def violations(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(type, asset, delta, threshold): relative mean and volatility shifts and
    absolute correlation shifts beyond their limits. A zero or absent baseline
    value is not compared."""
    b = baseline.select("asset", F.col("mean_ann").alias("bm"), F.col("vol_ann").alias("bv"), F.col("corr_ref").alias("bc"))
    j = current.join(b, "asset")

    def rel(now: str, was: str):
        gap = F.abs(F.col(now) - F.col(was)) / F.greatest(F.abs(F.col(was)), F.lit(1e-6))
        return F.when(F.col(was) != 0, gap)

    checks = F.array(
        F.struct(F.lit("mean_shift").alias("type"), rel("mean_ann", "bm").alias("delta"), F.lit(REL_MEAN).alias("threshold")),
        F.struct(F.lit("vol_shift").alias("type"), rel("vol_ann", "bv").alias("delta"), F.lit(REL_VOL).alias("threshold")),
        F.struct(F.lit("correlation_shift").alias("type"), F.abs(F.col("corr_ref") - F.col("bc")).alias("delta"), F.lit(CORR_SHIFT).alias("threshold")),
    )
    return (
        j.select("asset", F.inline(checks))
        .filter(F.col("delta") > F.col("threshold"))
        .select("type", "asset", F.round("delta", 4).alias("delta"), "threshold")
    )


def status(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """ok / warning / alert, or no_baseline when there is nothing to compare with."""
    moved = F.col("type").isin("mean_shift", "vol_shift")
    n = baseline.agg(F.count("*").alias("n")).scalar()
    return found.agg(
        F.count("*").alias("n_violations"),
        F.max(moved.cast("int")).alias("moved"),
    ).select(
        F.when(n == 0, "no_baseline")
        .when(F.col("n_violations") == 0, "ok")
        .when(F.col("moved") == 1, "alert")
        .otherwise("warning")
        .alias("status"),
        "n_violations",
    )
