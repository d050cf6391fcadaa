"""Data-quality summaries, flags and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.expr import ann_mean, ann_vol, one_row, sample_kurtosis, sample_skew, series, whole
from tidepanel.session import small_side


def date_slice(df: DataFrame, start: str, end: str, column: str = "date") -> DataFrame:
    """Inclusive range of days. The bounds are cast to the column's own type and the
    column is left bare, so the comparison is pushed into the file scan whether it
    holds dates or timestamps."""
    kind = dict(df.dtypes)[column]
    after = F.date_add(F.lit(end).cast("date"), 1).cast(kind)
    return df.filter((F.col(column) >= F.lit(start).cast("date").cast(kind)) & (F.col(column) < after))


def fill_with_mean(df: DataFrame, col: str) -> DataFrame:
    """Missing values take the asset's full-sample mean."""
    means = small_side(df.groupBy("asset").agg(F.avg(col).alias("__m")), "means")
    return df.join(means, "asset").withColumn(col, F.coalesce(col, "__m")).drop("__m")


def summarise(df: DataFrame) -> DataFrame:
    """One pass per asset: row count, span, share of zeros and four moments."""
    r = F.col("ret")
    return df.filter(r.isNotNull()).groupBy("asset").agg(
        F.count("*").alias("n_rows"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.avg((r == 0).cast("double")).alias("zero_pct"),
        ann_mean("ret").alias("annualized_mean"),
        ann_vol("ret").alias("annualized_vol"),
        sample_skew("ret").alias("skew"),
        sample_kurtosis("ret").alias("kurtosis"),
    )


def quality_flags(df: DataFrame, stale_days: int = 30) -> DataFrame:
    """Gaps, zero share (a missing return counts as zero), staleness, duplicates.

    Rows are first folded per (asset, date), so repeated timestamps never pile up in
    one window partition.
    """
    days = df.groupBy("asset", "date").agg(
        F.count("*").alias("__n"),
        F.sum((F.coalesce("ret", F.lit(0.0)) == 0.0).cast("long")).alias("__z"),
    )
    days = days.withColumn("__gap", F.datediff("date", F.lag("date").over(series())))
    return days.groupBy("asset").agg(
        F.sum(F.col("__n") - 1).alias("duplicate_timestamps"),
        F.coalesce(F.max("__gap"), F.lit(0)).alias("max_gap_days"),
        F.coalesce(F.median("__gap"), F.lit(0.0)).alias("median_gap_days"),
        (F.sum("__z") / F.sum("__n")).alias("zero_return_pct"),
        F.coalesce(F.max("__gap") > stale_days, F.lit(False)).alias("stale_series_flag"),
    )


def quality_warnings(flags: DataFrame, overlap_days: DataFrame, missing: DataFrame, zero_limit: float = 0.30) -> DataFrame:
    """Warnings table from the flags, the strict-overlap day count (one row, column
    ``n``) and the missing-asset warnings."""
    msg = "severity", "code", "asset", "message"
    stale = flags.filter("stale_series_flag").select(
        F.lit("high").alias("severity"),
        F.lit("STALE_SERIES").alias("code"),
        "asset",
        F.concat("asset", F.lit(" has stale periods; max gap "), "max_gap_days", F.lit(" days")).alias("message"),
    )
    zeros = flags.filter(F.col("zero_return_pct") > zero_limit).select(
        F.lit("medium").alias("severity"),
        F.lit("HIGH_ZERO_RETURNS").alias("code"),
        "asset",
        F.concat("asset", F.lit(" has many zero returns")).alias("message"),
    )
    empty = overlap_days.filter("n = 0").select(
        F.lit("high").alias("severity"),
        F.lit("EMPTY_ALIGNED_PANEL").alias("code"),
        F.lit(None).cast("string").alias("asset"),
        F.lit("No date has every asset").alias("message"),
    )
    return missing.select(*msg).unionByName(stale).unionByName(zeros).unionByName(empty)


def null_audit(df: DataFrame) -> DataFrame:
    cols = [n for n in df.columns if n not in ("asset", "date")]
    return df.groupBy("asset").agg(*[F.sum(F.col(n).isNull().cast("long")).alias(f"{n}_nulls") for n in cols])


def reconcile(df: DataFrame, digits: int = 2) -> DataFrame:
    """Computed return against the vendor's change %, compared at ``digits`` places."""
    ours = F.round(F.col("ret") * 100, digits)
    return (
        df.filter("ret IS NOT NULL AND change_pct IS NOT NULL")
        .groupBy((ours == F.round("change_pct", digits)).alias("matches"))
        .agg(F.count("*").alias("n"))
    )


def provenance(df: DataFrame, rebuilt: dict[str, str], steps: tuple[str, ...] = ()) -> DataFrame:
    """Where each series comes from: raw, rebuilt by a feed, or mostly imputed; and what
    was done to it: its feed, then the ``steps`` that ran on every series."""
    seen = df.filter("ret IS NOT NULL")
    days = seen.agg(F.countDistinct("date").alias("n"))
    per = seen.groupBy("asset").agg(F.count("*").alias("effective_rows"))
    frac = 1 - F.col("effective_rows") / one_row(days, "n")
    common = [F.lit(x) for x in steps]
    done = F.array(*common).cast("array<string>")
    is_rebuilt = F.lit(False)
    for asset, step in rebuilt.items():
        hit = F.col("asset") == asset
        done = F.when(hit, F.array(F.lit(step), *common)).otherwise(done)
        is_rebuilt = is_rebuilt | hit
    return per.select(
        "asset",
        "effective_rows",
        (F.round(frac, 6) + F.lit(0.0)).alias("imputed_fraction"),
        F.when(frac > 0.5, "mostly_imputed").when(is_rebuilt, "synthetic_feed").otherwise("raw").alias("source_type"),
        F.array_join(done, ",").alias("transformations"),
    )


def histogram(df: DataFrame, bins: int = 80) -> DataFrame:
    """Equal-width bins between each asset's min and max (last bin closed), with the
    mean +- 2 sigma marks."""
    r = F.col("ret")
    ends = df.filter(r.isNotNull()).groupBy("asset").agg(
        F.min(r).alias("lo"), F.max(r).alias("hi"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    # A constant series has one bin.
    slot = F.coalesce(F.least(F.floor(F.try_divide(r - F.col("lo"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")
    return (
        df.filter(r.isNotNull())
        .join(ends, "asset")
        .groupBy("asset", slot.alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.first(F.col("lo") + slot * width).alias("bin_start"),
            F.first(F.col("m") - 2 * F.col("s")).alias("low_mark"),
            F.first(F.col("m") + 2 * F.col("s")).alias("high_mark"),
        )
    )


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy("asset", F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(whole()))


def trading_days(df: DataFrame, n_assets: int) -> DataFrame:
    """Number of dates on which every asset has a value (one row, column ``n``)."""
    full = df.groupBy("date").agg(F.count("ret").alias("k")).filter(F.col("k") == n_assets)
    return full.agg(F.count("*").alias("n"))


def last_rows_of_panel(df: DataFrame, n: int) -> DataFrame:
    """Rows on the panel's last ``n`` dates. Dates are folded to one row per day
    before they are ranked, so the ranking pass is calendar-sized."""
    days = df.select("date").distinct()
    rank = F.row_number().over(Window.orderBy(F.col("date").desc()))
    recent = days.withColumn("__r", rank).filter(F.col("__r") <= n).select("date")
    return df.join(F.broadcast(recent), "date", "left_semi")
