"""Calendar alignment, universe selection and set operations on long panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.expr import one_row, ratio, series, to_date_rows

# A wide row holds one cell per asset; beyond this the long form is used instead.
MAX_WIDE_ASSETS = 64


def universe(df: DataFrame, wanted: Sequence[str] | None = None, limit: int = MAX_WIDE_ASSETS) -> list[str]:
    """Asset names in order, checked against ``limit`` before they reach the driver."""
    if wanted is not None:
        return list(wanted)
    rows = df.select("asset").distinct().orderBy("asset").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} assets: use the long-form operators")
    return [row["asset"] for row in rows]


def select_universe(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Keep the wanted assets that exist, tagged with their place in the list."""
    spark = df.sparkSession
    names = spark.createDataFrame([(a, i) for i, a in enumerate(wanted)], "asset STRING, place INT")
    return df.join(F.broadcast(names), "asset")


def available(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted assets that the panel holds."""
    return wanted.select("asset").intersect(df.select("asset"))


def with_sleeve(df: DataFrame, sleeve: DataFrame, name: str) -> DataFrame:
    """Append one more return series (for example a currency) as an asset."""
    return df.select("asset", "date", "ret").unionByName(sleeve.select(F.lit(name).alias("asset"), "date", "ret"))


def wide(df: DataFrame, assets: Sequence[str], value: str = "ret", keys: Sequence[str] = ()) -> DataFrame:
    """One row per date with a cell per asset (a0, a1, ...); (asset, date) is unique.

    The cell list is known up front, so this is one aggregation without a job to
    discover pivot values.
    """
    cells = [F.max(F.when(F.col("asset") == a, F.col(value))).alias(f"a{i}") for i, a in enumerate(assets)]
    return df.filter(F.col("asset").isin(*assets)).groupBy(*keys, "date").agg(*cells)


def union_calendar(df: DataFrame, assets: Sequence[str], value: str = "ret") -> DataFrame:
    """Every date any asset has, for every asset, with NULL where there is no value.

    Each date row carries its own values in a map and fans out over the asset list:
    the same result as dates x assets LEFT JOIN values, without the product or join.
    """
    by_date = df.filter(F.col("asset").isin(*assets)).groupBy("date").agg(
        F.map_from_entries(F.collect_list(F.struct("asset", value))).alias("m")
    )
    fan = F.explode(F.array(*[F.lit(a) for a in assets])).alias("asset")
    return by_date.select("date", "m", fan).select("asset", "date", F.try_element_at("m", F.col("asset")).alias(value))


def strict_overlap(df: DataFrame, n_assets: int) -> DataFrame:
    """Rows on dates where every asset has a value.

    The full dates are a map-side-combined count with at most one row per calendar
    day, so they are broadcast and the panel itself is not shuffled.
    """
    return df.join(F.broadcast(full_days(df, n_assets)), "date", "left_semi")


def full_days(df: DataFrame, n_assets: int) -> DataFrame:
    counts = df.groupBy("date").agg(F.count("ret").alias("n"))
    return counts.filter(F.col("n") == n_assets).select("date")


def forward_fill(df: DataFrame, limit: int | None = 3, value: str = "ret") -> DataFrame:
    """Carry the last value over at most ``limit`` missing rows (no limit if None)."""
    w = series()
    frame = to_date_rows(w) if limit is None else w.rowsBetween(-limit, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(frame))


def common_start(df: DataFrame, n_assets: int) -> DataFrame:
    """The panel from its first fully observed date on."""
    first = full_days(df, n_assets).agg(F.min("date").alias("d"))
    return df.filter(F.col("date") >= one_row(first, "d"))


def reindex(df: DataFrame, calendar: DataFrame, fill: float | None = 0.0, value: str = "ret") -> DataFrame:
    """One date-keyed series on the full calendar: gaps filled with a constant, or
    carried forward when ``fill`` is None."""
    out = calendar.select("date").join(df.select("date", value), "date", "left")
    if fill is not None:
        return out.withColumn(value, F.coalesce(value, F.lit(fill)))
    # One row per calendar day: a bounded, single ordered pass.
    frame = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(value, F.last(value, ignorenulls=True).over(frame))


def covariance_panel(df: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Wide rows for covariance: complete rows, or, when there are fewer than
    max(20, 2p) of them, all rows with any value and 0 for the missing cells."""
    p = len(assets)
    names = [f"a{i}" for i in range(p)]
    rows = wide(df, assets)
    present = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    rows = rows.withColumn("__k", present).filter(F.col("__k") > 0)
    complete = F.sum((F.col("__k") == p).cast("long"))
    enough = one_row(rows.agg(F.coalesce(complete, F.lit(0)).alias("n")), "n") >= max(20, 2 * p)
    kept = rows.filter((F.col("__k") == p) | ~enough)
    return kept.select("date", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def pattern_census(df: DataFrame, assets: Sequence[str]) -> DataFrame:
    """How often each set of present assets occurs."""
    rows = wide(df, assets)
    label = F.concat_ws("|", *[F.when(F.col(f"a{i}").isNotNull(), F.lit(a)) for i, a in enumerate(assets)])
    return rows.groupBy(label.alias("pattern")).agg(F.count("*").alias("n_rows"))


def concat_segments(df: DataFrame, order: str = "segment", keys: Sequence[str] = ("book",)) -> DataFrame:
    """Stack segments; a date that occurs twice keeps the later segment's row."""
    values = [n for n in df.columns if n not in (*keys, "date")]
    last = F.max_by(F.struct(*values), F.col(order)).alias("s")
    return df.groupBy(*keys, "date").agg(last).select(*keys, "date", "s.*")


def restore_columns(df: DataFrame, assets: Sequence[str], min_rows: int) -> DataFrame:
    """Assets with too few observations leave the model but stay in the schema: their
    rows return with NULL in place of the value; an asset without any row gets one for
    every date of the panel."""
    n = F.count("ret").over(Window.partitionBy("asset"))
    kept = df.withColumn("ret", F.when(n >= min_rows, F.col("ret")))
    wanted = df.select("date").distinct().select(F.explode(F.array(*[F.lit(a) for a in assets])).alias("asset"), "date")
    absent = wanted.join(df.select("asset").distinct(), "asset", "left_anti")
    return kept.unionByName(absent, allowMissingColumns=True)


def approximately_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tol: float) -> DataFrame:
    """Whether two keyed series agree everywhere within ``tol`` (absent counts as 0)."""
    gap = F.abs(F.coalesce(F.col("va"), F.lit(0.0)) - F.coalesce(F.col("vb"), F.lit(0.0)))
    left = a.select(*keys, F.col(value).alias("va"))
    right = b.select(*keys, F.col(value).alias("vb"))
    return left.join(right, list(keys), "full_outer").agg(
        F.count("*").alias("n_keys"),
        F.max(gap).alias("max_gap"),
        (F.max(gap) <= tol).alias("equal"),
    )


def present_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per-asset feature mask (a feature counts when it has any value), keeping the
    rows on which every feature of the asset's own mask is a finite number."""
    w = Window.partitionBy("asset")
    has = {f"__has_{f}": (F.count(f).over(w) > 0) for f in features}
    df = df.withColumns(has)
    bad = F.lit(False)
    for f in features:
        x = F.col(f)
        hole = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        bad = bad | (F.col(f"__has_{f}") & hole)
    mask = F.concat_ws(",", *[F.when(F.col(f"__has_{f}"), F.lit(f)) for f in features])
    return df.filter(~bad).withColumn("features", mask).drop(*has)


# The helpers below take panels with one row per key and day (see normalise_frame), so
# a key's rows fit one task and are read once, without a join back to the aggregate.


def clip_train(df: DataFrame, col: str, is_train: Column, lo: float = 0.01, hi: float = 0.99, keys=("asset",)) -> DataFrame:
    """Clip train and test rows to quantiles learnt on the train rows only."""
    x = F.when(is_train, F.col(col))
    bounds = F.percentile(x, F.array(F.lit(lo), F.lit(hi))).over(Window.partitionBy(*keys))
    out = df.withColumn("__b", bounds)
    return out.withColumn(col, F.least(F.greatest(F.col(col), F.col("__b")[0]), F.col("__b")[1])).drop("__b")


def scale_train(df: DataFrame, col: str, is_train: Column, out: str, keys=("asset",)) -> DataFrame:
    """Standardise by the train rows' mean and population deviation (0 counts as 1)."""
    x = F.when(is_train, F.col(col))
    w = Window.partitionBy(*keys)
    stats = {"__m": F.avg(x).over(w), "__s": F.stddev_pop(x).over(w)}
    z = (F.col(col) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    return df.withColumns(stats).withColumn(out, z).drop("__m", "__s")


def quantile_clip(df: DataFrame, col: str = "ret", lo: float = 0.005, hi: float = 0.995, keys=("asset",), out: str | None = None) -> DataFrame:
    bounds = F.percentile(col, F.array(F.lit(lo), F.lit(hi))).over(Window.partitionBy(*keys))
    clipped = F.when(F.col(col).isNotNull(), F.least(F.greatest(F.col(col), F.col("__b")[0]), F.col("__b")[1]))
    return df.withColumn("__b", bounds).withColumn(out or col, clipped).drop("__b")


def split_adjust(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Scale prices before each split day by price(split day) / price(day before)."""
    w = series()
    marked = df.join(splits.select("asset", F.col("split_date").alias("date"), F.lit(True).alias("__s")), ["asset", "date"], "left")
    factor = F.when(F.col("__s"), ratio("price", F.lag("price").over(w)))
    marked = marked.withColumn("__f", factor)
    later = F.product(F.coalesce("__f", F.lit(1.0))).over(w.rowsBetween(1, Window.unboundedFollowing))
    return marked.withColumn("factor", F.coalesce(later, F.lit(1.0))).withColumn(
        "adjusted", F.col("price") * F.col("factor")
    ).drop("__s", "__f")
