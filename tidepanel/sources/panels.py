"""Price-like panels derived from the star-schema tables.

Each starts with a partially aggregated ``groupBy(asset, date)``: a hot asset is
collapsed to one row per day inside the map tasks, before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.expr import last_rows, series

ASSETS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
EQUITY = ("1-URGENT", "2-HIGH")
SAFE = ("4-NOT SPECIFIED", "5-LOW")
SMOOTHING_ROWS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _smooth(df: DataFrame) -> DataFrame:
    w = last_rows(series(), SMOOTHING_ROWS)
    return df.select("asset", "date", F.avg("p0").over(w).alias("price"))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price per order priority and day (trailing 60-row mean of order value)."""
    daily = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("date"))
        .agg(F.avg("o_totalprice").alias("p0"))
    )
    return _smooth(daily)


def staggered_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices with one late starter and one series that ends early."""
    late = (F.col("asset") == "5-LOW") & (F.col("date") < F.lit("1999-01-01").cast("date"))
    dead = (F.col("asset") == "4-NOT SPECIFIED") & (F.col("date") > F.lit("1999-06-30").cast("date"))
    return daily_prices(spark, sf_dir).filter(~late & ~dead)


def instrument_prices(spark: SparkSession, sf_dir: str, key: str = "p_brand") -> DataFrame:
    """Many instruments: average unit price per part attribute and ship day.

    Line items are summed per (part, day) before the join, so a part that holds a
    large share of the rows reaches the join as one row per day.
    """
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", F.to_date("l_shipdate").alias("date"))
        .agg(F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("q"))
    )
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(key).alias("asset"))
    daily = (
        items.join(part, items["l_partkey"] == part["p_partkey"])
        .groupBy("asset", "date")
        .agg((F.sum("v") / F.sum("q")).alias("p0"))
    )
    return _smooth(daily)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("asset"), "ts", "event_id", F.col("value").alias("price")
    )


def books(spark: SparkSession, sf_dir: str, by: str = "c_mktsegment") -> DataFrame:
    """Weights per book: share of order value by priority, summing to one."""
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.col("o_orderpriority").alias("asset"))
        .agg(F.sum("o_totalprice").alias("v"))
    )
    if by == "o_custkey":
        held = orders.select(F.col("o_custkey").cast("string").alias("book"), "asset", "v")
    else:
        customer = table(spark, sf_dir, "customer").select("c_custkey", F.col(by).alias("book"))
        held = (
            orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
            .groupBy("book", "asset")
            .agg(F.sum("v").alias("v"))
        )
    from tidepanel.functions.expr import whole

    # Within a book there is one row per asset, so the window is universe-sized.
    return held.select(
        "book", "asset", (F.col("v") / F.sum("v").over(whole(("book",)))).alias("w")
    )


def vendor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order values rendered as an untidy all-text vendor file.

    Carries thousands commas, ``M`` volumes, ``-`` for no volume, ``%`` changes, a
    few unreadable dates and some restated rows with a higher ``ingest_seq``.
    """
    px = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("date"))
        .agg(F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"), F.count("*").alias("n"))
        .withColumn("prev", F.lag("hi").over(series()))
    )
    day = F.dayofmonth("date")
    text = px.select(
        "asset",
        F.when((day == 13) & (F.month("date") == 6), F.lit("13/45/1999"))
        .otherwise(F.date_format("date", "MM/dd/yyyy"))
        .alias("Date"),
        F.format_number("hi", 2).alias("Price"),
        F.format_number("lo", 2).alias("Open"),
        F.format_number("hi", 2).alias("High"),
        F.format_number("lo", 2).alias("Low"),
        F.when(day % 7 == 0, F.lit("-"))
        .otherwise(F.concat(F.col("n").cast("string"), F.lit(".50M")))
        .alias("Vol."),
        F.concat(
            F.format_number(F.coalesce(F.col("hi") / F.col("prev") - 1, F.lit(0.0)) * 100, 2),
            F.lit("%"),
        ).alias("Change %"),
        F.lit(1).cast("long").alias("ingest_seq"),
        day.alias("day"),
    )
    restated = (
        text.filter("day = 10")
        .withColumn("Vol.", F.lit("7.25M"))
        .withColumn("ingest_seq", F.lit(2).cast("long"))
    )
    return text.unionByName(restated).drop("day")


def yield_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-column text yield file: day and a percentage that follows order counts."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("d"))
        .agg(F.count("*").alias("n"))
        .select(
            F.date_format("d", "MM/dd/yyyy").alias("Auction Date"),
            F.concat(F.format_number(F.col("n") * 1.25, 2), F.lit("%")).alias("Price"),
        )
    )


def benchmark_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily close of a market-wide benchmark: average unit price of all line items."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("date"))
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))
    )
