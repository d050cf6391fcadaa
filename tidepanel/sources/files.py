"""Reading untidy vendor files, and the sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VENDOR_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("Date", "Price", "Open", "High", "Low", "Vol.", "Change %")]
    + [T.StructField("ingest_seq", T.LongType())]
)
PRICE_COLUMNS = ("price", "open", "high", "low")
FINGERPRINT_SCHEMA = "schema_version INT, generated_at_utc STRING, fingerprint STRUCT<per_asset: ARRAY<STRUCT<asset: STRING, mean_ann: DOUBLE, vol_ann: DOUBLE, corr_ref: DOUBLE>>>"


def scan_asset_files(spark: SparkSession, root: str, catalog: DataFrame) -> DataFrame:
    """Scan every vendor file under ``root`` in one job and tag rows with the asset
    that ``catalog(folder, asset)`` lists for the file's folder.

    ``read_order`` places each row: later files after earlier ones, and within a file
    in the order of its lines, however Spark splits it."""
    raw = (
        spark.read.schema(VENDOR_SCHEMA)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .csv(root)
        .withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        .withColumn(
            "read_order",
            F.struct(
                "_metadata.file_modification_time",
                "_metadata.file_path",
                "_metadata.file_block_start",
                F.monotonically_increasing_id().alias("line"),
            ),
        )
    )
    return raw.join(catalog, "folder").drop("folder")


def missing_assets(catalog: DataFrame, loaded: DataFrame) -> DataFrame:
    """A critical warning for each catalogued asset that has no data."""
    gone = catalog.select("asset").join(loaded.select("asset").distinct(), "asset", "left_anti")
    return gone.select(
        F.lit("critical").alias("severity"),
        F.lit("MISSING_ASSET_FILE").alias("code"),
        "asset",
        F.concat(F.lit("No data found for "), "asset").alias("message"),
    )


def normalise_headers(df: DataFrame) -> DataFrame:
    """Lower case, underscores for spaces, no dots, ``pct`` for the percent sign."""

    def tidy(name: str) -> str:
        return name.strip().lower().replace(" ", "_").replace(".", "").replace("%", "pct")

    return df.toDF(*[tidy(n) for n in df.columns])


def _number(col: str, strip: str):
    return F.expr(f"try_cast(trim(regexp_replace(`{col}`, '{strip}', '')) AS DOUBLE)")


def clean_prices(df: DataFrame, start: str, end: str, unit_aware: bool = False) -> DataFrame:
    """Typed price rows from vendor text, limited to [start, end].

    ``unit_aware`` also reads K and B volume suffixes (in millions); by default only
    M is known and other suffixes give NULL.
    """
    df = normalise_headers(df)
    df = df.withColumn("date", F.expr("CAST(try_to_timestamp(`date`, 'MM/dd/yyyy') AS DATE)"))
    df = df.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    out = {n: _number(n, ",") for n in PRICE_COLUMNS if n in df.columns}
    if "vol" in df.columns:
        if unit_aware:
            digits = _number("vol", "[KMB]")
            scale = F.when(F.col("vol").endswith("K"), 1e-3).when(F.col("vol").endswith("B"), 1e3).otherwise(1.0)
            out["vol"] = digits * scale
        else:
            out["vol"] = _number("vol", "M")
    if "change_pct" in df.columns:
        out["change_pct"] = _number("change_pct", "%")
    return df.withColumns(out)


def clean_yields(df: DataFrame, start: str, end: str) -> DataFrame:
    """Two-column yield file: the first column is the date whatever it is called."""
    df = normalise_headers(df)
    df = df.withColumnRenamed(df.columns[0], "date").select("date", "price")
    df = df.withColumn("date", F.expr("CAST(try_to_timestamp(`date`, 'MM/dd/yyyy') AS DATE)"))
    df = df.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return df.withColumn("price", _number("price", "[,%]"))


def normalise_frame(df: DataFrame, keys=("asset",), seq: str = "ingest_seq", order: str = "read_order") -> DataFrame:
    """One row per (key, date): unreadable dates dropped, newest row kept, rows with no
    value at all dropped.

    Newest is by ``seq`` (rows without one come before all others), then by ``order``,
    each where the table has it; what is still tied is settled by the values, so the
    result does not depend on how rows arrive. An aggregate, not a window, so any number
    of restatements of one day collapses map-side."""
    if "date" not in df.columns:
        raise ValueError("price tables need a 'date' column")
    values = [n for n in df.columns if n not in (*keys, "date", seq, order)]
    newest = [F.col(n).alias(f"o{k}") for k, n in enumerate((seq, order)) if n in df.columns]
    latest = df.filter(F.col("date").isNotNull()).groupBy(*keys, "date").agg(F.max(F.struct(*newest, F.struct(*values).alias("v"))).alias("s"))
    return latest.select(*keys, "date", "s.v.*").dropna(how="all", subset=values)


def folder_name(asset):
    """Filesystem-safe folder for an asset (column in, column out; text likewise)."""
    if isinstance(asset, str):
        return re.sub("[^A-Za-z0-9]", "_", asset)
    return F.regexp_replace(asset, "[^A-Za-z0-9]", "_")


def write_panel(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """Partitioned parquet, clustered so each folder gets few files.

    With tens of thousands of instruments pass ``buckets``: folders then hold hash
    buckets of assets rather than one asset each.
    """
    if buckets:
        df = df.withColumn("asset_bucket", F.pmod(F.xxhash64("asset"), F.lit(buckets)).cast("int"))
        part = "asset_bucket"
    else:
        part = "asset"
    # The year spreads one asset over many tasks.
    df.repartition(F.col(part), F.year("date")).write.mode("overwrite").partitionBy(part).parquet(path)


def _json_safe(value: Column, kind: T.DataType) -> Column:
    """The value with NaN and infinities as NULL, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _json_safe(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_json_safe(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def report_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row; NaN and infinities leave as null, also inside arrays,
    maps and structs."""
    safe = [_json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("document"))


def save_sections(df: DataFrame, path: str) -> None:
    """Replace only the report sections present in ``df``; others stay as saved."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("section")
        .parquet(path)
    )


def read_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """Drift baseline rows; empty when the file is absent, unreadable or hollow."""
    empty = spark.createDataFrame([], "asset STRING, mean_ann DOUBLE, vol_ann DOUBLE, corr_ref DOUBLE")
    try:
        raw = spark.read.schema(FINGERPRINT_SCHEMA).option("mode", "PERMISSIVE").json(path)
    except Exception:  # the path does not exist
        return empty
    return raw.filter("fingerprint IS NOT NULL").select(F.inline("fingerprint.per_asset"))
