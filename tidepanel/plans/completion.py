"""Registered missing-data completion queries (iterative, so without a full SQL twin)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.expr import rnd
from tidepanel.operators import impute as I
from tidepanel.plans.alignment import UNION_CAL, staggered_returns
from tidepanel.plans.registry import SRETS, ctes, d, query, r
from tidepanel.sources.panels import ASSETS


def observed(spark, sf):
    return staggered_returns(spark, sf).filter("ret IS NOT NULL").select("asset", "date", "ret")


@query("em_01_completed_panel")
def em_01(spark, sf):
    x = observed(spark, sf)
    full = I.em_complete(x, ASSETS, I.em_fit(x, ASSETS))
    return full.select("asset", "date", rnd("ret").alias("ret"), "is_imputed")


@query("em_01b_observed_cells_kept", ctes(SRETS, UNION_CAL) + f"SELECT asset, {d()} AS date, {r('ret')} AS ret, ret IS NULL AS is_imputed FROM un")
def em_01b(spark, sf):
    """Completion must neither move nor lose an observed cell: filled ones are blanked."""
    x = observed(spark, sf)
    full = I.em_complete(x, ASSETS, I.em_fit(x, ASSETS))
    return full.select("asset", "date", rnd(F.when(~F.col("is_imputed"), F.col("ret"))).alias("ret"), "is_imputed")


@query("em_02_fitted_covariance")
def em_02(spark, sf):
    m = I.em_fit(observed(spark, sf), ASSETS)
    rows = I.covariance_rows(spark, m)
    return rows.select("asset_a", "asset_b", rnd("mu_a", 8).alias("mu_a"), rnd("v", 8).alias("v"), F.lit(m.iterations).alias("iterations"), F.lit(m.converged).alias("converged"))


@query("em_03_distributed_iterations")
def em_03(spark, sf):
    """The same fit with every E-step as a Spark job, as used for many patterns."""
    m = I.em_fit(observed(spark, sf), ASSETS, max_patterns=0)
    return I.covariance_rows(spark, m).select("asset_a", "asset_b", rnd("mu_a", 8).alias("mu_a"), rnd("v", 8).alias("v"))


STRICT_SQL = "SELECT asset, CAST(date AS VARCHAR) AS date, round(ret, 6) + 0.0 AS ret FROM srets WHERE ret IS NOT NULL AND date IN (SELECT date FROM srets GROUP BY date HAVING count(ret) = 5)"


@query("em_04_fallback_to_overlap", ctes(SRETS) + STRICT_SQL)
def em_04(spark, sf):
    panel, _ = I.completed_panel(observed(spark, sf), ASSETS, enabled=False)
    return panel.select("asset", "date", rnd("ret").alias("ret"))


@query("report_all_sections")
def report(spark, sf):
    """The full job on the staggered panel: every number of every saved section, named by
    its column and by what tells its row apart."""
    from tidepanel.plans import parameters as K
    from tidepanel.plans.report import Settings, full_report
    from tidepanel.session import fresh_path
    from tidepanel.sources import panels as P

    s = Settings(
        assets=ASSETS, roles=K.ROLES, focus=K.FOCUS, cash=K.CASH_LIKE, sinks=(K.CASH_LIKE, K.GOLD_LIKE), rf=K.RISK_FREE,
        eval_start=K.EVAL_START, cash_like=(K.CASH_LIKE,),
    )
    saved = full_report(P.staggered_prices(spark, sf), s, fresh_path(spark, "report"), K.decision_matrix(spark))
    return reduce(DataFrame.unionByName, [section_values(name, spark.read.parquet(path)) for name, path in saved.items()])


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def section_values(name: str, df: DataFrame) -> DataFrame:
    """(section, row, column, value): a saved section's numbers, one a row."""
    told = [F.col(n).cast("string") for n, t in df.dtypes if t in ("string", "date", "boolean")]
    numbers = [F.struct(F.lit(n).alias("column"), F.col(n).cast("double").alias("value")) for n, t in df.dtypes if t in NUMBERS]
    numbers = numbers or [F.struct(F.lit("present").alias("column"), F.lit(1.0).alias("value"))]
    row = F.concat_ws("|", *told) if told else F.lit("")
    return df.select(F.lit(name).alias("section"), row.alias("row"), F.inline(F.array(*numbers))).withColumn("value", rnd("value", 6))
