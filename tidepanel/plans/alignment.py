"""Registered scan, projection, alignment-join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.expr import clip, correlation, rnd, series
from tidepanel.operators import align as A
from tidepanel.operators import features as X
from tidepanel.operators import macro as M
from tidepanel.plans import parameters as K
from tidepanel.plans.registry import INSTRUMENTS, PRICES, RETS, SRETS, W, ctes, d, once, query, r, returns_cte, values
from tidepanel.session import fresh_path
from tidepanel.sources import files as S
from tidepanel.sources import panels as P
from tidepanel.sources.panels import ASSETS


def returns(spark, sf):
    return once("returns", sf, lambda: X.simple_return(P.daily_prices(spark, sf)))


def staggered_returns(spark, sf):
    return once("staggered", sf, lambda: X.simple_return(P.staggered_prices(spark, sf)))


# --- sources ----------------------------------------------------------------

VENDOR = f"""
v0 AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS hi, min(o_totalprice) AS lo, count(*) AS n FROM orders GROUP BY 1, 2),
v1 AS (SELECT *, lag(hi) OVER ({W}) AS prev FROM v0),
v2 AS (SELECT asset, CASE WHEN day(date) = 13 AND month(date) = 6 THEN '13/45/1999' ELSE strftime(date, '%m/%d/%Y') END AS date_text,
  format('{{:,.2f}}', hi) AS price_text, format('{{:,.2f}}', lo) AS open_text,
  CASE WHEN day(date) % 7 = 0 THEN '-' ELSE CAST(n AS VARCHAR) || '.50M' END AS vol_text,
  format('{{:,.2f}}', coalesce(hi / prev - 1, 0.0) * 100) || '%' AS change_text, CAST(1 AS BIGINT) AS ingest_seq, day(date) AS dom FROM v1),
vendor AS (SELECT asset, date_text, price_text, open_text, vol_text, change_text, ingest_seq FROM v2
  UNION ALL SELECT asset, date_text, price_text, open_text, '7.25M', change_text, 2 FROM v2 WHERE dom = 10),
cleaned AS (SELECT asset, CAST(try_strptime(date_text, '%m/%d/%Y') AS DATE) AS date,
  TRY_CAST(trim(replace(price_text, ',', '')) AS DOUBLE) AS price, TRY_CAST(trim(replace(open_text, ',', '')) AS DOUBLE) AS open,
  TRY_CAST(trim(replace(vol_text, 'M', '')) AS DOUBLE) AS vol, TRY_CAST(trim(replace(change_text, '%', '')) AS DOUBLE) AS change_pct, ingest_seq FROM vendor)
"""
START, END = "1995-06-01", "2000-12-31"


@query(
    "src_01_multi_file_scan",
    ctes(VENDOR) + "SELECT asset, count(*) AS n_rows, min(price_text) AS first_price_text, CAST(sum(ingest_seq) AS BIGINT) AS seq_sum FROM vendor GROUP BY asset",
)
def src_01(spark, sf):
    root = fresh_path(spark, "vendor")
    text = P.vendor_text(spark, sf)
    text.withColumn("key", S.folder_name(F.col("asset"))).drop("asset").write.partitionBy("key").option("header", True).csv(root)
    catalog = spark.createDataFrame([("key=" + S.folder_name(a), a) for a in ASSETS], "folder STRING, asset STRING")
    raw = S.scan_asset_files(spark, root, F.broadcast(catalog))
    return raw.groupBy("asset").agg(
        F.count("*").alias("n_rows"), F.min("Price").alias("first_price_text"), F.sum("ingest_seq").alias("seq_sum")
    )


@query(
    "src_02_missing_files",
    f"WITH {values('cat', 'asset', [(a,) for a in (*ASSETS, '6-ABSENT')])} SELECT 'critical' AS severity, 'MISSING_ASSET_FILE' AS code, asset, 'No data found for ' || asset AS message FROM cat WHERE asset NOT IN (SELECT o_orderpriority FROM orders)",
)
def src_02(spark, sf):
    catalog = spark.createDataFrame([(a,) for a in (*ASSETS, "6-ABSENT")], "asset STRING")
    return S.missing_assets(catalog, P.daily_prices(spark, sf))


@query(
    "src_03_clean_price_text",
    ctes(VENDOR) + f"SELECT asset, {d()} AS date, price, open, vol, change_pct, ingest_seq FROM cleaned WHERE date BETWEEN DATE '{START}' AND DATE '{END}'",
)
def src_03(spark, sf):
    return S.clean_prices(P.vendor_text(spark, sf), START, END).select("asset", "date", "price", "open", "vol", "change_pct", "ingest_seq")


@query(
    "src_04_clean_yield_text",
    f"WITH y AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) * 1.25 AS v FROM orders GROUP BY 1) SELECT {d()} AS date, CAST(v AS DOUBLE) AS price FROM y WHERE date BETWEEN DATE '{START}' AND DATE '{END}'",
)
def src_04(spark, sf):
    return S.clean_yields(P.yield_text(spark, sf), START, END)


@query(
    "src_05_normalise_frame",
    ctes(VENDOR, "k AS (SELECT *, row_number() OVER (PARTITION BY asset, date ORDER BY ingest_seq DESC) AS rn FROM cleaned WHERE date IS NOT NULL)")
    + f"SELECT asset, {d()} AS date, price, vol FROM k WHERE rn = 1 AND NOT (price IS NULL AND vol IS NULL)",
)
def src_05(spark, sf):
    clean = S.clean_prices(P.vendor_text(spark, sf), "1900-01-01", "2999-12-31")
    return S.normalise_frame(clean.select("asset", "date", "price", "vol", "ingest_seq"))


@query("src_06_write_panel", ctes(RETS) + "SELECT asset, CAST(year(date) AS INTEGER) AS year, count(*) AS n_rows FROM rets GROUP BY 1, 2")
def src_06(spark, sf):
    path = fresh_path(spark, "panel")
    S.write_panel(returns(spark, sf), path)
    return spark.read.parquet(path).groupBy("asset", F.year("date").alias("year")).agg(F.count("*").alias("n_rows"))


@query(
    "src_07_report_json",
    ctes(RETS, "s AS (SELECT asset, count(ret) AS n, stddev_samp(ret) FILTER (ret > 9) AS none FROM rets GROUP BY asset)")
    + """SELECT '{"asset":"' || asset || '","n":' || n || ',"spread":null}' AS document FROM s""",
)
def src_07(spark, sf):
    s = returns(spark, sf).groupBy("asset").agg(F.count("ret").alias("n"), (F.sum("ret") * float("nan")).alias("spread"))
    path = fresh_path(spark, "report")
    S.report_rows(s).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "document")


@query(
    "src_08_keep_absent_sections",
    ctes(RETS) + "SELECT 'backtest' AS section, count(*) AS n_rows FROM rets UNION ALL SELECT 'panel' AS section, 2 * count(*) AS n_rows FROM rets",
)
def src_08(spark, sf):
    path = fresh_path(spark, "sections")
    n = returns(spark, sf).agg(F.count("*").alias("n_rows"))
    both = n.select(F.explode(F.array(F.lit("backtest"), F.lit("panel"))).alias("section"), "n_rows")
    S.save_sections(both, path)
    S.save_sections(n.select(F.lit("panel").alias("section"), (F.col("n_rows") * 2).alias("n_rows")), path)
    return spark.read.parquet(path).select("section", "n_rows")


@query(
    "src_09_baseline_read",
    ctes(RETS) + f"SELECT asset, {r('avg(ret) * 252')} AS mean_ann, {r('stddev_samp(ret) * sqrt(252.0)')} AS vol_ann FROM rets GROUP BY asset",
)
def src_09(spark, sf):
    from tidepanel.operators import drift as D

    path = fresh_path(spark, "baseline")
    D.write_fingerprint(D.fingerprint(returns(spark, sf), K.FOCUS), path, "1999-01-01T00:00:00Z")
    absent = S.read_fingerprint(spark, path + "-absent")
    return S.read_fingerprint(spark, path).unionByName(absent).select("asset", rnd("mean_ann").alias("mean_ann"), rnd("vol_ann").alias("vol_ann"))


BENCH = """
bm0 AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem GROUP BY 1),
bm AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS bench FROM bm0)
"""


def benchmark_returns(spark, sf):
    px = P.benchmark_prices(spark, sf).select(F.lit("benchmark").alias("asset"), "date", F.col("close").alias("price"))
    return X.simple_return(px).select("date", F.col("ret").alias("bench"))


@query("src_10_benchmark_table", ctes(RETS, BENCH) + f"SELECT asset, {d('rets.date')} AS date, {r('ret')} AS ret, {r('bench')} AS bench FROM rets LEFT JOIN bm ON rets.date = bm.date")
def src_10(spark, sf):
    return returns(spark, sf).join(benchmark_returns(spark, sf), "date", "left").select("asset", "date", rnd("ret").alias("ret"), rnd("bench").alias("bench"))


# --- projections ------------------------------------------------------------


@query(
    "prj_01_date_slice",
    f"SELECT o_orderpriority AS asset, {d('CAST(o_orderdate AS DATE)')} AS date, count(*) AS n, max(o_totalprice) AS hi FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1998-03-31' GROUP BY 1, 2",
)
def prj_01(spark, sf):
    from tidepanel.operators.quality import date_slice

    orders = date_slice(P.table(spark, sf, "orders"), "1997-03-01", "1998-03-31", "o_orderdate")
    day = F.to_date("o_orderdate").alias("date")
    return orders.groupBy(F.col("o_orderpriority").alias("asset"), day).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("hi"))


@query("prj_02_fixed_winsor", ctes(RETS) + f"SELECT asset, {d()} AS date, {r('CASE WHEN ret IS NOT NULL THEN greatest(-0.30, least(0.30, 20*ret)) END')} AS ret FROM rets")
def prj_02(spark, sf):
    return returns(spark, sf).select("asset", "date", rnd(clip(F.col("ret") * 20, -0.30, 0.30)).alias("ret"))


@query(
    "prj_03_quantile_winsor",
    ctes(RETS, "b AS (SELECT asset, quantile_cont(ret, 0.005) AS lo, quantile_cont(ret, 0.995) AS hi FROM rets GROUP BY asset)")
    + f"SELECT asset, {d()} AS date, {r('CASE WHEN ret IS NOT NULL THEN least(greatest(ret, lo), hi) END')} AS ret FROM rets JOIN b USING (asset)",
)
def prj_03(spark, sf):
    return A.quantile_clip(returns(spark, sf)).select("asset", "date", rnd("ret").alias("ret"))


_TRAIN = f"tr AS (SELECT asset, date, ret, row_number() OVER ({W}) <= 0.6 * count(*) OVER (PARTITION BY asset) AS is_train FROM rets WHERE ret IS NOT NULL)"


def _train_rows(spark, sf):
    from tidepanel.functions.expr import whole

    x = returns(spark, sf).filter("ret IS NOT NULL")
    return x.withColumn("is_train", F.row_number().over(series()) <= F.count("*").over(whole()) * 0.6)


@query(
    "prj_04_train_only_winsor",
    ctes(RETS, _TRAIN, "b AS (SELECT asset, quantile_cont(ret, 0.01) FILTER (is_train) AS lo, quantile_cont(ret, 0.99) FILTER (is_train) AS hi FROM tr GROUP BY asset)")
    + f"SELECT asset, {d()} AS date, is_train, {r('least(greatest(ret, lo), hi)')} AS ret FROM tr JOIN b USING (asset)",
)
def prj_04(spark, sf):
    x = A.clip_train(_train_rows(spark, sf), "ret", F.col("is_train"))
    return x.select("asset", "date", "is_train", rnd("ret").alias("ret"))


@query(
    "prj_05_train_only_scaling",
    ctes(RETS, _TRAIN, "b AS (SELECT asset, avg(ret) FILTER (is_train) AS m, stddev_pop(ret) FILTER (is_train) AS s FROM tr GROUP BY asset)")
    + f"SELECT asset, {d()} AS date, {r('(ret - m) / CASE WHEN s > 0 THEN s ELSE 1 END', 5)} AS z FROM tr JOIN b USING (asset)",
)
def prj_05(spark, sf):
    x = A.scale_train(_train_rows(spark, sf), "ret", F.col("is_train"), "z")
    return x.select("asset", "date", rnd("z", 5).alias("z"))


@query("prj_06_fill_mean_volume", ctes(VENDOR) + f"SELECT asset, {d()} AS date, ingest_seq, {r('coalesce(vol, avg(vol) OVER (PARTITION BY asset))', 5)} AS vol FROM cleaned WHERE date IS NOT NULL")
def prj_06(spark, sf):
    from tidepanel.operators.quality import fill_with_mean

    clean = S.clean_prices(P.vendor_text(spark, sf), "1900-01-01", "2999-12-31")
    return fill_with_mean(clean, "vol").select("asset", "date", "ingest_seq", rnd("vol", 5).alias("vol"))


@query(
    "prj_07_feature_presence",
    ctes(RETS, f"""x AS (SELECT asset, date, lag(ret) OVER ({W}) AS f1, CASE WHEN asset <> '5-LOW' THEN lag(ret, 3) OVER ({W}) END AS f2 FROM rets),
m AS (SELECT *, count(f1) OVER (PARTITION BY asset) > 0 AS h1, count(f2) OVER (PARTITION BY asset) > 0 AS h2 FROM x)""")
    + f"SELECT asset, {d()} AS date, CASE WHEN h1 AND h2 THEN 'f1,f2' WHEN h1 THEN 'f1' WHEN h2 THEN 'f2' ELSE '' END AS features, {r('f1')} AS f1, {r('f2')} AS f2 FROM m WHERE NOT (h1 AND f1 IS NULL) AND NOT (h2 AND f2 IS NULL)",
)
def prj_07(spark, sf):
    w = series()
    x = returns(spark, sf).select(
        "asset", "date", F.lag("ret").over(w).alias("f1"), F.when(F.col("asset") != "5-LOW", F.lag("ret", 3).over(w)).alias("f2")
    )
    return A.present_features(x, ["f1", "f2"]).select("asset", "date", "features", rnd("f1").alias("f1"), rnd("f2").alias("f2"))


@query("prj_08_drop_columns", ctes(VENDOR) + f"SELECT asset, {d()} AS date, price FROM cleaned WHERE date IS NOT NULL")
def prj_08(spark, sf):
    clean = S.clean_prices(P.vendor_text(spark, sf), "1900-01-01", "2999-12-31")
    return clean.drop("open", "high", "low", "vol", "change_pct", "ingest_seq")


@query(
    "prj_09_split_adjustment",
    ctes(PRICES, f"""sp AS (SELECT asset, min(date) AS date FROM prices WHERE year(date) IN (1998, 2000) GROUP BY asset, year(date)),
f AS (SELECT p.asset, p.date, p.price, CASE WHEN sp.date IS NOT NULL THEN price / lag(price) OVER (PARTITION BY p.asset ORDER BY p.date) END AS f FROM prices p LEFT JOIN sp ON p.asset = sp.asset AND p.date = sp.date)""")
    + f"SELECT asset, {d()} AS date, {r(f'coalesce(product(coalesce(f, 1.0)) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0)')} AS factor FROM f",
)
def prj_09(spark, sf):
    px = P.daily_prices(spark, sf)
    splits = px.filter(F.year("date").isin(1998, 2000)).groupBy("asset", F.year("date")).agg(F.min("date").alias("split_date"))
    return A.split_adjust(px, splits).select("asset", "date", rnd("factor").alias("factor"))


def _fx_case(log=True):
    return _interp_sql("date", K.FX_ANCHORS, log)


def _interp_sql(col, anchors, log=False):
    f = (lambda x: f"ln(CAST({x!r} AS DOUBLE))") if log else (lambda x: f"CAST({x!r} AS DOUBLE)")
    parts = [f"WHEN {col} <= DATE '{anchors[0][0]}' THEN CAST({anchors[0][1]!r} AS DOUBLE)"]
    for (d0, v0), (d1, v1) in zip(anchors, anchors[1:]):
        e = f"{f(v0)} + ({f(v1)} - {f(v0)}) * ((CAST({col} AS DATE) - DATE '{d0}') / CAST({(d1 - d0).days} AS DOUBLE))"
        parts.append(f"WHEN {col} <= DATE '{d1}' THEN " + (f"exp({e})" if log else e))
    return "CASE " + " ".join(parts) + f" ELSE CAST({anchors[-1][1]!r} AS DOUBLE) END"


CAL = "cal AS (SELECT DISTINCT date FROM rets)"
FX = f"""fx0 AS (SELECT date, {_fx_case()} AS level FROM cal),
fx AS (SELECT date, level, greatest(-0.30, least(0.40, coalesce(level / lag(level) OVER (ORDER BY date) - 1, 0.0))) AS fx_ret FROM fx0)"""


def calendar(df):
    return df.select("date").distinct()


def fx_levels(df):
    return M.fx_returns(calendar(df).withColumn("level", M.interpolate(F.col("date"), K.FX_ANCHORS, log=True)))


@query(
    "prj_10_universe_with_sleeve",
    ctes(RETS, CAL, FX)
    + f"SELECT asset, {d()} AS date, {r('ret')} AS ret FROM rets WHERE asset IN ('5-LOW', '1-URGENT', '2-HIGH') UNION ALL SELECT 'FX' AS asset, {d()} AS date, {r('fx_ret')} AS ret FROM fx",
)
def prj_10(spark, sf):
    x = returns(spark, sf)
    picked = A.select_universe(x, ["5-LOW", "1-URGENT", "2-HIGH", "NOT-THERE"])
    sleeve = fx_levels(x).select("date", F.col("fx_ret").alias("ret"))
    return A.with_sleeve(picked, sleeve, "FX").select("asset", "date", rnd("ret").alias("ret"))


SCHED = values("sched", "y0, y1, yld", K.YIELD_SCHEDULE)
YIELDS = f"yl AS (SELECT date, coalesce((SELECT yld FROM sched WHERE year(date) BETWEEN y0 AND y1), CAST(0.255 AS DOUBLE)) AS yld FROM cal)"


@query("prj_11_yield_to_daily", ctes(RETS, CAL, SCHED, YIELDS) + f"SELECT {d()} AS date, {r('pow(1 + yld, 1.0/252) - 1', 8)} AS rf_daily FROM yl")
def prj_11(spark, sf):
    y = M.yield_on(calendar(returns(spark, sf)), K.schedule(spark))
    return y.select("date", rnd(M.daily_holding_return(F.col("yield")), 8).alias("rf_daily"))


@query("prj_12_real_return", ctes(RETS, CAL, FX) + f"SELECT asset, {d('rets.date')} AS date, {r('(1 + ret) / (1 + fx_ret) - 1')} AS usd_real FROM rets JOIN fx ON rets.date = fx.date")
def prj_12(spark, sf):
    x = returns(spark, sf)
    j = x.join(fx_levels(x), "date")
    return j.select("asset", "date", rnd(M.real_return(F.col("ret"), F.col("fx_ret"))).alias("usd_real"))


# Inflation known on month ends only, so that it has to be carried forward.
YOY = f"yoy AS (SELECT date, {_interp_sql('date', K.CPI_ANCHORS)} AS yoy FROM cal WHERE day(date) <= 3)"


@query(
    "prj_13_real_yield",
    ctes(RETS, CAL, SCHED, YIELDS, YOY)
    + f"SELECT {d('yl.date')} AS date, {r('yld - last_value(yoy IGNORE NULLS) OVER (ORDER BY yl.date ROWS UNBOUNDED PRECEDING)')} AS real_yield FROM yl LEFT JOIN yoy ON yl.date = yoy.date",
)
def prj_13(spark, sf):
    cal = calendar(returns(spark, sf))
    yoy = cal.filter(F.dayofmonth("date") <= 3).withColumn("yoy", M.interpolate(F.col("date"), K.CPI_ANCHORS))
    return M.real_yield(M.yield_on(cal, K.schedule(spark)), yoy).select("date", rnd("real_yield").alias("real_yield"))


@query(
    "prj_14_price_level",
    ctes(RETS, CAL, f"yy AS (SELECT date, {_interp_sql('date', K.CPI_ANCHORS)} AS yoy FROM cal)")
    + f"SELECT {d()} AS date, {r('product(pow(1 + yoy, 1.0/252)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) * 100.0', 4)} AS level FROM yy",
)
def prj_14(spark, sf):
    yoy = calendar(returns(spark, sf)).withColumn("yoy", M.interpolate(F.col("date"), K.CPI_ANCHORS))
    return M.price_level(yoy).select("date", rnd("level", 4).alias("level"))


@query(
    "prj_15_provenance",
    ctes(SRETS, """n AS (SELECT asset, count(ret) AS effective_rows FROM srets GROUP BY asset),
t AS (SELECT count(DISTINCT date) AS days FROM srets WHERE ret IS NOT NULL)""")
    + f"""SELECT asset, effective_rows, {r('1 - effective_rows / CAST(days AS DOUBLE)')} AS imputed_fraction,
 CASE WHEN 1 - effective_rows / CAST(days AS DOUBLE) > 0.5 THEN 'mostly_imputed' WHEN asset = '4-NOT SPECIFIED' THEN 'synthetic_feed' ELSE 'raw' END AS source_type,
 CASE WHEN asset = '4-NOT SPECIFIED' THEN 'yield_reconstruction' ELSE '' END AS transformations FROM n, t""",
)
def prj_15(spark, sf):
    from tidepanel.operators.quality import provenance

    return provenance(staggered_returns(spark, sf), {"4-NOT SPECIFIED": "yield_reconstruction"})


# --- alignment joins --------------------------------------------------------

UNION_CAL = ", ".join(
    [
        "cells AS (SELECT DISTINCT date FROM srets WHERE ret IS NOT NULL)",
        "names AS (SELECT DISTINCT asset FROM srets)",
        "un AS (SELECT a.asset, c.date, s.ret FROM cells c CROSS JOIN names a LEFT JOIN srets s ON s.asset = a.asset AND s.date = c.date)",
    ]
)


def union_panel(spark, sf):
    x = staggered_returns(spark, sf).filter("ret IS NOT NULL")
    return A.union_calendar(x, ASSETS)


@query("jn_01_union_calendar", ctes(SRETS, UNION_CAL) + f"SELECT asset, {d()} AS date, {r('ret')} AS ret FROM un")
def jn_01(spark, sf):
    return union_panel(spark, sf).select("asset", "date", rnd("ret").alias("ret"))


STRICT = "st AS (SELECT * FROM srets WHERE ret IS NOT NULL AND date IN (SELECT date FROM srets GROUP BY date HAVING count(ret) = 5))"


@query("jn_02_strict_overlap", ctes(SRETS, STRICT) + f"SELECT asset, {d()} AS date, {r('ret')} AS ret FROM st")
def jn_02(spark, sf):
    x = staggered_returns(spark, sf).filter("ret IS NOT NULL")
    return A.strict_overlap(x, len(ASSETS)).select("asset", "date", rnd("ret").alias("ret"))


@query(
    "jn_03_bounded_forward_fill",
    ctes(SRETS, UNION_CAL) + f"SELECT asset, {d()} AS date, {r(f'last_value(ret IGNORE NULLS) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS ret FROM un",
)
def jn_03(spark, sf):
    return A.forward_fill(union_panel(spark, sf), 3).select("asset", "date", rnd("ret").alias("ret"))


@query("jn_04_common_start", ctes(SRETS, STRICT) + f"SELECT asset, {d()} AS date, {r('ret')} AS ret FROM srets WHERE ret IS NOT NULL AND date >= (SELECT min(date) FROM st)")
def jn_04(spark, sf):
    x = staggered_returns(spark, sf).filter("ret IS NOT NULL")
    return A.common_start(x, len(ASSETS)).select("asset", "date", rnd("ret").alias("ret"))


@query(
    "jn_05_pairwise_overlap",
    ctes(SRETS) + "SELECT a.asset AS asset_a, b.asset AS asset_b, count(*) AS n FROM srets a JOIN srets b ON a.date = b.date WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2",
)
def jn_05(spark, sf):
    from tidepanel.operators.moments import pair_moments

    return pair_moments(staggered_returns(spark, sf), ASSETS).select("asset_a", "asset_b", "n").filter("n > 0")


@query(
    "jn_06_benchmark_inner",
    ctes(RETS, BENCH, "j AS (SELECT asset, ret, bench FROM rets JOIN bm ON rets.date = bm.date WHERE ret IS NOT NULL AND bench IS NOT NULL)")
    + f"SELECT asset, count(*) AS n, {r('CASE WHEN count(*) > 30 THEN corr(ret, bench) END')} AS corr FROM j GROUP BY asset",
)
def jn_06(spark, sf):
    j = returns(spark, sf).join(benchmark_returns(spark, sf), "date").dropna(subset=["ret", "bench"])
    return j.groupBy("asset").agg(F.count("*").alias("n"), rnd(F.when(F.count("*") > 30, correlation("ret", "bench"))).alias("corr"))


@query(
    "jn_07_calendar_reindex",
    ctes(RETS, CAL, "one AS (SELECT date, ret, price FROM rets WHERE asset = '3-MEDIUM')")
    + f"SELECT {d('cal.date')} AS date, {r('coalesce(ret, 0.0)')} AS ret, {r('last_value(price IGNORE NULLS) OVER (ORDER BY cal.date ROWS UNBOUNDED PRECEDING)', 1)} AS price FROM cal LEFT JOIN one ON one.date = cal.date",
)
def jn_07(spark, sf):
    x = returns(spark, sf)
    one, cal = x.filter("asset = '3-MEDIUM'"), calendar(x)
    a, b = A.reindex(one, cal, 0.0, "ret"), A.reindex(one, cal, None, "price")
    return a.join(b, "date").select("date", rnd("ret").alias("ret"), rnd("price", 1).alias("price"))


@query("jn_08_yield_schedule", ctes(RETS, CAL, SCHED, YIELDS) + f"SELECT {d()} AS date, yld AS yield FROM yl")
def jn_08(spark, sf):
    return M.yield_on(calendar(returns(spark, sf)), K.schedule(spark)).select("date", "yield")


@query("jn_09_linear_interpolation", ctes(RETS, CAL) + f"SELECT {d()} AS date, {r(_interp_sql('date', K.CPI_ANCHORS))} AS yoy FROM cal")
def jn_09(spark, sf):
    cal = calendar(returns(spark, sf))
    return cal.select("date", rnd(M.interpolate(F.col("date"), K.CPI_ANCHORS)).alias("yoy"))


@query("jn_10_log_interpolation", ctes(RETS, CAL) + f"SELECT {d()} AS date, {r(_fx_case())} AS level FROM cal")
def jn_10(spark, sf):
    anchors = spark.createDataFrame(K.FX_ANCHORS, "date DATE, level DOUBLE")
    return M.interpolate_table(calendar(returns(spark, sf)), anchors, log=True).select("date", rnd("level").alias("level"))


def _wide_sql(src):
    return ", ".join(f"max(ret) FILTER (asset = '{a}') AS a{i}" for i, a in enumerate(ASSETS))


@query(
    "jn_22_covariance_panel",
    ctes(SRETS, f"w AS (SELECT date, {_wide_sql('srets')}, count(ret) AS k FROM srets GROUP BY date HAVING count(ret) > 0)")
    + f"SELECT {d()} AS date, " + ", ".join(r(f"coalesce(a{i}, 0.0)") + f" AS a{i}" for i in range(5))
    + " FROM w WHERE k = 5 OR (SELECT count(*) FROM w WHERE k = 5) < 20",
)
def jn_22(spark, sf):
    x = A.covariance_panel(staggered_returns(spark, sf), ASSETS)
    return x.select("date", *[rnd(f"a{i}").alias(f"a{i}") for i in range(5)])


# --- sets and the pattern census --------------------------------------------


@query(
    "em_05_pattern_census",
    ctes(SRETS, "p AS (SELECT date, string_agg(asset, '|' ORDER BY asset) AS pattern FROM srets WHERE ret IS NOT NULL GROUP BY date)")
    + "SELECT pattern, count(*) AS n_rows FROM p GROUP BY pattern",
)
def em_05(spark, sf):
    return A.pattern_census(staggered_returns(spark, sf).filter("ret IS NOT NULL"), ASSETS)


@query(
    "set_01_concat_keep_last",
    ctes(RETS, """seg AS (SELECT asset, date, ret, 1 AS segment FROM rets WHERE date <= DATE '1999-06-30' UNION ALL SELECT asset, date, ret * 2, 2 FROM rets WHERE date >= DATE '1999-06-01'),
k AS (SELECT *, row_number() OVER (PARTITION BY asset, date ORDER BY segment DESC) AS rn FROM seg)""")
    + f"SELECT asset, {d()} AS date, segment, {r('ret')} AS ret FROM k WHERE rn = 1",
)
def set_01(spark, sf):
    x = returns(spark, sf).select("asset", "date", "ret")
    one = x.filter("date <= DATE '1999-06-30'").withColumn("segment", F.lit(1))
    two = x.filter("date >= DATE '1999-06-01'").withColumn("ret", F.col("ret") * 2).withColumn("segment", F.lit(2))
    out = A.concat_segments(one.unionByName(two), keys=("asset",))
    return out.select("asset", "date", "segment", rnd("ret").alias("ret"))


@query(
    "set_02_available_universe",
    f"WITH {values('want', 'asset', [('5-LOW',), ('1-URGENT',), ('9-GHOST',)])} SELECT asset FROM want INTERSECT SELECT o_orderpriority FROM orders",
)
def set_02(spark, sf):
    want = spark.createDataFrame([("5-LOW",), ("1-URGENT",), ("9-GHOST",)], "asset STRING")
    return A.available(P.daily_prices(spark, sf), want)


@query(
    "set_03_restore_dropped",
    ctes(SRETS, "n AS (SELECT asset, count(ret) AS n FROM srets GROUP BY asset), m AS (SELECT median(n) AS mid FROM n)")
    + f"SELECT srets.asset, {d()} AS date, {r('CASE WHEN n >= 900 THEN ret END')} AS ret FROM srets JOIN n ON n.asset = srets.asset UNION ALL SELECT '6-ABSENT', {d()}, NULL FROM (SELECT DISTINCT date FROM srets)",
)
def set_03(spark, sf):
    return A.restore_columns(staggered_returns(spark, sf), [*ASSETS, "6-ABSENT"], 900).select("asset", "date", rnd("ret").alias("ret"))


@query(
    "set_04_approximate_equality",
    ctes(RETS, SRETS[len(PRICES) :].lstrip(", ").replace("srets AS", "srets AS", 1), "g AS (SELECT abs(coalesce(a.ret, 0) - coalesce(b.ret, 0)) AS gap FROM rets a FULL OUTER JOIN srets b ON a.asset = b.asset AND a.date = b.date)")
    + f"SELECT count(*) AS n_keys, {r('max(gap)')} AS max_gap, max(gap) <= 0.002 AS equal FROM g",
)
def set_04(spark, sf):
    out = A.approximately_equal(returns(spark, sf), staggered_returns(spark, sf), ["asset", "date"], "ret", 0.002)
    return out.withColumn("max_gap", rnd("max_gap"))
