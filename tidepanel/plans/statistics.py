"""Registered aggregation queries: quality, moments, risk, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.expr import rnd
from tidepanel.operators import align as A
from tidepanel.operators import drift as D
from tidepanel.operators import features as X
from tidepanel.operators import moments as MO
from tidepanel.operators import portfolio as PF
from tidepanel.operators import quality as Q
from tidepanel.operators import risk as R
from tidepanel.plans import parameters as K
from tidepanel.plans.alignment import BENCH, SCHED, VENDOR, YIELDS, CAL, _interp_sql, benchmark_returns, calendar, fx_levels, FX, returns, staggered_returns
from tidepanel.plans.registry import BOOKS, RETS, SRETS, W, ctes, d, query, r
from tidepanel.plans.windows import FEATURES_CTE, TRI_SQL
from tidepanel.sources import files as S
from tidepanel.sources import panels as P
from tidepanel.sources.panels import ASSETS


def rounded(df, *names, digits=6, keep=()):
    return df.select(*keep, *[rnd(n, digits).alias(n) for n in names])


@query(
    "ag_01_series_summary",
    ctes(SRETS)
    + f"""SELECT asset, count(*) AS n_rows, {d('min(date)')} AS start_date, {d('max(date)')} AS end_date, {r('avg(CASE WHEN ret = 0 THEN 1.0 ELSE 0.0 END)')} AS zero_pct,
 {r('avg(ret) * 252')} AS annualized_mean, {r('stddev_samp(ret) * sqrt(252.0)')} AS annualized_vol, {r('skewness(ret)', 5)} AS skew, {r('kurtosis(ret)', 5)} AS kurtosis
 FROM srets WHERE ret IS NOT NULL GROUP BY asset""",
)
def ag_01(spark, sf):
    s = Q.summarise(staggered_returns(spark, sf))
    s = s.withColumns({"skew": rnd("skew", 5), "kurtosis": rnd("kurtosis", 5)})
    return s.withColumns({n: rnd(n) for n in ("zero_pct", "annualized_mean", "annualized_vol")})


DUPES = """
dup AS (SELECT asset, date, ret FROM srets UNION ALL SELECT asset, date, 0.0 FROM srets WHERE day(date) = 5)
"""


def with_duplicates(spark, sf):
    x = staggered_returns(spark, sf).select("asset", "date", "ret")
    return x.unionByName(x.filter(F.dayofmonth("date") == 5).withColumn("ret", F.lit(0.0)))


FLAGS = f"""
dd AS (SELECT asset, date, count(*) AS n, sum(CASE WHEN coalesce(ret, 0.0) = 0.0 THEN 1 ELSE 0 END) AS z FROM dup GROUP BY 1, 2),
dg AS (SELECT *, date - lag(date) OVER ({W}) AS gap FROM dd),
flags AS (SELECT asset, CAST(sum(n - 1) AS BIGINT) AS duplicate_timestamps, CAST(coalesce(max(gap), 0) AS INTEGER) AS max_gap_days,
  CAST(coalesce(median(gap), 0) AS DOUBLE) AS median_gap_days, sum(z) / CAST(sum(n) AS DOUBLE) AS zero_return_pct, coalesce(max(gap) > 30, false) AS stale_series_flag FROM dg GROUP BY asset)
"""


@query("ag_02_quality_flags", ctes(SRETS, DUPES, FLAGS) + f"SELECT asset, duplicate_timestamps, max_gap_days, median_gap_days, {r('zero_return_pct')} AS zero_return_pct, stale_series_flag FROM flags")
def ag_02(spark, sf):
    return Q.quality_flags(with_duplicates(spark, sf)).withColumn("zero_return_pct", rnd("zero_return_pct"))


@query(
    "ag_03_quality_warnings",
    ctes(SRETS, DUPES, FLAGS, "full_days AS (SELECT date FROM srets GROUP BY date HAVING count(ret) = 6)")
    + """SELECT 'high' AS severity, 'STALE_SERIES' AS code, asset, asset || ' has stale periods; max gap ' || max_gap_days || ' days' AS message FROM flags WHERE max_gap_days > 10
 UNION ALL SELECT 'medium', 'HIGH_ZERO_RETURNS', asset, asset || ' has many zero returns' FROM flags WHERE zero_return_pct > 0.033
 UNION ALL SELECT 'high', 'EMPTY_ALIGNED_PANEL', NULL, 'No date has every asset' WHERE (SELECT count(*) FROM full_days) = 0
 UNION ALL SELECT 'critical', 'MISSING_ASSET_FILE', '6-ABSENT', 'No data found for 6-ABSENT'""",
)
def ag_03(spark, sf):
    x = with_duplicates(spark, sf)
    catalog = spark.createDataFrame([(a,) for a in (*ASSETS, "6-ABSENT")], "asset STRING")
    flags = Q.quality_flags(x, stale_days=10)
    full = Q.trading_days(staggered_returns(spark, sf), len(ASSETS) + 1)
    return Q.quality_warnings(flags, full, S.missing_assets(catalog, x), zero_limit=0.033)


PAIRS = "FROM srets a JOIN srets b ON a.date = b.date AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2"


@query("ag_04_pairwise_covariance", ctes(SRETS) + f"SELECT a.asset AS asset_a, b.asset AS asset_b, {r('CASE WHEN count(*) >= 2 THEN covar_samp(a.ret, b.ret) ELSE 0.0 END * 1e4')} AS cov_bp {PAIRS}")
def ag_04(spark, sf):
    m = MO.pairwise_covariance(staggered_returns(spark, sf), ASSETS).filter("n > 0")
    return m.select("asset_a", "asset_b", rnd(F.col("cov") * 1e4).alias("cov_bp"))




@query(
    "ag_04b_wide_universe_covariance",
    ctes(
        f"""i0 AS (SELECT p_brand AS asset, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS p0 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
ip AS (SELECT asset, date, avg(p0) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS price FROM i0),
srets AS (SELECT asset, date, price / lag(price) OVER ({W}) - 1 AS ret FROM ip)"""
    )
    + f"SELECT a.asset AS asset_a, b.asset AS asset_b, count(*) AS n, {r('covar_samp(a.ret, b.ret) * 1e4')} AS cov_bp, {r('corr(a.ret, b.ret)')} AS corr {PAIRS}",
)
def ag_04b(spark, sf):
    x = X.simple_return(P.instrument_prices(spark, sf))
    names = A.universe(P.table(spark, sf, "part").select(F.col("p_brand").alias("asset")))
    m = MO.gram_moments(x, names)
    return m.select("asset_a", "asset_b", "n", rnd(F.col("cov") * 1e4).alias("cov_bp"), rnd("corr").alias("corr"))


@query(
    "ag_04c_supplier_universe_covariance",
    "WITH x AS (SELECT l_suppkey AS asset, CAST(l_shipdate AS DATE) AS date, ln(sum(l_extendedprice)) AS v FROM lineitem GROUP BY 1, 2) "
    f"SELECT a.asset AS asset_a, b.asset AS asset_b, count(*) AS n, {r('covar_samp(a.v, b.v) * 1e4')} AS cov_bp "
    "FROM x a JOIN x b ON a.date = b.date AND a.asset <= b.asset WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3",
)
def ag_04c(spark, sf):
    """Daily log sales of every two suppliers that ship on at least three common days."""
    x = P.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("asset"), F.col("l_shipdate").cast("date").alias("date"))
    m = MO.universe_moments(x.agg(F.log(F.sum("l_extendedprice")).alias("ret")), min_n=3)
    return m.select("asset_a", "asset_b", "n", rnd(F.col("cov") * 1e4).alias("cov_bp"))


@query(
    "ag_05_correlation_lower_triangle",
    ctes(SRETS) + f"SELECT a.asset AS asset_a, b.asset AS asset_b, {r('corr(a.ret, b.ret)')} AS corr FROM srets a JOIN srets b ON a.date = b.date AND a.asset > b.asset WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2",
)
def ag_05(spark, sf):
    m = MO.pair_moments(staggered_returns(spark, sf), ASSETS)
    return m.filter("i > j AND n > 0").select("asset_a", "asset_b", rnd("corr").alias("corr"))


def _wide(src):
    return ", ".join(f"max(ret) FILTER (asset = '{a}') AS a{i}" for i, a in enumerate(ASSETS))


COMPLETE = f"""
cw AS (SELECT date, {_wide('srets')}, count(ret) AS k FROM srets GROUP BY date HAVING count(ret) > 0),
cp AS (SELECT date, {', '.join(f'coalesce(a{i}, 0.0) AS a{i}' for i in range(5))} FROM cw WHERE k = 5 OR (SELECT count(*) FROM cw WHERE k = 5) < 20),
lo AS (SELECT unnest(['{"','".join(ASSETS)}']) AS asset, date, unnest([a0, a1, a2, a3, a4]) AS x FROM cp),
sc AS (SELECT a.asset AS asset_a, b.asset AS asset_b, count(*) AS n, covar_samp(a.x, b.x) AS c FROM lo a JOIN lo b ON a.date = b.date GROUP BY 1, 2),
sh AS (SELECT asset_a, asset_b, n, CASE WHEN asset_a = asset_b THEN greatest(c, 1e-12) ELSE c * (1 - 5.0 / (5.0 + n)) END AS v FROM sc)
"""


def shrunk(spark, sf):
    rows = A.covariance_panel(staggered_returns(spark, sf), ASSETS)
    return MO.shrunk_covariance(rows, ASSETS)


@query("ag_06_shrunk_covariance", ctes(SRETS, COMPLETE) + f"SELECT asset_a, asset_b, n, {r('v * 1e4')} AS v_bp FROM sh")
def ag_06(spark, sf):
    return shrunk(spark, sf).select("asset_a", "asset_b", "n", rnd(F.col("v") * 1e4).alias("v_bp"))


@query("ag_07_annual_covariance", ctes(SRETS, COMPLETE) + f"SELECT asset_a, asset_b, {r('v * 252 + CASE WHEN asset_a = asset_b THEN 1e-10 ELSE 0 END', 8)} AS v FROM sh")
def ag_07(spark, sf):
    return MO.annualise(shrunk(spark, sf)).select("asset_a", "asset_b", rnd("v", 8).alias("v"))


@query(
    "ag_08_variance_repair",
    ctes(SRETS, COMPLETE, """ob AS (SELECT asset, quantile_cont(ret, 0.005) AS lo, quantile_cont(ret, 0.995) AS hi, count(*) AS n FROM srets WHERE ret IS NOT NULL GROUP BY asset),
os AS (SELECT asset, stddev_samp(least(greatest(ret, lo), hi)) AS s, any_value(n) AS n, 1 - any_value(n) / CAST((SELECT count(*) FROM cw) AS DOUBLE) AS f FROM srets JOIN ob USING (asset) WHERE ret IS NOT NULL GROUP BY asset),
kk AS (SELECT asset_a AS asset, CASE WHEN f >= 0.35 AND os.n > 30 THEN os.s / sqrt(v) ELSE 1.0 END AS k FROM sh JOIN os ON asset = asset_a WHERE asset_a = asset_b)""")
    + f"SELECT asset_a, asset_b, {r('v * ka.k * kb.k * 1e4')} AS v_bp FROM sh JOIN kk ka ON ka.asset = asset_a JOIN kk kb ON kb.asset = asset_b",
)
def ag_08(spark, sf):
    x = staggered_returns(spark, sf)
    days = x.filter("ret IS NOT NULL").agg(F.countDistinct("date").alias("n")).scalar()
    fixed = MO.repair_variance(shrunk(spark, sf), MO.observed_sigma(x, days))
    return fixed.select("asset_a", "asset_b", rnd(F.col("v") * 1e4).alias("v_bp"))


BRETS = "br AS (SELECT book, date, sum(w * ret) AS ret FROM books JOIN rets USING (asset) WHERE ret IS NOT NULL GROUP BY 1, 2)"


def book_returns(spark, sf, by="c_mktsegment"):
    return PF.book_returns(P.books(spark, sf, by), returns(spark, sf), ASSETS)


PERF = f"""
pc AS (SELECT book, date, ret, product(1 + ret) OVER (PARTITION BY book ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM br),
pd AS (SELECT *, g / max(g) OVER (PARTITION BY book ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM pc)
"""
PERF_COLS = f"""count(*) AS n, {r('product(1 + ret) - 1', 4)} AS total_return, {r('pow(product(1 + ret), 252.0 / count(*)) - 1', 4)} AS cagr,
 {r('stddev_samp(ret) * sqrt(252.0)', 4)} AS volatility, {r(f'(avg(ret) * 252 - {K.RISK_FREE}) / (stddev_samp(ret) * sqrt(252.0) + 1e-12)', 4)} AS sharpe, {r('min(dd)', 4)} AS max_drawdown"""


@query("ag_09_performance_metrics", ctes(RETS, BOOKS, BRETS, PERF) + f"SELECT book, {PERF_COLS} FROM pd GROUP BY book")
def ag_09(spark, sf):
    return R.performance(book_returns(spark, sf), ["book"], K.RISK_FREE)


CUST_BOOKS = BOOKS.replace("c_mktsegment AS book", "CAST(o_custkey AS VARCHAR) AS book").replace(" JOIN customer ON o_custkey = c_custkey", "")
# Every book has a row on every panel date; what it does not hold counts as 0.
ALL_DATES = """br0 AS (SELECT book, date, sum(w * ret) AS ret FROM books JOIN rets USING (asset) WHERE ret IS NOT NULL GROUP BY 1, 2),
bd AS (SELECT b.book, c.date FROM (SELECT DISTINCT book FROM books) b CROSS JOIN (SELECT DISTINCT date FROM rets WHERE ret IS NOT NULL) c),
br AS (SELECT bd.book, bd.date, coalesce(ret, 0.0) AS ret FROM bd LEFT JOIN br0 ON br0.book = bd.book AND br0.date = bd.date)"""


@query("ag_09b_many_books_performance", ctes(RETS, CUST_BOOKS, ALL_DATES, PERF) + f"SELECT book, {PERF_COLS} FROM pd GROUP BY book")
def ag_09b(spark, sf):
    return PF.book_performance(P.books(spark, sf, "o_custkey"), returns(spark, sf), ASSETS, K.RISK_FREE)


_Z = ("-1.6448536269514729", "-2.3263478740408408")


def _cvar(z, a):
    return f"-avg(ret) + stddev_samp(ret) * exp(-({z})*({z})/2) / sqrt(2*pi()) / {a}"


TAIL = """
hq AS (SELECT book, quantile_cont(ret, 0.05) AS q FROM br GROUP BY book),
ht AS (SELECT book, -any_value(q) AS hist_var, -avg(ret) AS hist_cvar FROM br JOIN hq USING (book) WHERE ret <= q GROUP BY book)
"""


@query(
    "ag_10_risk_pack",
    ctes(RETS, BOOKS, BRETS, PERF, TAIL, f"""rp AS (SELECT book, avg(ret) * 252 AS ar, stddev_samp(ret) * sqrt(252.0) AS av, sqrt(avg(pow(least(ret - {K.RISK_FREE}/252, 0), 2))) * sqrt(252.0) AS dn, min(dd) AS mdd,
 skewness(ret) AS sk, kurtosis(ret) AS ku, -(avg(ret) + stddev_samp(ret) * {_Z[0]}) AS v95, -(avg(ret) + stddev_samp(ret) * {_Z[1]}) AS v99, {_cvar(_Z[0], 0.05)} AS c95, {_cvar(_Z[1], 0.01)} AS c99 FROM pd GROUP BY book)""")
    + f"""SELECT book, {r('ar')} AS annualized_return, {r('av')} AS annualized_volatility, {r(f'(ar - {K.RISK_FREE}) / (av + 1e-12)', 5)} AS sharpe, {r(f'(ar - {K.RISK_FREE}) / (dn + 1e-12)', 5)} AS sortino,
 {r('CASE WHEN mdd < 0 THEN ar / (abs(mdd) + 1e-12) END', 5)} AS calmar, {r('mdd')} AS max_drawdown, {r('sk', 5)} AS skew, {r('ku', 5)} AS kurtosis, {r('v95')} AS var_95, {r('v99')} AS var_99, {r('c95')} AS cvar_95, {r('c99')} AS cvar_99,
 {r('hist_var')} AS historical_var_95, {r('hist_cvar')} AS historical_cvar_95 FROM rp JOIN ht USING (book)""",
)
def ag_10(spark, sf):
    p = R.risk_pack(book_returns(spark, sf), ["book"], K.RISK_FREE)
    five = ("sharpe", "sortino", "calmar", "skew", "kurtosis")
    return p.select("book", *[rnd(n, 5 if n in five else 6).alias(n) for n in p.columns if n != "book"])


BJ = "bj AS (SELECT book, br.date, br.ret, bench FROM br JOIN bm ON bm.date = br.date WHERE bench IS NOT NULL)"


@query(
    "ag_11_active_risk",
    ctes(RETS, BOOKS, BRETS, BENCH, BJ)
    + f"""SELECT book, count(*) AS n_joint, {r('CASE WHEN count(*) > 30 THEN covar_samp(ret, bench) / (var_samp(bench) + 1e-12) END')} AS beta,
 {r('CASE WHEN count(*) > 30 THEN stddev_samp(ret - bench) * sqrt(252.0) END')} AS tracking_error,
 {r('CASE WHEN count(*) > 30 THEN avg(ret - bench) * 252 / (stddev_samp(ret - bench) * sqrt(252.0) + 1e-12) END', 5)} AS information_ratio FROM bj GROUP BY book""",
)
def ag_11(spark, sf):
    a = R.active_risk(book_returns(spark, sf).join(benchmark_returns(spark, sf), "date"), ["book"])
    return a.select("book", "n_joint", rnd("beta").alias("beta"), rnd("tracking_error").alias("tracking_error"), rnd("information_ratio", 5).alias("information_ratio"))


@query(
    "ag_12_parametric_var",
    ctes(RETS) + f"SELECT asset, {r(f'-(avg(ret) + stddev_samp(ret) * {_Z[0]})')} AS var_95, {r(f'-(avg(ret) + stddev_samp(ret) * {_Z[1]})')} AS var_99, {r(_cvar(_Z[0], 0.05))} AS cvar_95, {r(_cvar(_Z[1], 0.01))} AS cvar_99 FROM rets GROUP BY asset",
)
def ag_12(spark, sf):
    m, s = F.avg("ret"), F.stddev_samp("ret")
    return returns(spark, sf).groupBy("asset").agg(
        rnd(R.parametric_var(m, s, R.Z05)).alias("var_95"), rnd(R.parametric_var(m, s, R.Z01)).alias("var_99"),
        rnd(R.parametric_cvar(m, s, R.Z05, 0.05)).alias("cvar_95"), rnd(R.parametric_cvar(m, s, R.Z01, 0.01)).alias("cvar_99"),
    )


@query(
    "ag_13_historical_var",
    ctes(RETS, "hq AS (SELECT asset, quantile_cont(ret, 0.05) AS q FROM rets GROUP BY asset)")
    + f"SELECT asset, {r('-any_value(q)')} AS hist_var, {r('-avg(ret)')} AS hist_cvar FROM rets JOIN hq USING (asset) WHERE ret <= q GROUP BY asset",
)
def ag_13(spark, sf):
    return rounded(R.historical_tail(returns(spark, sf), ["asset"]), "hist_var", "hist_cvar", keep=("asset",))


@query("ag_14_downside_deviation", ctes(RETS) + f"SELECT asset, {r(f'sqrt(avg(pow(least(ret - {K.RISK_FREE}/252, 0), 2))) * sqrt(252.0)')} AS downside FROM rets WHERE ret IS NOT NULL GROUP BY asset")
def ag_14(spark, sf):
    x = returns(spark, sf).filter("ret IS NOT NULL")
    return x.groupBy("asset").agg(rnd(R.downside_deviation(F.col("ret"), K.RISK_FREE / 252)).alias("downside"))


@query(
    "ag_17_month_end",
    ctes(RETS, BOOKS, BRETS, PERF, "me AS (SELECT book, last_day(date) AS m, arg_max(g - 1, date) AS cum FROM pd GROUP BY 1, 2)")
    + f"SELECT book, {d('m')} AS month_end, {r('cum')} AS cum FROM me WHERE m IN (SELECT m FROM me GROUP BY m HAVING count(*) = 5)",
)
def ag_17(spark, sf):
    c = R.with_curves(book_returns(spark, sf), ["book"]).withColumn("cum", F.col("growth") - 1)
    return rounded(R.month_end(c, ["book"], "cum", 5), "cum", keep=("book", "month_end"))


FP = f"""
rd AS (SELECT date FROM rets GROUP BY date ORDER BY date DESC LIMIT 504),
fr AS (SELECT a.asset, a.ret, b.ret AS ref FROM rets a LEFT JOIN rets b ON a.date = b.date AND b.asset = '{K.FOCUS}' WHERE a.ret IS NOT NULL AND a.date IN (SELECT date FROM rd)),
fp AS (SELECT asset, {r('avg(ret) * 252')} AS mean_ann, {r('stddev_samp(ret) * sqrt(252.0)')} AS vol_ann, {r(f"CASE WHEN asset <> '{K.FOCUS}' AND count(ref) >= 40 THEN corr(ret, ref) END")} AS corr_ref FROM fr GROUP BY asset)
"""


@query("ag_19_drift_fingerprint", ctes(RETS, FP) + "SELECT * FROM fp")
def ag_19(spark, sf):
    return rounded(D.fingerprint(returns(spark, sf), K.FOCUS, 504), "mean_ann", "vol_ann", "corr_ref", keep=("asset",))


BASE_FP = FP.replace("rd AS (SELECT date FROM rets GROUP BY date ORDER BY date DESC LIMIT 504)", "bd AS (SELECT date FROM rets WHERE date < DATE '1998-01-01' GROUP BY date)").replace("FROM rd", "FROM bd").replace("fr AS", "bfr AS").replace("FROM fr", "FROM bfr").replace("fp AS", "bfp AS")
VIOL = """
vj AS (SELECT c.*, b.mean_ann AS bm, b.vol_ann AS bv, b.corr_ref AS bc FROM fp c JOIN bfp b USING (asset)),
vl AS (SELECT 'mean_shift' AS type, asset, CASE WHEN bm <> 0 THEN abs(mean_ann - bm) / greatest(abs(bm), 1e-6) END AS delta, CAST(0.50 AS DOUBLE) AS threshold FROM vj
  UNION ALL SELECT 'vol_shift', asset, CASE WHEN bv <> 0 THEN abs(vol_ann - bv) / greatest(abs(bv), 1e-6) END, CAST(0.45 AS DOUBLE) FROM vj
  UNION ALL SELECT 'correlation_shift', asset, abs(corr_ref - bc), CAST(0.22 AS DOUBLE) FROM vj)
"""


def baseline_fingerprint(spark, sf):
    return D.fingerprint(returns(spark, sf).filter("date < DATE '1998-01-01'"), K.FOCUS)


@query("ag_20_drift_violations", ctes(RETS, FP, BASE_FP, VIOL) + f"SELECT type, asset, {r('delta', 4)} AS delta, threshold FROM vl WHERE delta > threshold")
def ag_20(spark, sf):
    return D.violations(D.fingerprint(returns(spark, sf), K.FOCUS, 504), baseline_fingerprint(spark, sf))


@query(
    "ag_20b_drift_status",
    ctes(RETS, FP, BASE_FP, VIOL)
    + """SELECT CASE WHEN (SELECT count(*) FROM bfp) = 0 THEN 'no_baseline' WHEN count(*) = 0 THEN 'ok' WHEN max(CASE WHEN type <> 'correlation_shift' THEN 1 ELSE 0 END) = 1 THEN 'alert' ELSE 'warning' END AS status,
 count(*) AS n_violations FROM vl WHERE delta > threshold""",
)
def ag_20b(spark, sf):
    base = baseline_fingerprint(spark, sf)
    return D.status(D.violations(D.fingerprint(returns(spark, sf), K.FOCUS, 504), base), base)


@query(
    "ag_21_imputed_fraction",
    ctes(SRETS, """cd AS (SELECT DISTINCT date FROM srets WHERE ret IS NOT NULL), nm AS (SELECT DISTINCT asset FROM srets),
ff AS (SELECT a.asset, c.date, s.ret, last_value(s.ret IGNORE NULLS) OVER (PARTITION BY a.asset ORDER BY c.date ROWS UNBOUNDED PRECEDING) AS filled FROM cd c CROSS JOIN nm a LEFT JOIN srets s ON s.asset = a.asset AND s.date = c.date)""")
    + f"SELECT asset, {r('avg(CASE WHEN ret IS NULL AND filled IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS imputed_fraction, {r('var_pop(filled) FILTER (ret IS NULL AND filled IS NOT NULL) * 1e4')} AS imputed_var_bp FROM ff GROUP BY asset",
)
def ag_21(spark, sf):
    from tidepanel.operators.impute import imputation_diagnostics
    from tidepanel.plans.alignment import union_panel

    x = union_panel(spark, sf)
    filled = A.forward_fill(x.withColumn("filled", F.col("ret")), None, "filled")
    diag = imputation_diagnostics(filled, observed="ret", completed="filled")
    return diag.select("asset", rnd("imputed_fraction").alias("imputed_fraction"), rnd(F.col("imputed_var") * 1e4).alias("imputed_var_bp"))


@query(
    "ag_22_histogram",
    ctes(RETS, """hb AS (SELECT asset, min(ret) AS lo, max(ret) AS hi, avg(ret) AS m, stddev_samp(ret) AS s FROM rets GROUP BY asset),
hh AS (SELECT asset, ret, lo, hi, m, s, CAST(least(floor((ret - lo) / ((hi - lo) / 80)), 79) AS INTEGER) AS bin FROM rets JOIN hb USING (asset) WHERE ret IS NOT NULL)""")
    + f"SELECT asset, bin, count(*) AS n, {r('any_value(lo + bin * ((hi - lo) / 80))')} AS bin_start, {r('any_value(m - 2 * s)')} AS low_mark, {r('any_value(m + 2 * s)')} AS high_mark FROM hh GROUP BY asset, bin",
)
def ag_22(spark, sf):
    return rounded(Q.histogram(returns(spark, sf)), "bin_start", "low_mark", "high_mark", keep=("asset", "bin", "n"))


@query("ag_23_class_balance", ctes(RETS + TRI_SQL) + f"SELECT asset, tri_label AS label, count(*) AS n, {r('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY asset)', 4)} AS pct FROM tl GROUP BY asset, tri_label")
def ag_23(spark, sf):
    x = X.ternary_label(X.next_day_label(returns(spark, sf)))
    return rounded(Q.class_balance(x, "tri_label"), "pct", digits=4, keep=("asset", "label", "n"))


@query(
    "ag_24_kpi_cards",
    ctes(RETS)
    + f"SELECT asset, {r('(arg_max(price, date) / arg_min(price, date) - 1) * 100', 4)} AS total_return_pct, {r('arg_max(price, date)', 1)} AS current_price, {r(f'(avg(ret) * 252 - {K.RISK_FREE}) / (stddev_samp(ret) * sqrt(252.0) + 1e-12)', 4)} AS sharpe FROM rets GROUP BY asset",
)
def ag_24(spark, sf):
    vol = F.stddev_samp("ret") * R.ROOT
    return returns(spark, sf).groupBy("asset").agg(
        rnd((F.max_by("price", "date") / F.min_by("price", "date") - 1) * 100, 4).alias("total_return_pct"),
        rnd(F.max_by("price", "date"), 1).alias("current_price"),
        rnd((F.avg("ret") * 252 - K.RISK_FREE) / (vol + 1e-12), 4).alias("sharpe"),
    )


@query("ag_25_risk_return_points", ctes(RETS) + f"SELECT asset, {r('avg(ret) * 252')} AS ann_mean, {r('stddev_samp(ret) * sqrt(252.0)')} AS ann_vol FROM rets GROUP BY asset")
def ag_25(spark, sf):
    return returns(spark, sf).groupBy("asset").agg(rnd(F.avg("ret") * 252).alias("ann_mean"), rnd(F.stddev_samp("ret") * R.ROOT).alias("ann_vol"))


_INDICATORS = ("rsi", "macd_hist", "bb_pb", "bb_bandwidth", "dist_to_ma5")


@query("ag_26_indicator_matrix", "WITH RECURSIVE " + FEATURES_CTE + "SELECT asset, " + ", ".join(f"{r(f'avg({n})', 4)} AS {n}" for n in _INDICATORS) + " FROM feats GROUP BY asset")
def ag_26(spark, sf):
    f = X.technical_features(P.daily_prices(spark, sf))
    return f.groupBy("asset").agg(*[rnd(F.avg(n), 4).alias(n) for n in _INDICATORS])


@query(
    "ag_27_unsmooth",
    ctes(RETS, f"""lg AS (SELECT asset, date, ret, lag(ret) OVER ({W}) AS p FROM rets WHERE ret IS NOT NULL),
rho AS (SELECT asset, count(*) AS n, least(greatest(coalesce(corr(ret + 0.6 * p, p), 0.0), 0.0), 0.85) AS rho FROM lg GROUP BY asset)""")
    .replace("corr(ret + 0.6 * p, p)", "corr(ret, p)")
    + f"SELECT asset, {d()} AS date, {r('rho')} AS rho, {r('CASE WHEN n < 30 OR rho < 0.01 THEN ret ELSE (ret - rho * p) / (1 - rho) END')} AS unsmoothed FROM lg JOIN rho USING (asset)",
)
def ag_27(spark, sf):
    # The smoothed panel has little autocorrelation; a low threshold exercises the rule.
    u = X.unsmooth(returns(spark, sf), min_rho=0.01)
    return rounded(u, "rho", "unsmoothed", keep=("asset", "date"))


@query("ag_27b_autocorrelation", ctes(RETS, f"lg AS (SELECT asset, ret, lag(ret) OVER ({W}) AS p FROM rets WHERE ret IS NOT NULL)") + f"SELECT asset, count(ret) AS n, {r('corr(ret, p)')} AS rho FROM lg GROUP BY asset")
def ag_27b(spark, sf):
    return rounded(X.autocorrelation(returns(spark, sf)), "rho", keep=("asset", "n"))


@query(
    "ag_33_reconciliation",
    ctes(VENDOR, f"""cl AS (SELECT asset, date, arg_max(price, ingest_seq) AS price, arg_max(change_pct, ingest_seq) AS change_pct FROM cleaned WHERE date IS NOT NULL GROUP BY 1, 2),
cr AS (SELECT *, price / lag(price) OVER ({W}) - 1 AS ret FROM cl)""")
    + "SELECT round(ret * 100, 2) = round(change_pct, 2) AS matches, count(*) AS n FROM cr WHERE ret IS NOT NULL AND change_pct IS NOT NULL GROUP BY 1",
)
def ag_33(spark, sf):
    clean = S.normalise_frame(S.clean_prices(P.vendor_text(spark, sf), "1900-01-01", "2999-12-31"))
    return Q.reconcile(X.simple_return(clean))


@query(
    "ag_34_null_audit",
    ctes(VENDOR) + "SELECT asset, " + ", ".join(f"CAST(sum(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {n}_nulls" for n in ("price", "open", "vol", "change_pct")) + " FROM cleaned WHERE date IS NOT NULL GROUP BY asset",
)
def ag_34(spark, sf):
    clean = S.clean_prices(P.vendor_text(spark, sf), "1900-01-01", "2999-12-31")
    return Q.null_audit(clean.select("asset", "date", "price", "open", "vol", "change_pct"))


@query(
    "ag_35_latest_macro",
    ctes(RETS, CAL, SCHED, YIELDS, FX)
    + f"SELECT {r('pow(1 + avg(pow(1 + yld, 1.0/252) - 1), 252) - 1')} AS risk_free, {r('arg_max(yld, yl.date)')} AS latest_yield, {r('arg_max(level, fx.date)')} AS latest_fx, {r(f"arg_max({_interp_sql('yl.date', K.CPI_ANCHORS)}, yl.date)")} AS latest_yoy FROM yl JOIN fx ON yl.date = fx.date",
)
def ag_35(spark, sf):
    from tidepanel.operators import macro as M

    x = returns(spark, sf)
    y = M.yield_on(calendar(x), K.schedule(spark)).join(fx_levels(x), "date")
    return y.agg(
        rnd(F.pow(1 + F.avg(M.daily_holding_return(F.col("yield"))), F.lit(252.0)) - 1).alias("risk_free"),
        rnd(F.max_by("yield", "date")).alias("latest_yield"),
        rnd(F.max_by("level", "date")).alias("latest_fx"),
        rnd(F.max_by(M.interpolate(F.col("date"), K.CPI_ANCHORS), "date")).alias("latest_yoy"),
    )
