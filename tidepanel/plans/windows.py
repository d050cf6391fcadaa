"""Registered window / time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.expr import rnd
from tidepanel.operators import features as X
from tidepanel.plans.registry import PRICES, RETS, W, ctes, d, query, r
from tidepanel.sources import panels as P


def returns(spark, sf):
    return X.simple_return(P.daily_prices(spark, sf))


@query("win_01_simple_return", ctes(RETS) + f"SELECT asset, {d()} AS date, {r('ret', 8)} AS ret FROM rets")
def win_01(spark, sf):
    return returns(spark, sf).select("asset", "date", rnd("ret", 8).alias("ret"))


@query(
    "win_02_return_lags",
    ctes(RETS)
    + f"""SELECT asset, {d()} AS date, {r('lag(ret,1) OVER w')} AS ret_lag1, {r('lag(ret,2) OVER w')} AS ret_lag2,
 {r('lag(ret,3) OVER w')} AS ret_lag3 FROM rets WINDOW w AS ({W})""",
)
def win_02(spark, sf):
    return X.lags(returns(spark, sf)).select("asset", "date", *[rnd(f"ret_lag{i}").alias(f"ret_lag{i}") for i in (1, 2, 3)])


def _gated(fn: str, col: str, n: int) -> str:
    f = f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) OVER {f} = {n} THEN {fn}({col}) OVER {f} END"


@query(
    "win_03_moving_average_distance",
    ctes(RETS)
    + f"""SELECT asset, {d()} AS date, {r(f"price / ({_gated('avg', 'price', 5)}) - 1")} AS dist_to_ma5,
 {r(f"price / ({_gated('avg', 'price', 20)}) - 1")} AS dist_to_ma20 FROM rets""",
)
def win_03(spark, sf):
    f = X.moving_average_distance(P.daily_prices(spark, sf))
    return f.select("asset", "date", rnd("dist_to_ma5").alias("dist_to_ma5"), rnd("dist_to_ma20").alias("dist_to_ma20"))


@query(
    "win_04_rolling_volatility",
    ctes(RETS)
    + f"SELECT asset, {d()} AS date, {r(_gated('stddev_samp', 'ret', 20))} AS volatility_20, {r('(' + _gated('stddev_samp', 'ret', 30) + ')*sqrt(252.0)')} AS vol_30_ann FROM rets",
)
def win_04(spark, sf):
    f = X.rolling_volatility(returns(spark, sf), 20)
    f = X.rolling_volatility(f, 30, annualise=True, out="vol_30_ann")
    return f.select("asset", "date", rnd("volatility_20").alias("volatility_20"), rnd("vol_30_ann").alias("vol_30_ann"))


def _ema_sql(src: str, col: str, span: int, name: str) -> str:
    a = f"CAST({2.0 / (span + 1)!r} AS DOUBLE)"
    return f"""
{name}_n AS (SELECT asset, date, {col} AS x, row_number() OVER ({W}) AS rn FROM {src}),
{name} AS (SELECT asset, date, rn, x AS y FROM {name}_n WHERE rn = 1
  UNION ALL SELECT n.asset, n.date, n.rn, {a} * n.x + (1 - {a}) * e.y FROM {name} e JOIN {name}_n n ON n.asset = e.asset AND n.rn = e.rn + 1)"""


@query(
    "win_05_ema",
    "WITH RECURSIVE " + PRICES + "," + _ema_sql("prices", "price", 12, "e12") + f" SELECT asset, {d()} AS date, {r('y', 3)} AS ema_12 FROM e12",
)
def win_05(spark, sf):
    return X.ema(P.daily_prices(spark, sf), "price", 12, "ema_12").select("asset", "date", rnd("ema_12", 3).alias("ema_12"))


MACD_SQL = (
    PRICES + "," + _ema_sql("prices", "price", 12, "e12") + "," + _ema_sql("prices", "price", 26, "e26")
    + ", md AS (SELECT a.asset, a.date, a.y - b.y AS macd FROM e12 a JOIN e26 b ON a.asset = b.asset AND a.rn = b.rn),"
    + _ema_sql("md", "macd", 9, "e9")
)


@query(
    "win_06_macd",
    "WITH RECURSIVE " + MACD_SQL
    + f" SELECT m.asset, {d('m.date')} AS date, {r('macd', 3)} AS macd, {r('y', 3)} AS macd_signal, {r('macd - y', 3)} AS macd_hist FROM md m JOIN e9 ON m.asset = e9.asset AND m.date = e9.date",
)
def win_06(spark, sf):
    f = X.macd(P.daily_prices(spark, sf))
    return f.select("asset", "date", *[rnd(x, 3).alias(x) for x in ("macd", "macd_signal", "macd_hist")])


_MID, _DEV = f"({_gated('avg', 'price', 20)})", f"({_gated('stddev_samp', 'price', 20)})"


@query(
    "win_07_bollinger",
    ctes(PRICES)
    + f"SELECT asset, {d()} AS date, {r(f'(price - ({_MID} - 2*{_DEV})) / nullif(4*{_DEV}, 0)', 5)} AS bb_pb, {r(f'4*{_DEV}/{_MID}')} AS bb_bandwidth FROM prices",
)
def win_07(spark, sf):
    return X.bollinger(P.daily_prices(spark, sf)).select("asset", "date", rnd("bb_pb", 5).alias("bb_pb"), rnd("bb_bandwidth").alias("bb_bandwidth"))


@query(
    "win_08_rsi",
    ctes(
        PRICES,
        f"""x AS (SELECT asset, date, price - lag(price) OVER ({W}) AS dp FROM prices),
y AS (SELECT *, CASE WHEN dp IS NOT NULL THEN greatest(dp, 0.0) END AS g, CASE WHEN dp IS NOT NULL THEN greatest(-dp, 0.0) END AS l FROM x),
z AS (SELECT asset, date, {_gated('avg', 'g', 14)} AS ag, {_gated('avg', 'l', 14)} AS al FROM y)""",
    )
    + f"SELECT asset, {d()} AS date, {r('CASE WHEN al = 0 AND ag = 0 THEN NULL WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END', 4)} AS rsi FROM z",
)
def win_08(spark, sf):
    return X.rsi(P.daily_prices(spark, sf)).select("asset", "date", rnd("rsi", 4).alias("rsi"))


@query("win_09_next_day_label", ctes(RETS) + f"SELECT asset, {d()} AS date, CAST(coalesce(lead(ret) OVER ({W}) > 0.005, false) AS INTEGER) AS label FROM rets")
def win_09(spark, sf):
    return X.next_day_label(returns(spark, sf)).select("asset", "date", "label")


@query("win_09b_yield_label", ctes(RETS) + f"SELECT asset, {d()} AS date, CAST(coalesce(ret > ({_gated('stddev_samp', 'ret', 20)}), false) AS INTEGER) AS label FROM rets")
def win_09b(spark, sf):
    return X.yield_label(returns(spark, sf)).select("asset", "date", "label")


GROWTH = RETS + f", grow AS (SELECT asset, date, ret, product(1 + ret) OVER ({W} ROWS UNBOUNDED PRECEDING) AS growth FROM rets)"


@query("win_10_growth_index", ctes(GROWTH) + f"SELECT asset, {d()} AS date, {r('growth')} AS growth FROM grow")
def win_10(spark, sf):
    return X.growth_index(returns(spark, sf)).select("asset", "date", rnd("growth").alias("growth"))


@query(
    "win_11_rebase",
    ctes(PRICES)
    + f"SELECT asset, {d()} AS date, {r(f'price / first(price) OVER ({W}) * 100.0', 5)} AS rebased FROM prices WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'",
)
def win_11(spark, sf):
    return X.rebase(P.daily_prices(spark, sf), "1997-01-01", "1999-12-31").select("asset", "date", rnd("rebased", 5).alias("rebased"))


@query(
    "win_12_drawdown",
    ctes(GROWTH)
    + f"""SELECT asset, {d()} AS date, {r(f'growth / max(growth) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1')} AS drawdown,
 {r(f'growth / greatest(1.0, max(growth) OVER ({W} ROWS UNBOUNDED PRECEDING)) - 1')} AS drawdown_from_one FROM grow WHERE ret IS NOT NULL""",
)
def win_12(spark, sf):
    g = X.growth_index(returns(spark, sf).filter("ret IS NOT NULL"))
    g = X.drawdown(X.drawdown(g), out="drawdown_from_one", start_at_one=True)
    return g.select("asset", "date", rnd("drawdown").alias("drawdown"), rnd("drawdown_from_one").alias("drawdown_from_one"))


_FWD = f"({W} ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING)"
TARGET_SQL = f"CASE WHEN count(ret) OVER {_FWD} = 63 THEN product(1 + ret) OVER {_FWD} - 1 END"


@query("win_13_forward_return", ctes(RETS) + f"SELECT asset, {d()} AS date, {r(TARGET_SQL)} AS target FROM rets")
def win_13(spark, sf):
    return X.forward_return(returns(spark, sf)).select("asset", "date", rnd("target").alias("target"))


TRI_SQL = f""", nx AS (SELECT asset, date, ret, lead(ret) OVER ({W}) AS nxt FROM rets),
th AS (SELECT asset, quantile_cont(nxt, 0.33) AS lo, quantile_cont(nxt, 0.67) AS hi FROM nx GROUP BY asset),
tri AS (SELECT n.asset, n.date, n.ret, CASE WHEN nxt >= hi THEN 1 WHEN nxt <= lo THEN -1 ELSE 0 END AS tri,
  CAST(coalesce(nxt > 0.005, false) AS INTEGER) AS label FROM nx n JOIN th USING (asset)),
tl AS (SELECT asset, date, ret, CASE WHEN (SELECT count(DISTINCT tri) FROM tri t WHERE t.asset = tri.asset) >= 3 THEN tri ELSE label END AS tri_label FROM tri)
"""


@query("win_14_ternary_label", ctes(RETS + TRI_SQL) + f"SELECT asset, {d()} AS date, tri_label FROM tl")
def win_14(spark, sf):
    return X.ternary_label(X.next_day_label(returns(spark, sf))).select("asset", "date", "tri_label")


def _tail(fn: str, n: int) -> str:
    return f"{fn}(ret) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_CUM = f"count(ret) OVER ({W} ROWS UNBOUNDED PRECEDING)"
MOM_SQL = f""", mo AS (SELECT asset, date, {_CUM} AS n, {_tail('avg', 5)} AS s, {_tail('avg', 21)} AS m,
  CASE WHEN {_CUM} >= 63 THEN {_tail('avg', 63)} ELSE {_tail('avg', 21)} END AS l, {_tail('stddev_samp', 63)} AS sg FROM rets WHERE ret IS NOT NULL),
mom AS (SELECT asset, date, CASE WHEN n >= 30 THEN s ELSE 0.0 END AS short_mean, CASE WHEN n >= 30 THEN m ELSE 0.0 END AS medium_mean,
  CASE WHEN n >= 30 THEN l ELSE 0.0 END AS long_mean, CASE WHEN n >= 30 THEN (s - m) / (sg + 1e-9) ELSE 0.0 END AS strength,
  CASE WHEN n < 30 THEN 0 WHEN s > 0 AND m > 0 AND s > m THEN 1 WHEN s < 0 AND m < 0 AND s < m THEN -1 ELSE 0 END AS signal FROM mo)
"""


@query(
    "win_15_momentum",
    ctes(RETS + MOM_SQL)
    + f"SELECT asset, {d()} AS date, {r('short_mean')} AS short_mean, {r('medium_mean')} AS medium_mean, {r('long_mean')} AS long_mean, {r('strength', 4)} AS strength, signal FROM mom",
)
def win_15(spark, sf):
    m = X.momentum(returns(spark, sf))
    return m.select("asset", "date", rnd("short_mean").alias("short_mean"), rnd("medium_mean").alias("medium_mean"), rnd("long_mean").alias("long_mean"), rnd("strength", 4).alias("strength"), "signal")


REG_SQL = f""", rg0 AS (SELECT asset, date, ret, product(1 + ret) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g FROM rets WHERE ret IS NOT NULL),
rg AS (SELECT asset, date, {_CUM} AS n, {_tail('stddev_samp', 20)} * sqrt(252.0) AS rv,
  CASE WHEN {_CUM} >= 120 THEN {_tail('stddev_samp', 120)} ELSE stddev_samp(ret) OVER ({W} ROWS UNBOUNDED PRECEDING) END * sqrt(252.0) AS lv,
  {_tail('avg', 20)} AS tr, g / max(g) OVER ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1 AS dd FROM rg0),
reg AS (SELECT asset, date, n, CASE WHEN n >= 30 THEN rv ELSE 0.0 END AS realized_vol, CASE WHEN n >= 30 THEN lv ELSE 0.0 END AS long_vol,
  CASE WHEN n >= 30 THEN tr ELSE 0.0 END AS trend, CASE WHEN n >= 30 THEN dd ELSE 0.0 END AS regime_drawdown,
  n >= 30 AND rv > 1.30 * (lv + 1e-9) AND (tr < 0 OR dd < -0.08) AS risk_off FROM rg),
regime AS (SELECT *, CASE WHEN n < 30 THEN 'uncertain' WHEN risk_off THEN 'high_volatility_risk_off'
  WHEN trend > 0 AND realized_vol < long_vol * 1.10 THEN 'bull_trend' WHEN trend < 0 THEN 'bear_trend' ELSE 'sideways' END AS regime FROM reg)
"""


@query(
    "win_16_regime",
    ctes(RETS + REG_SQL)
    + f"SELECT asset, {d()} AS date, {r('realized_vol')} AS realized_vol, {r('long_vol')} AS long_vol, {r('trend')} AS trend, {r('regime_drawdown')} AS regime_drawdown, risk_off, regime FROM regime",
)
def win_16(spark, sf):
    g = X.regime(returns(spark, sf))
    return g.select("asset", "date", *[rnd(x).alias(x) for x in ("realized_vol", "long_vol", "trend", "regime_drawdown")], "risk_off", "regime")


@query(
    "win_17_latest_snapshot",
    ctes(RETS, "x AS (SELECT asset, date, price / avg(price) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - 1 AS dist_to_ma5, "
         + _gated("stddev_samp", "ret", 30) + " AS vol_30 FROM rets), y AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS rn FROM x WHERE vol_30 IS NOT NULL AND dist_to_ma5 IS NOT NULL)")
    + f"SELECT asset, {d()} AS date, {r('dist_to_ma5')} AS dist_to_ma5, {r('vol_30')} AS vol_30 FROM y WHERE rn = 1",
)
def win_17(spark, sf):
    f = X.rolling_volatility(X.moving_average_distance(returns(spark, sf), (5,)), 30, out="vol_30")
    return X.latest_complete(f, ["dist_to_ma5", "vol_30"]).select("asset", "date", rnd("dist_to_ma5").alias("dist_to_ma5"), rnd("vol_30").alias("vol_30"))


@query(
    "win_18_macro_trend",
    ctes(RETS, """t AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS rn FROM rets WHERE ret IS NOT NULL),
s AS (SELECT asset, avg(ret) AS m, stddev_samp(ret) AS sd FROM t WHERE rn <= 63 GROUP BY asset)""")
    + f"""SELECT asset, {r('tanh(m / (sd + 1e-9))')} AS trend_score,
 {r("(SELECT coalesce(avg(m) FILTER (lower(asset) LIKE '%high%'), 0.0) FROM s)")} AS inflation_pressure,
 {r("(SELECT coalesce(avg(m) FILTER (lower(asset) LIKE '%low%'), 0.0) FROM s)")} AS rates_pressure FROM s""",
)
def win_18(spark, sf):
    t = X.macro_trend(returns(spark, sf), inflation_like="high", rates_like="low")
    return t.select("asset", *[rnd(x).alias(x) for x in ("trend_score", "inflation_pressure", "rates_pressure")])


FEATURES_SQL = f""", f0 AS (SELECT rr.asset, rr.date, price, ret, lag(ret,1) OVER w AS ret_lag1, lag(ret,2) OVER w AS ret_lag2,
  price / ({_gated('avg', 'price', 5)}) - 1 AS dist_to_ma5, price / ({_gated('avg', 'price', 20)}) - 1 AS dist_to_ma20,
  {_gated('stddev_samp', 'ret', 20)} AS volatility_20,
  (price - ({_MID} - 2*{_DEV})) / nullif(4*{_DEV}, 0) AS bb_pb, 4*{_DEV}/{_MID} AS bb_bandwidth,
  price - lag(price) OVER w AS dp, CAST(coalesce(lead(ret) OVER w > 0.005, false) AS INTEGER) AS label
  FROM rets rr WINDOW w AS ({W})),
f1 AS (SELECT *, CASE WHEN dp IS NOT NULL THEN greatest(dp, 0.0) END AS g, CASE WHEN dp IS NOT NULL THEN greatest(-dp, 0.0) END AS l FROM f0),
f2 AS (SELECT *, {_gated('avg', 'g', 14)} AS ag, {_gated('avg', 'l', 14)} AS al FROM f1),
f3 AS (SELECT f2.*, CASE WHEN al = 0 AND ag = 0 THEN NULL WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi, macd - e9.y AS macd_hist
  FROM f2 JOIN md ON f2.asset = md.asset AND f2.date = md.date JOIN e9 ON f2.asset = e9.asset AND f2.date = e9.date),
feats AS (SELECT * FROM f3 WHERE ret_lag2 IS NOT NULL AND dist_to_ma20 IS NOT NULL AND volatility_20 IS NOT NULL AND bb_pb IS NOT NULL AND rsi IS NOT NULL)
"""
FEATURES_CTE = MACD_SQL + ", " + RETS[len(PRICES) + 1 :] + FEATURES_SQL


@query(
    "win_all_technical_features",
    "WITH RECURSIVE " + FEATURES_CTE
    + f"""SELECT asset, {d()} AS date, {r('ret')} AS ret, {r('ret_lag1')} AS ret_lag1, {r('ret_lag2')} AS ret_lag2, {r('dist_to_ma5')} AS dist_to_ma5,
 {r('macd_hist', 3)} AS macd_hist, {r('bb_pb', 5)} AS bb_pb, {r('bb_bandwidth')} AS bb_bandwidth, {r('rsi', 4)} AS rsi, label,
 {r('(' + _gated('stddev_samp', 'ret', 30) + ') * sqrt(252.0)')} AS rolling_volatility FROM feats""",
)
def win_all(spark, sf):
    f = X.technical_features(P.daily_prices(spark, sf))
    return f.select(
        "asset", "date", rnd("ret").alias("ret"), rnd("ret_lag1").alias("ret_lag1"), rnd("ret_lag2").alias("ret_lag2"),
        rnd("dist_to_ma5").alias("dist_to_ma5"), rnd("macd_hist", 3).alias("macd_hist"), rnd("bb_pb", 5).alias("bb_pb"),
        rnd("bb_bandwidth").alias("bb_bandwidth"), rnd("rsi", 4).alias("rsi"), "label", rnd("rolling_volatility").alias("rolling_volatility"),
    )
