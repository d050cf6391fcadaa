import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.expr import sample_kurtosis, sample_skew
from tidepanel.operators import align as A
from tidepanel.operators import features as X

RETURNS = [0.1, 0.2, -0.1, 0.05, 0.3, -0.2]


def column(df, name):
    return [r[name] for r in df.orderBy("asset", "date").collect()]


def test_sample_moments(panel):
    row = panel({"A": RETURNS}, name="ret").agg(sample_skew("ret").alias("s"), sample_kurtosis("ret").alias("k")).first()
    assert row["s"] == pytest.approx(-0.196427, abs=1e-6)
    assert row["k"] == pytest.approx(-0.991095, abs=1e-6)


@pytest.mark.parametrize("span,chunk", [(12, 8), (3, 16), (26, 256), (1, 8)])
def test_ema_equals_the_recursion_over_chunk_borders(panel, span, chunk):
    rng = np.random.default_rng(1)
    xs = (100 + rng.normal(size=90).cumsum()).tolist()
    alpha, y = 2 / (span + 1), []
    for x in xs:
        y.append(x if not y else alpha * x + (1 - alpha) * y[-1])
    got = column(X.ema(panel({"A": xs, "B": xs[::-1]}), "price", span, "e", chunk), "e")
    assert got[:90] == pytest.approx(y, rel=1e-12)


def test_rsi_rules(panel):
    got = X.rsi(panel({"FLAT": [5] * 20, "UP": range(1, 21)}))
    assert column(got.filter("asset = 'UP'"), "rsi")[-1] == 100.0
    assert column(got.filter("asset = 'FLAT'"), "rsi")[-1] is None
    assert column(got.filter("asset = 'UP'"), "rsi")[:14] == [None] * 14


def test_forward_return_of_constant_growth(panel):
    g = 0.001
    rets = X.simple_return(panel({"A": [(1 + g) ** i for i in range(70)]}))
    got = column(X.forward_return(rets), "target")
    assert got[0] == pytest.approx((1 + g) ** 63 - 1)
    assert got[-63:] == [None] * 63


def test_rolling_waits_for_full_window(panel):
    got = column(X.moving_average_distance(panel({"A": range(1, 8)}), (5,)), "ma_5")
    assert got == [None] * 4 + [3.0, 4.0, 5.0]


def test_returns_skip_missing_prices(panel):
    got = X.simple_return(panel({"A": [10, None, 11]}))
    assert column(got, "ret") == [None, pytest.approx(0.1)]


def test_last_label_is_zero(panel):
    got = X.next_day_label(panel({"A": [0.0, 0.01, 0.02]}, name="ret"))
    assert column(got, "label") == [1, 1, 0]


def test_train_only_thresholds_ignore_later_rows(panel):
    base = [((i * 37) % 21 - 10) / 1000 for i in range(60)]
    shocked = base[:40] + [9.0] * 20
    label = lambda xs: column(
        X.ternary_label(X.next_day_label(panel({"A": xs}, name="ret")), fit_on=F.col("date") < F.lit("2000-02-06").cast("date")), "tri_label"
    )
    assert label(base)[:30] == label(shocked)[:30]


def test_drawdown_start_at_one(panel):
    x = panel({"A": [0.8, 0.9, 1.2, 0.6]}, name="growth")
    assert column(X.drawdown(x), "drawdown") == pytest.approx([0, 0, 0, -0.5])
    assert column(X.drawdown(x, start_at_one=True), "drawdown") == pytest.approx([-0.2, -0.1, 0, -0.5])


def test_bounded_forward_fill_stops_after_three(panel):
    got = A.forward_fill(panel({"A": [1, None, None, None, None, 2]}, name="ret"), 3)
    assert column(got, "ret") == [1, 1, 1, 1, None, 2]


def test_momentum_and_regime_need_thirty_rows(panel):
    x = panel({"A": [0.01] * 40}, name="ret")
    m, g = X.momentum(x), X.regime(x)
    assert column(m, "signal")[:29] == [0] * 29
    assert column(g, "regime")[:29] == ["uncertain"] * 29
    assert column(g, "regime")[-1] in ("bull_trend", "sideways")


def test_unsmoothing_only_when_it_pays(panel):
    rng = np.random.default_rng(3)
    e = rng.normal(size=200)
    smooth = [e[0]]
    for v in e[1:]:
        smooth.append(0.5 * smooth[-1] + 0.5 * v)
    out = X.unsmooth(panel({"S": smooth, "SHORT": [0.1] * 10}, name="ret"))
    assert column(out.filter("asset = 'SHORT'"), "unsmoothed") == [0.1] * 10
    rho = np.corrcoef(smooth[1:], smooth[:-1])[0, 1]
    got = column(out.filter("asset = 'S'"), "unsmoothed")
    assert got[5] == pytest.approx((smooth[5] - rho * smooth[4]) / (1 - rho))


def test_split_adjustment_is_cumulative(spark, panel):
    import datetime as dt

    px = panel({"A": [100, 100, 50, 50, 10]})
    splits = spark.createDataFrame([("A", dt.date(2000, 1, 5)), ("A", dt.date(2000, 1, 7))], "asset STRING, split_date DATE")
    assert column(A.split_adjust(px, splits), "adjusted") == pytest.approx([10, 10, 10, 10, 10])


def test_volatility_annualises(panel):
    got = column(X.rolling_volatility(panel({"A": RETURNS * 4}, name="ret"), 20, annualise=True), "volatility_20")
    assert got[19] == pytest.approx(np.std((RETURNS * 4)[:20], ddof=1) * math.sqrt(252))
