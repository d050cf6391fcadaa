import datetime as dt
import random

import numpy as np
import pytest

from tidepanel.operators import backtest as B
from tidepanel.operators import resample as RS
from tidepanel.operators import risk as R
from tidepanel.functions.draws import mix, uniform
from pyspark.sql import functions as F


def days(spark, start, n, step=1):
    rows = [(start + dt.timedelta(days=i * step),) for i in range(n)]
    return spark.createDataFrame(rows, "date DATE")


def test_rebalance_is_first_day_on_or_after_quarter_end(spark):
    d = spark.createDataFrame([(dt.date(2020, 1, 6),), (dt.date(2020, 3, 31),), (dt.date(2020, 7, 2),), (dt.date(2020, 7, 3),), (dt.date(2021, 1, 4),)], "date DATE")
    got = sorted(r["rebalance_date"] for r in B.rebalance_dates(d).collect())
    assert got == [dt.date(2020, 3, 31), dt.date(2020, 7, 2), dt.date(2021, 1, 4)]


def test_segments_do_not_leak(spark):
    cal = days(spark, dt.date(2019, 1, 1), 800)
    roles = B.calendar_roles(cal, B.segments(cal, "2020-01-01"))
    checks = B.leakage_checks(roles).collect()
    assert len(checks) > 3 and not any(c["overlap"] for c in checks)
    assert all(c["train_end"] < c["test_start"] for c in checks)
    # Test stretches cover the evaluation days once each.
    tested = roles.filter("role = 'test'").groupBy("date").count()
    assert tested.filter("count > 1").count() == 0
    assert tested.count() == cal.filter("date >= DATE '2020-01-01'").count()


def test_short_training_is_skipped(spark):
    cal = days(spark, dt.date(2019, 12, 1), 200)
    kinds = {r["kind"] for r in B.calendar_roles(cal, B.segments(cal, "2020-01-01")).select("kind").collect()}
    assert "inaugural" not in kinds


def test_drift_equals_the_daily_loop(spark, panel):
    rng = np.random.default_rng(11)
    n, bps = 200, 12.0
    data = {a: rng.normal(0.0005, 0.02, n).tolist() for a in "ABC"}
    x = panel(data, name="ret")
    dates = sorted(r["date"] for r in x.select("date").distinct().collect())
    reb = [dates[50], dates[120]]
    w0 = np.array([0.5, 0.3, 0.2])
    w, want = w0.copy(), []
    for t, day in enumerate(dates):
        w = w * np.array([1 + data[a][t] for a in "ABC"])
        r, w = w.sum() - 1, w / w.sum()
        if day in reb:
            r -= bps / 1e4 * np.abs(w - w0).sum()
            w = w0.copy()
        want.append(r)
    weights = spark.createDataFrame([("b", a, float(v)) for a, v in zip("ABC", w0)], "book STRING, asset STRING, w DOUBLE")
    out = B.drift_rebalance(weights, x, spark.createDataFrame([(d,) for d in reb], "rebalance_date DATE"), bps, list("ABC"))
    got = [r["ret"] for r in out.orderBy("date").collect()]
    assert got == pytest.approx(want, abs=1e-12)


def test_accounting_total_return_is_last_growth(spark, panel):
    rng = np.random.default_rng(4)
    x = panel({"A": rng.normal(0, 0.01, 300).tolist()}, name="ret").withColumnRenamed("asset", "book")
    total = R.performance(x, ["book"], 0.02).first()["total_return"]
    last = R.with_curves(x, ["book"]).orderBy(F.col("date").desc()).first()["growth"] - 1
    assert total == pytest.approx(last, abs=1e-4)


def test_turnover_first_segment_pays_for_everything(spark):
    w = spark.createDataFrame([(0, "A", 0.6), (0, "B", 0.4), (1, "A", 0.5), (1, "B", 0.5)], "segment INT, asset STRING, w DOUBLE")
    got = {r["segment"]: (r["turnover"], r["cost"]) for r in B.turnover(w, 12.0).collect()}
    assert got[0] == (pytest.approx(1.0), pytest.approx(0.0012)) and got[1][0] == pytest.approx(0.2)


def test_risk_guard_moves_to_cash(spark):
    w = spark.createDataFrame([(0, "A", 0.8), (0, "C", 0.2)], "segment INT, asset STRING, w DOUBLE")
    state = spark.createDataFrame([(0, True, True)], "segment INT, vol_breach BOOLEAN, drawdown_breach BOOLEAN")
    got = {r["asset"]: r["w"] for r in B.risk_controls(w, state, "C").collect()}
    assert got["A"] == pytest.approx(0.8 * 0.75 * 0.8) and sum(got.values()) == pytest.approx(1)


def test_overlay_keeps_the_budget(spark):
    w = spark.createDataFrame([(s, a, v) for s in (0, 1) for a, v in (("E", 0.5), ("G", 0.3), ("C", 0.2))], "segment INT, asset STRING, w DOUBLE")
    sig = spark.createDataFrame([(0, 1, 0.9, 1.0), (1, 1, 0.3, 1.0)], "segment INT, signal INT, confidence DOUBLE, size DOUBLE")
    out = B.tactical_overlay(w, sig, "E", ("G", "C")).collect()
    zero = {r["asset"]: r["w"] for r in out if r["segment"] == 0}
    assert sum(zero.values()) == pytest.approx(1) and zero["E"] == pytest.approx(0.527)
    assert {r["asset"]: r["w"] for r in out if r["segment"] == 1} == {"E": 0.5, "G": 0.3, "C": 0.2}


def test_draws_are_uniform(spark):
    u = [r["u"] for r in spark.range(20000).select(uniform(F.col("id"), 3, 8).alias("u")).collect()]
    assert np.mean(u) == pytest.approx(0.5, abs=0.01) and np.var(u) == pytest.approx(1 / 12, abs=0.003)
    hist, _ = np.histogram(u, bins=20, range=(0, 1))
    assert hist.min() > 850 and hist.max() < 1150
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.03


def test_bootstrap_equals_a_plain_loop(spark, panel):
    rng = np.random.default_rng(6)
    hist = rng.normal(0, 0.01, 80).tolist()
    x = panel({"b": hist}, name="ret").withColumnRenamed("asset", "book")
    got = {r["path"]: r for r in RS.path_outcomes(RS.bootstrap_paths(x, paths=4, horizon=25, block=10)).collect()}
    starts = {(r["p"], r["k"]): r["s"] for r in spark.range(1, 5).select(F.col("id").alias("p"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k")).select("p", "k", (mix(F.col("p"), F.col("k"), 8) % 71).alias("s")).collect()}
    for p in range(1, 5):
        path = np.concatenate([hist[starts[p, k] : starts[p, k] + 10] for k in range(3)])[:25]
        g = np.cumprod(1 + path)
        assert got[p]["terminal"] == pytest.approx(g[-1])
        assert got[p]["max_drawdown"] == pytest.approx((g / np.maximum.accumulate(g) - 1).min())


def test_parametric_paths_have_the_stated_moments(spark):
    b = spark.createDataFrame([("b", 0.10, 0.20)], "book STRING, ret DOUBLE, vol DOUBLE")
    for df in (6, None):
        s = RS.parametric_paths(b, paths=400, horizon=252, df=df).agg(F.avg("ret").alias("m"), F.stddev("ret").alias("s"), F.kurtosis("ret").alias("k")).first()
        assert s["m"] * 252 == pytest.approx(0.10, abs=0.05)
        assert s["s"] * 252**0.5 == pytest.approx(0.20, abs=0.01)
        assert (s["k"] > 1.0) if df else abs(s["k"]) < 0.15
    with pytest.raises(ValueError):
        RS.parametric_paths(b, df=5)


def test_books_that_fall_to_zero_start_again(spark):
    """Large moves and short weights, against the loop over days."""

    r = random.Random(3)
    days = [dt.date(2000, 1, 3) + dt.timedelta(days=k) for k in range(40)]
    rets = {a: [r.uniform(-0.6, 0.6) for _ in days] for a in "ABC"}
    x = spark.createDataFrame([(a, d, v) for a in "ABC" for d, v in zip(days, rets[a], strict=True)], "asset STRING, date DATE, ret DOUBLE")
    books = {"long": (0.5, 0.3, 0.2), "short": (2.0, -1.5, 0.5), "geared": (3.0, -1.0, -1.0)}
    w = spark.createDataFrame([(b, a, v) for b, ws in books.items() for a, v in zip("ABC", ws, strict=True)], "book STRING, asset STRING, w DOUBLE")
    reb = [days[k] for k in (9, 19, 30)]
    out = B.drift_rebalance(w, x, spark.createDataFrame([(d,) for d in reb], "rebalance_date DATE"), 25.0, list("ABC"))
    got = {(g.book, g.date): g.ret for g in out.collect()}
    resets = 0
    for book, target in books.items():
        now = list(target)
        for k, day in enumerate(days):
            now = [v * (1 + rets[a][k]) for v, a in zip(now, "ABC", strict=True)]
            total, want = sum(now), 0.0
            if total <= 0:
                now, resets = list(target), resets + 1
            else:
                want, now = total - 1, [v / total for v in now]
                if day in reb:
                    want -= 25 / 1e4 * sum(abs(v - t) for v, t in zip(now, target, strict=True))
                    now = list(target)
            assert abs(got[book, day] - want) < 1e-9 * max(1, abs(want))
    assert resets and len(got) == 120


def test_folded_paths_equal_paths_followed_by_day(spark):
    draw = random.Random(5)
    rows = [(b, dt.date(2000, 1, 3) + dt.timedelta(days=k), draw.gauss(0, s)) for b, s in (("calm", 0.01), ("wild", 0.3), ("ruined", 0.7)) for k in range(80)]
    rows += [("calm", dt.date(2001, 1, 1), None)] + [("short", dt.date(2000, 1, 3) + dt.timedelta(days=k), 0.01) for k in range(20)]
    daily = spark.createDataFrame(rows, "book string, date date, ret double")
    for horizon, block, paths in ((25, 10, 1100), (20, 10, 50), (7, 10, 50), (60, 1, 50)):
        day = {(r.book, r.path): r for r in RS.path_outcomes(RS.bootstrap_paths(daily, paths, horizon, block)).collect()}
        got = RS.bootstrap_outcomes(daily, paths, horizon, block).collect()
        assert len(got) == len(day) == 3 * paths
        for r in got:
            want = day[r.book, r.path]
            assert abs(r.terminal - want.terminal) < 1e-9 and abs(r.max_drawdown - want.max_drawdown) < 1e-9 and r.days == want.days
    assert min(r.terminal for r in got) == RS.FLOOR  # some paths fell to the floor
    assert RS.bootstrap_outcomes(daily.limit(0), 5).count() == RS.bootstrap_outcomes(daily, 0).count() == 0


def test_counted_quantiles_are_exact(spark, tmp_path):
    draw = random.Random(6)
    rows = [(k % 3, draw.choice((float(draw.randrange(5)), draw.gauss(0, 10.0 ** draw.randrange(8))))) for k in range(6000)]
    rows += [(7, 1.0), (8, 3.0), (8, 2.0), (8, None), (9, None)] + [(5, 4.0)] * 50
    spark.createDataFrame(rows, "book int, t double").write.parquet(f"{tmp_path}/v")
    values = spark.read.parquet(f"{tmp_path}/v").withColumn("u", -F.col("t"))
    shares = {"t": [0, 0.05, 0.25, 0.5, 0.95, 0.99, 1], "u": [0.5, 0.01]}
    want = {r[0]: r[1:] for r in values.groupBy("book").agg(*[F.percentile(c, F.array(*[F.lit(float(p)) for p in shares[c]])) for c in shares]).collect()}
    for levels in (0, 1, 2):
        got = {r[0]: r[1:] for r in RS.quantiles(values, "book", shares, levels).collect()}
        assert set(got) == {0, 1, 2, 5, 7, 8}
        for book, found in got.items():
            for mine, theirs in zip(found, want[book], strict=True):
                assert all(abs(a - b) <= 1e-9 * max(1.0, abs(b)) for a, b in zip(mine, theirs, strict=True))
