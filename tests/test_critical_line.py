"""Exact frontiers against enumeration of all active sets, and against optimality conditions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import critical_line as CL
from tidepanel.operators import search as S

SCHEMA = "book STRING, mu ARRAY<DOUBLE>, cov ARRAY<DOUBLE>"


def universe(books, p, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(books, p, 2 * p + 5))
    return r.normal(0.08, 0.05, (books, p)), x @ x.transpose(0, 2, 1) / (2 * p + 5) * 0.04


def frame(spark, mu, cov):
    return spark.createDataFrame([(f"b{k}", m.tolist(), c.ravel().tolist()) for k, (m, c) in enumerate(zip(mu, cov, strict=True))], SCHEMA)


def enumerated(mu, cov, lo, hi, price):
    """Best mix of half the variance less price times return, over all sets of bounds."""
    p, best = len(mu), None
    for state in itertools.product((0, 1, 2), repeat=p):
        free = [i for i in range(p) if state[i] == 1]
        w = np.where(np.array(state) == 2, hi, lo).astype(float)
        if free:
            held = [i for i in range(p) if state[i] != 1]
            n = len(free)
            left = np.zeros((n + 1, n + 1))
            left[:n, :n], left[:n, n], left[n, :n] = cov[np.ix_(free, free)], -1, 1
            right = np.append(price * mu[free] - cov[np.ix_(free, held)] @ w[held], 1 - w[held].sum())
            w[free] = np.linalg.solve(left, right)[:n]
        if abs(w.sum() - 1) < 1e-9 and (w >= lo - 1e-10).all() and (w <= hi + 1e-10).all():
            value = 0.5 * w @ cov @ w - price * mu @ w
            if best is None or value < best[0]:
                best = (value, w)
    return best[1]


@pytest.mark.parametrize(("p", "bounds"), [(3, None), (4, [(0.1, 0.5), (0.0, 0.3), (0.05, 0.6), (0.0, 0.4)])])
def test_mixes_at_any_price_equal_enumeration(p, bounds):
    mu, cov = universe(25, p, p)
    lo, hi = CL._limits(p, bounds, 1.0)
    lines = CL.walk(mu, cov, lo, hi)
    s = CL.segments(lines)
    for aversion in (0.3, 3.0, 12.0, 400.0):
        w, _, _ = CL.pick_utility(aversion)(lines, s)
        for k in range(len(mu)):
            assert np.allclose(w[k], enumerated(mu[k], cov[k], lo, hi, 1 / aversion), atol=1e-8)
    quiet, _, _ = CL.pick_min_variance(lines, s)
    assert all(np.allclose(quiet[k], enumerated(mu[k], cov[k], lo, hi, 0.0), atol=1e-8) for k in range(len(mu)))


@pytest.mark.parametrize(("p", "cap"), [(5, 1.0), (12, 0.25), (30, 0.1)])
def test_every_point_meets_the_conditions(spark, p, cap):
    mu, cov = universe(300, p, 7)
    cma = frame(spark, mu, cov)
    worst = lambda df: df.agg(F.max("kkt"), F.count("*")).first()
    for df, rows in (
        (CL.max_sharpe(cma, p, 0.02, weight_cap=cap), 300),
        (CL.min_variance(cma, p, 0.02, weight_cap=cap), 300),
        (CL.utility(cma, p, 0.02, 3.0, weight_cap=cap), 300),
        (CL.at_volatility(cma, p, 0.02, 0.08, weight_cap=cap), 300),
        (CL.frontier(cma, p, 0.02, 70, weight_cap=cap), 21_000),
    ):
        kkt, n = worst(df)
        assert kkt < 1e-8 and n == rows


def test_never_worse_than_the_lattice(spark):
    mu, cov = universe(6, 4, 11)
    cma = frame(spark, mu, cov).withColumn("n", F.lit(100))
    cloud = S.score(S.lattice(cma, 4, 20), 4, 0.02).persist()
    pairs = [
        (S.max_sharpe(cloud, 4), CL.max_sharpe(cma, 4, 0.02), "sharpe", 1),
        (S.min_variance(cloud, 4), CL.min_variance(cma, 4, 0.02), "vol", -1),
        (S.target_volatility(cloud, 4, 0.1), CL.at_volatility(cma, 4, 0.02, 0.1), "ret", 1),
        (S.max_return(cloud, 4), CL.max_return(cma, 4, 0.02), "ret", 1),
    ]
    for coarse, exact, name, sign in pairs:
        a = {r["book"]: r[name] for r in coarse.collect()}
        met = {r["book"] for r in coarse.collect() if "met" not in r or r["met"]}
        assert all(sign * r[name] >= sign * a[r["book"]] - 1e-9 for r in exact.collect() if r["book"] in met)


def test_frontier_rises_and_is_evenly_spaced(spark):
    mu, cov = universe(3, 6, 5)
    rows = CL.frontier(frame(spark, mu, cov), 6, 0.02, 15).orderBy("book", "point").collect()
    for k in range(3):
        own = [r for r in rows if r["book"] == f"b{k}"]
        ret, vol = np.array([r["ret"] for r in own]), np.array([r["vol"] for r in own])
        assert len(own) == 15 and (np.diff(vol) > 0).all()
        assert np.allclose(np.diff(ret), (ret[-1] - ret[0]) / 14) and np.isclose(ret[-1], mu[k].max())


def test_turning_points_start_and_end(spark):
    mu, cov = universe(4, 5, 9)
    points = CL.turning_points(frame(spark, mu, cov), 5).orderBy("book", "point").collect()
    for k in range(4):
        own = [r for r in points if r["book"] == f"b{k}"]
        assert np.isclose(own[0]["ret"], mu[k].max()) and own[-1]["lam"] == 0
        assert [r["lam"] for r in own] == sorted((r["lam"] for r in own), reverse=True)
        assert [r["point"] for r in own] == list(range(len(own)))


def test_odd_books(spark):
    mu, cov = universe(5, 4, 2)
    mu[0] = 0.05  # equal means
    mu[1, :2] = mu[1].max() + 0.01  # two best ones
    mu[2] = -0.03 - np.arange(4) / 100  # all below the risk-free rate
    cov[3] = np.diag([0.04, 0.04, 0.04, 0.04])
    mu[4, 1], cov[4, 1], cov[4, :, 1] = mu[4, 0], cov[4, 0], cov[4, :, 0]  # the same asset twice
    cov[4, 1, 1] = cov[4, 0, 0]
    cma = frame(spark, mu, cov)
    for df in (CL.max_sharpe(cma, 4, 0.02), CL.frontier(cma, 4, 0.02, 9), CL.min_variance(cma, 4, 0.02)):
        rows = df.collect()
        assert all(abs(sum(r[f"w{i}"] for i in range(4)) - 1) < 1e-9 and min(r[f"w{i}"] for i in range(4)) >= -1e-12 for r in rows)
        assert all(np.isfinite([r["ret"], r["vol"], r["sharpe"]]).all() for r in rows)
    equal = {r["book"]: [r[f"w{i}"] for i in range(4)] for r in CL.min_variance(cma, 4, 0.02).collect()}
    assert np.allclose(equal["b3"], 0.25)
    # a single mix, no mix, no book
    only = CL.max_sharpe(cma, 4, 0.02, bounds=[(0.4, 0.6), (0.3, 0.5), (0.2, 0.2), (0.1, 0.9)]).collect()
    assert all([r[f"w{i}"] for i in range(4)] == pytest.approx([0.4, 0.3, 0.2, 0.1]) for r in only)
    assert CL.max_sharpe(cma, 4, 0.02, bounds=[(0.0, 0.1)] * 4).count() == 5
    assert CL.turning_points(cma.limit(0), 4).count() == 0
    low = CL.at_volatility(cma, 4, 0.02, 1e-6).collect()
    assert not any(r["met"] for r in low) and {r["case"] for r in low} == {"min_variance"}
    assert {r["case"] for r in CL.at_volatility(cma, 4, 0.02, 9.0).collect()} == {"max_return"}


def test_many_wide_books(spark):
    """No row a mix: a book is one row in and one row out."""
    p = 30
    mu, cov = universe(4, p, 21)
    base = frame(spark, mu, cov)
    lean = F.transform("mu", lambda m, i: m + F.pmod(F.xxhash64("k", i), F.lit(1000)) / F.lit(20_000.0))
    many = base.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(500)))).repartition(8).select(F.concat("book", F.lit("-"), "k").alias("book"), lean.alias("mu"), "cov")
    n, kkt, low = CL.max_sharpe(many, p, 0.02, weight_cap=0.2).agg(F.count("*"), F.max("kkt"), F.min("sharpe")).first()
    assert n == 2000 and kkt < 1e-8 and low > 0


BOUNDS = [(0.10, 0.50), (0.04, 0.30), (0.05, 0.35), (0.04, 0.45), (0.04, 0.35)]


def test_projection_is_the_nearest_mix(spark):
    r = np.random.default_rng(1)
    raw = np.concatenate([r.dirichlet(np.ones(5), 200), r.normal(0, 1, (50, 5)), np.eye(5), [[0.2] * 5]])
    cols = [f"w{i}" for i in range(5)]
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(raw)], "k INT, " + ", ".join(f"{c} DOUBLE" for c in cols))
    got = {x["k"]: np.array([x[c] for c in cols]) for x in S.project(df, 5, BOUNDS).collect()}
    lo, hi = np.array(BOUNDS).T
    others = [w for w in r.dirichlet(np.ones(5), 60_000) if (w >= lo).all() and (w <= hi).all()]
    assert len(got) == len(raw) and len(others) > 1000
    others = np.array(others)
    for k, x in enumerate(raw):
        w = got[k]
        assert abs(w.sum() - 1) < 1e-9 and (w >= lo - 1e-12).all() and (w <= hi + 1e-12).all()
        # nothing within the bounds is nearer: moving towards any other mix leads away
        assert ((others - w) @ (w - x) > -1e-9).all()
    inside = S.project(df, 5, [(0.0, 1.0)] * 5).where("k < 200").collect()
    assert all(np.allclose([x[c] for c in cols], raw[x["k"]], atol=1e-12) for x in inside)
    with pytest.raises(ValueError, match="bounds"):
        S.project(df, 5, [(0.0, 0.1)] * 5)
