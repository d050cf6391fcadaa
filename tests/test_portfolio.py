import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import fusion as FU
from tidepanel.operators import moments as MO
from tidepanel.operators import portfolio as PF
from tidepanel.operators import search as S
from tidepanel.operators import tactical as T

MU = [0.08, 0.12, 0.05]
COV = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.002], [0.0, 0.002, 0.01]])


@pytest.fixture(scope="module")
def cma(spark):
    return spark.createDataFrame([("B", 100, MU, COV.ravel().tolist())], "book STRING, n BIGINT, mu ARRAY<DOUBLE>, cov ARRAY<DOUBLE>")


@pytest.fixture(scope="module")
def cloud(cma):
    return S.score(S.lattice(cma, 3, 20), 3, 0.02).persist()


def w_of(row, p=3):
    return np.array([row[f"w{i}"] for i in range(p)])


def test_lattice_is_the_whole_simplex(cloud):
    rows = cloud.select("w0", "w1", "w2").collect()
    assert len(rows) == math.comb(22, 2) == len({tuple(r) for r in rows})
    assert all(abs(sum(r) - 1) < 1e-12 and min(r) >= 0 for r in rows)


def test_optima_match_exhaustive_search(cloud):
    ws = [np.array([i, j, 20 - i - j]) / 20 for i in range(21) for j in range(21 - i)]
    vol = lambda w: math.sqrt(w @ COV @ w)
    sharpe = lambda w: (w @ MU - 0.02) / vol(w)
    assert w_of(S.max_sharpe(cloud, 3).first()) == pytest.approx(max(ws, key=sharpe))
    assert w_of(S.min_variance(cloud, 3).first()) == pytest.approx(min(ws, key=vol))
    hit = S.target_volatility(cloud, 3, 0.15).first()
    assert hit["met"] and hit["vol"] <= 0.15 + 1e-12
    assert hit["ret"] == pytest.approx(max(w @ MU for w in ws if vol(w) <= 0.15))
    low = S.target_volatility(cloud, 3, 0.001).first()
    assert not low["met"] and w_of(low) == pytest.approx(min(ws, key=vol))
    assert S.exact_volatility(cloud, 3, 0.001).first()["case"] == "min_variance"
    assert S.exact_volatility(cloud, 3, 0.9).first()["case"] == "max_return"
    rc = lambda w: w * (COV @ w) / (w @ COV @ w)
    assert w_of(S.equal_risk(cloud, 3).first()) == pytest.approx(min(ws, key=lambda w: ((rc(w) - 1 / 3) ** 2).sum()))


def test_refinement_does_not_get_worse(cma, cloud):
    coarse = S.max_sharpe(cloud, 3)
    fine = S.max_sharpe(S.refine(cma, 3, 0.02, coarse, 0.05, 5), 3).first()
    assert fine["sharpe"] >= coarse.first()["sharpe"] - 1e-12
    assert w_of(fine).sum() == pytest.approx(1)


def test_bounds_and_group_cap(cloud):
    out = S.within(cloud, ["A", "B", "C"], {"A": (0.2, 0.5), "B": (0.1, 0.4)}, group=("A", "B"), group_cap=0.6)
    for r in out.collect():
        assert 0.2 - 1e-9 <= r["w0"] <= 0.5 + 1e-9 and r["w0"] + r["w1"] <= 0.6 + 1e-9
    assert S.resolve_bounds(["A"], {"A": (0.0, 0.5)})[1] is False


def test_dirichlet_is_a_simplex_and_repeats(cma):
    a = S.dirichlet(cma, 3, 4000)
    rows = np.array([w_of(r) for r in a.collect()])
    assert rows.sum(axis=1) == pytest.approx(np.ones(4000))
    assert rows.mean(axis=0) == pytest.approx([1 / 3] * 3, abs=0.02)
    assert rows.var(axis=0) == pytest.approx([1 / 18] * 3, abs=0.006)
    again = S.dirichlet(cma.repartition(3), 3, 4000)
    assert a.exceptAll(again).count() == 0


def test_pareto_equals_the_sequential_filter(spark):
    rng = np.random.default_rng(5)
    pts = [(f"p{i}", float(v), float(r)) for i, (v, r) in enumerate(zip(rng.random(500), rng.random(500)))]
    best, want = -1.0, set()
    for name, v, r in sorted(pts, key=lambda t: (t[1], t[2])):
        if r >= best - 1e-10:
            want.add(name)
            best = max(best, r)
    df = spark.createDataFrame([("B", *p) for p in pts], "book STRING, name STRING, vol DOUBLE, ret DOUBLE")
    assert {r["name"] for r in S.pareto(df, shards=7).collect()} == want


@pytest.mark.parametrize("size", [1, 5, 100, 101, 997])
def test_downsampling_rules(spark, size):
    df = spark.range(size).select(F.lit("B").alias("book"), "id")
    n = 100
    got = {rule: sorted(r["id"] for r in S.downsample(df, n, ["id"], rule).collect()) for rule in ("linspace", "floor")}
    if size <= n:
        assert got["linspace"] == got["floor"] == list(range(size))
    else:
        assert got["linspace"] == sorted({int(i * ((size - 1) / (n - 1))) for i in range(n)})
        assert got["floor"] == sorted({math.floor(i * (size / n)) for i in range(n)})


def books(spark, rows):
    return spark.createDataFrame(rows, "book STRING, asset STRING, w DOUBLE")


def test_mandate_violations_are_listed(spark):
    lim = spark.createDataFrame([("A", 0.1, 0.5, "equity"), ("B", 0.1, 0.5, "equity"), ("C", 0.0, 1.0, "safe")], "asset STRING, lb DOUBLE, ub DOUBLE, role STRING")
    w = books(spark, [("ok", "A", 0.3), ("ok", "B", 0.3), ("ok", "C", 0.4), ("bad", "A", 0.8)])
    out = {r["book"]: r for r in PF.mandate_check(w, lim, "equity", 0.65).collect()}
    assert out["ok"]["violations"] == [] and out["ok"]["asset_bounds_ok"]
    assert out["bad"]["violations"] == ["A outside bounds", "B outside bounds", "group exceeds cap", "weights do not sum to 1"]


def test_enforced_weights_respect_bounds(spark):
    lim = spark.createDataFrame([("A", 0.1, 0.5, "equity"), ("B", 0.1, 0.5, "equity"), ("C", 0.0, 1.0, "safe")], "asset STRING, lb DOUBLE, ub DOUBLE, role STRING")
    w = books(spark, [("x", "A", 0.9), ("x", "B", 0.1), ("x", "C", 0.0), ("y", "A", 0.0), ("y", "B", 0.0), ("y", "C", 1.0)])
    out = PF.enforce_bounds(w, lim, "equity", 0.55, "C").collect()
    for book in "xy":
        ws = {r["asset"]: r["w"] for r in out if r["book"] == book}
        assert sum(ws.values()) == pytest.approx(1)
        assert ws["A"] + ws["B"] <= 0.55 + 1e-6
    y = {r["asset"]: r["w"] for r in out if r["book"] == "y"}
    assert y["A"] >= 0.1 - 1e-9 and y["B"] >= 0.1 - 1e-9


def test_redistribution(spark):
    out = PF.redistribute(books(spark, [("x", "A", 0.5), ("x", "B", 0.3), ("x", "C", 0.2)]), "A", 0.2).collect()
    assert {r["asset"]: round(r["w"], 6) for r in out} == {"A": 0.2, "B": 0.48, "C": 0.32}
    alone = PF.redistribute(books(spark, [("x", "A", 0.5)]), "A", 0.2).first()
    assert alone["w"] == 1.0


def test_risk_shares_sum_to_one(spark, cma):
    e = PF.exposures(books(spark, [("x", "A", 0.5), ("x", "B", 0.3), ("x", "C", 0.2)]), ["A", "B", "C"], cma, 0.02).first()
    assert e["rc0"] + e["rc1"] + e["rc2"] == pytest.approx(1)
    w = np.array([0.5, 0.3, 0.2])
    assert e["vol"] == pytest.approx(math.sqrt(w @ COV @ w))


def test_gram_equals_pairwise(spark, panel):
    rng = np.random.default_rng(2)
    data = {a: [None if rng.random() < 0.3 else float(v) for v in rng.normal(0, 0.01, 60)] for a in "ABCD"}
    x = panel(data, name="ret")
    key = lambda r: (r["asset_a"], r["asset_b"])
    narrow = sorted(MO.pair_moments(x, list("ABCD")).collect(), key=key)
    wide = sorted(MO.gram_moments(x.repartition(3), list("ABCD")).collect(), key=key)
    for a, b in zip(narrow, wide):
        assert (a["n"], a["cov"], a["corr"]) == (b["n"], pytest.approx(b["cov"], rel=1e-9), pytest.approx(b["corr"], rel=1e-9))


def test_blend_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 1), (1, -1), (0, 1), (-1, -1)], "c INT, m INT")
    assert [r["b"] for r in df.select(T.blend(F.col("c"), F.col("m")).alias("b")).collect()] == [1, 0, 0, -1]


def test_tilt_nets_to_zero(spark):
    d = spark.createDataFrame([(1, 1, 0.9, 1.5, "rising", -0.1), (2, 0, 0.9, 1.5, "low", 0.1), (3, -1, 0.9, 1.2, "high", -0.1)], "id INT, signal INT, confidence DOUBLE, size DOUBLE, inflation_regime STRING, real_yield DOUBLE")
    mult = spark.createDataFrame([("rising", "E", 1.1), ("high", "C", 0.5), ("high", "G", 1.5)], "inflation_regime STRING, asset STRING, multiplier DOUBLE")
    t = FU.inflation_modifier(FU.base_tilt(d, "E", ("G", "C")), mult, ["id"], "C").collect()
    assert {r["id"] for r in t} == {1, 3}
    for i in (1, 3):
        assert sum(r["tilt"] for r in t if r["id"] == i) == pytest.approx(0, abs=2e-4)
    assert all(r["tilt"] <= 0 for r in t if r["id"] == 3 and r["asset"] == "C")


def test_narrow_and_wide_moments_agree_on_shifted_data(spark):
    import random

    from tidepanel.operators import moments as MO

    r = random.Random(2)
    for p in (15, 16, 17):
        names = [f"A{k:02d}" for k in range(p)]
        rows = [(a, dt.date(2020, 1, 1) + dt.timedelta(days=t), 1e6 + r.gauss(0, 1e-2)) for a in names for t in range(40) if r.random() < 0.9]
        x = spark.createDataFrame(rows, "asset STRING, date DATE, ret DOUBLE")
        wide = {(m.i, m.j): m for m in MO.gram_moments(x.repartition(3), names).collect()}
        narrow = MO._unrolled(MO.wide(x, names), names).collect()
        assert len(narrow) == len(wide) == p * p
        for m in narrow:
            w = wide[m.i, m.j]
            assert w.n == m.n and abs(w.cov - m.cov) < 1e-6 * abs(wide[m.i, m.i].cov) + 1e-12 and abs(w.corr - m.corr) < 1e-5


def test_tiles_equal_the_pairwise_sums(spark):
    """200 assets over blocks of 64 and of all, gaps, an asset apart from the rest and
    one without any value; listed and unlisted universes against numpy."""
    p, days = 200, 90
    rng = np.random.default_rng(31)
    x = 5 + rng.normal(0, 0.01, (days, p)) + rng.normal(0, 0.01, (days, 1))
    x[rng.random((days, p)) < 0.4] = np.nan
    x[:, 7], x[:, 9] = np.nan, np.nan
    x[80:] = np.nan
    x[85, 7] = 0.5
    names = [f"A{k:03d}" for k in range(p)]
    start = dt.date(2019, 12, 1)
    rows = [(names[k], start + dt.timedelta(days=t), float(x[t, k])) for t in range(days) for k in range(p) if k != 9]
    df = spark.createDataFrame([(a, d, None if v != v and d.day % 2 else v) for a, d, v in rows], "asset STRING, date DATE, ret DOUBLE")
    want = {}
    for i in range(p):
        for j in range(i, p):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            n = int(both.sum())
            want[names[i], names[j]] = n, float(np.cov(x[both, i], x[both, j])[0, 1]) if n > 1 else None
    for tile in (64, 256):
        got = {(m.asset_a, m.asset_b): (m.i, m.j, m.n, m.cov) for m in MO.gram_moments(df, names, tile=tile).collect()}
        assert len(got) == p * p
        for (a, b), (i, j, n, cov) in got.items():
            n0, cov0 = want[min(a, b), max(a, b)]
            assert (names[i], names[j], n) == (a, b, n0) and ((cov is None) == (cov0 is None) and (cov is None or abs(cov - cov0) < 1e-12))
    for least, tile in ((1, 64), (30, 256)):
        got = [(m.asset_a, m.asset_b, m.n, m.cov) for m in MO.universe_moments(df, least, tile).collect()]
        assert len(got) == len({g[:2] for g in got}) and {g[:2] for g in got} == {k for k, (n, _) in want.items() if n >= least}
        assert all(n == want[a, b][0] and (n < 2 or abs(cov - want[a, b][1]) < 1e-12) for a, b, n, cov in got)
    nothing = df.filter("false")
    assert MO.universe_moments(nothing).count() == 0 and {m.n for m in MO.gram_moments(nothing, ["A", "B"]).collect()} == {0}


def test_wide_blocks_send_few_copies(spark):
    """A value goes to the tasks once for each block, and blocks hold many tiles."""
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=t), float((k * 7 + t * t) % 11)) for k in range(400) for t in range(6)]
    df = spark.createDataFrame(rows, "asset INT, date DATE, ret DOUBLE")
    assert -(-400 // MO._block_width(spark, 400, 4)) <= 16 and MO._block_width(spark, 10**6, 4) == 4 * MO.BLOCK_TILES
    want = {(a, b): (n, pytest.approx(cov)) for a, b, n, cov, _ in MO.universe_moments(df, 2, 400).collect()}
    got = {(a, b): (n, cov) for a, b, n, cov, _ in MO.universe_moments(df, 2, 4).collect()}
    assert len(got) == 400 * 401 // 2 and got == want


def test_values_of_a_universe_are_dealt_once(spark):
    """Three times the assets send about three times the bytes to the pairs, not nine times."""

    def sent(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            return sent(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
        children = plan.children()
        below = sum(sent(children.apply(k)) for k in range(children.length()))
        return below + (plan.metrics().apply("shuffleBytesWritten").value() if kind == "ShuffleExchangeExec" else 0)

    def universe(p):
        cells = spark.range(40 * p).select((F.col("id") % p).alias("asset"), F.expr(f"date_add(DATE'2020-01-01', int(id / {p}))").alias("date"), F.rand(7).alias("ret"))
        ran = MO.universe_moments(cells, 41, 4)._jdf.queryExecution()
        assert ran.toRdd().count() == 0
        return sent(ran.executedPlan())

    narrow, wide = universe(240), universe(720)
    assert 240 * 40 * 4 < narrow and 2 * narrow < wide < 4.5 * narrow


def test_tiles_of_few_values_and_assets_of_any_kind(spark, monkeypatch):
    """Tiles end with their values as with their assets; rows without a date or an asset."""
    rng = np.random.default_rng(5)
    rows = [(f"S{k:02d}", dt.date(2020, 1, 1) + dt.timedelta(days=t), float(rng.normal(3, 1))) for k in range(30) for t in range(50) if rng.random() < 0.6]
    df = spark.createDataFrame([*rows, (None, dt.date(2020, 1, 1), 1.0), (None, dt.date(2020, 1, 2), 2.0)], "asset STRING, date DATE, ret DOUBLE")
    key = lambda m: (m.asset_a, m.asset_b)
    want = sorted(MO.universe_moments(df, 2).collect(), key=key)
    assert len(want) == 30 * 31 // 2 and all(m.asset_a <= m.asset_b for m in want)
    monkeypatch.setattr(MO, "TILE_CELLS", 40)
    stamped = df.withColumn("date", F.col("date").cast("timestamp"))
    for x in (df, stamped):
        got = sorted(MO.universe_moments(x, 2).collect(), key=key)
        assert [(key(m), m.n) for m in got] == [(key(m), m.n) for m in want]
        assert [(m.cov, m.corr) for m in got] == [(pytest.approx(m.cov), pytest.approx(m.corr)) for m in want]


def test_book_rows_do_not_depend_on_the_path(spark):
    from tidepanel.operators import portfolio as PF

    days = [dt.date(2020, 1, 1) + dt.timedelta(days=t) for t in range(4)]
    x = spark.createDataFrame([("A", days[0], 0.1), ("B", days[1], 0.2), ("C", days[3], 0.3), ("C", days[2], None)], "asset STRING, date DATE, ret DOUBLE")
    w = spark.createDataFrame([("p", "A", 0.5), ("q", "B", 1.0), ("q", "C", -1.0)], "book STRING, asset STRING, w DOUBLE")
    rows = lambda df: sorted((r.book, r.date, round(r.ret, 12)) for r in df.collect())
    assert rows(PF.book_returns(w, x, list("ABC"))) == rows(PF.book_returns(w, x)) and len(rows(PF.book_returns(w, x))) == 6


def test_states_reach_every_book_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(PF, "BLOCK_DAYS", 7)
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=k) for k in range(30)]
    states = spark.createDataFrame([(a, d, float(k)) for a, n in (("E", 30), ("G", 14), ("C", 1)) for k, d in enumerate(days[:n])], "asset STRING, as_of DATE, x DOUBLE")
    books = spark.createDataFrame([("b1", "bullish"), ("b2", "neutral")], "book STRING, bias STRING")
    got = PF.states_of_books(books, states)
    assert got.columns == ["book", "bias", "asset", "as_of", "x"]
    want = [(b, s, *x) for b, s in (("b1", "bullish"), ("b2", "neutral")) for x in states.collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert PF.states_of_books(books, states.limit(0)).count() == 0


def test_tilts_of_all_assets_net_in_a_book(spark):
    rows = [("b", "E", 1, 0.8, 1.0), ("b", "G", 1, 0.8, 1.0), ("b", "X", -1, 0.6, 0.5), ("b", "Y", 0, 0.9, 1.0), ("b", "Z", 1, 0.01, 0.2)]
    df = spark.createDataFrame(rows, "book STRING, asset STRING, signal INT, confidence DOUBLE, size DOUBLE")
    got = {r["asset"]: r["tilt"] for r in FU.net_tilts(df, ["book"], ("G", "C")).collect()}
    assert got == pytest.approx({"E": 0.04, "X": -0.015, "G": 0.04 - 0.02 - 0.02 + 0.0075, "C": -0.02 - 0.02 + 0.0075})
    assert sum(got.values()) == pytest.approx(0)


def test_one_row_of_assumptions_or_one_a_book(spark, cma):
    held = spark.createDataFrame([("B", "x", 0.5), ("B", "y", 0.5), ("D", "z", 1.0)], "book STRING, asset STRING, w DOUBLE")
    two = cma.unionByName(spark.createDataFrame([("D", 100, [0.01, 0.02, 0.30], COV.ravel().tolist())], cma.schema))
    own = {r["book"]: r["ret"] for r in PF.exposures(held, ["x", "y", "z"], two, 0.02, per_book=True).collect()}
    assert own == pytest.approx({"B": 0.10, "D": 0.30})
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        PF.exposures(held, ["x", "y", "z"], two, 0.02).collect()
