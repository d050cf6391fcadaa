import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import impute as I
from tidepanel.operators import learning as L


def holes(seed=9, n=60):
    rng = np.random.default_rng(seed)
    base = rng.multivariate_normal([0.001, 0.0, -0.001], [[4e-4, 2e-4, 0], [2e-4, 3e-4, 1e-4], [0, 1e-4, 2e-4]], n)
    base[:20, 0] = np.nan
    base[40:, 2] = np.nan
    base[rng.random((n, 3)) < 0.1] = np.nan
    return base


def reference_em(x, iterations):
    """Row-by-row textbook EM, written for this test only."""
    n, p = x.shape
    mu = np.nanmean(x, axis=0)
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(p):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            cov[i, j] = np.cov(x[ok, i], x[ok, j])[0, 1] if ok.sum() > 1 else 0
    cov = I.nearest_psd(cov)
    for _ in range(iterations):
        filled, extra = x.copy(), np.zeros((p, p))
        for r in range(n):
            m = np.isnan(x[r])
            if not m.any():
                continue
            o = ~m
            b = cov[np.ix_(m, o)] @ np.linalg.inv(cov[np.ix_(o, o)]) if o.any() else np.zeros((m.sum(), 0))
            filled[r, m] = mu[m] + b @ (x[r, o] - mu[o])
            extra[np.ix_(m, m)] += cov[np.ix_(m, m)] - b @ cov[np.ix_(o, m)]
        mu = filled.mean(axis=0)
        cov = I.nearest_psd((filled.T @ filled + extra) / n - np.outer(mu, mu))
    return mu, cov, filled


@pytest.mark.parametrize("max_patterns", [4096, 0])
def test_em_by_patterns_equals_em_by_rows(panel, max_patterns):
    x = holes()
    x = x[~np.isnan(x).all(axis=1)]
    data = {a: [None if np.isnan(v) else float(v) for v in x[:, i]] for i, a in enumerate("ABC")}
    df = panel(data, name="ret").filter("ret IS NOT NULL")
    steps = 4
    m = I.em_fit(df, list("ABC"), max_iter=steps, max_patterns=max_patterns)
    mu, cov, filled = reference_em(x, steps)
    assert m.mu == pytest.approx(mu, abs=1e-12)
    assert m.cov == pytest.approx(cov, abs=1e-12)
    out = I.em_complete(df, list("ABC"), m).orderBy("date", "asset").collect()
    assert np.array([r["ret"] for r in out]).reshape(-1, 3) == pytest.approx(filled, abs=1e-12)
    assert sum(r["is_imputed"] for r in out) == int(np.isnan(x).sum())


def test_wide_em_equals_em_by_rows(spark):
    """40 assets: tiles as starting point, one whole inverse for patterns with few holes."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 0.01, (160, 40)) + rng.normal(0, 0.01, (160, 1))
    x[rng.random(x.shape) < 0.15] = np.nan
    x[::9, :30] = np.nan
    names = [f"A{i:02d}" for i in range(40)]
    rows = [(names[i], dt.date(2020, 1, 1) + dt.timedelta(days=t), float(x[t, i])) for t in range(160) for i in range(40) if x[t, i] == x[t, i]]
    df = spark.createDataFrame(rows, "asset STRING, date DATE, ret DOUBLE")
    m = I.em_fit(df, names, max_iter=3)
    mu, cov, filled = reference_em(x, 3)
    assert m.mu == pytest.approx(mu, abs=1e-11) and m.cov == pytest.approx(cov, abs=1e-11)
    out = I.em_complete(df, names, m).orderBy("date", "asset").collect()
    assert np.array([r["ret"] for r in out]).reshape(-1, 40) == pytest.approx(filled, abs=1e-10)


def test_em_converges_and_is_psd(panel):
    x = holes()
    data = {a: [None if np.isnan(v) else float(v) for v in x[:, i]] for i, a in enumerate("ABC")}
    m = I.em_fit(panel(data, name="ret").filter("ret IS NOT NULL"), list("ABC"))
    assert m.converged and np.linalg.eigvalsh(m.cov).min() > 0


def test_thin_assets_leave_the_model_but_not_the_schema(panel):
    data = {"A": [0.01, -0.01] * 10, "B": [0.02, 0.01] * 10, "THIN": [0.1] + [None] * 19}
    df = panel(data, name="ret").filter("ret IS NOT NULL")
    m = I.em_fit(df, ["A", "B", "THIN"], max_iter=2)
    assert m.assets == ["A", "B"]
    out = I.em_complete(df, ["A", "B", "THIN"], m)
    assert out.filter("asset = 'THIN' AND ret IS NULL").count() == 20
    with pytest.raises(ValueError):
        I.em_fit(df, ["THIN"])
    panel_, code = I.completed_panel(df, ["THIN"])
    assert code == "EM_FAILURE" and panel_.count() == 1


def test_near_singular_blocks_are_shrunk():
    cov = np.array([[1.0, 1.0, 0.5], [1.0, 1.0, 0.5], [0.5, 0.5, 1.0]])
    beta, resid = I.regression(np.zeros(3), cov, np.array([True, True, False]))
    assert np.isfinite(beta).all() and resid[0, 0] > 0
    assert np.linalg.eigvalsh(I.nearest_psd(np.array([[1.0, 2.0], [2.0, 1.0]]))).min() > 0


def stacked(spark, n=120):
    rng = np.random.default_rng(0)
    rows = []
    import datetime as dt

    for asset in ("A", "B"):
        x = rng.normal(size=(n, 2))
        y = x @ [0.5, -0.2] + rng.normal(0, 0.1, n)
        rows += [(asset, dt.date(2000, 1, 1) + dt.timedelta(i), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "asset STRING, date DATE, f0 DOUBLE, f1 DOUBLE, y DOUBLE")


def test_fold_arithmetic(spark):
    f = L.regression_folds(stacked(spark))
    ends = {(r["fold"], r["train_end"], r["test_end"]) for r in f.select("fold", "train_end", "test_end").collect()}
    assert ends == {(0, 60, 75), (1, 75, 90), (2, 90, 105), (3, 105, 120)}
    assert f.filter("role = 'train' AND pos >= train_end").count() == 0
    assert L.regression_folds(stacked(spark, 80)).count() == 0


def test_ridge_matches_numpy(spark):
    rows = stacked(spark)
    pred = L.ridge(L.standardise(L.regression_folds(rows), ("f0", "f1")), ("f0", "f1"))
    got = {(r["asset"], r["fold"], r["pos"]): r["pred"] for r in pred.collect()}
    data = rows.filter("asset = 'A'").orderBy("date").toPandas()
    x, y = data[["f0", "f1"]].to_numpy(), data["y"].to_numpy()
    lo, hi = np.quantile(x[:75], 0.01, axis=0), np.quantile(x[:75], 0.99, axis=0)
    c = np.clip(x, lo, hi)
    z = (c - c[:75].mean(axis=0)) / c[:75].std(axis=0)
    beta = np.linalg.solve(z[:75].T @ z[:75] + np.eye(2), z[:75].T @ (y[:75] - y[:75].mean()))
    want = y[:75].mean() + z[80] @ beta
    assert got["A", 1, 80] == pytest.approx(want)
    skill = L.model_skill(L.fold_skill(pred)).collect()
    assert all(r["median_r2"] > 0.8 and r["fold_count"] == 4 for r in skill)


def test_weighted_scores_by_hand(spark):
    pairs = [(1, 1), (1, 0), (0, 0), (0, 0), (-1, 0), (-1, -1)]
    df = spark.createDataFrame([("A", *p) for p in pairs], "asset STRING, y INT, pred INT")
    s = L.weighted_scores(df, ["asset"]).first()
    assert s["accuracy"] == pytest.approx(4 / 6)
    assert s["f1_weighted"] == pytest.approx((2 * (2 / 3) + 2 * (4 / 6) + 2 * (2 / 3)) / 6)


def test_forecast_falls_back_on_thin_history(spark):
    rows = stacked(spark, 40)
    none = L.model_skill(L.fold_skill(L.ridge(L.standardise(L.regression_folds(rows), ("f0",)), ("f0",))))
    out = L.forecast(rows, none).collect()
    assert {r["method"] for r in out} == {"recent_mean"} and {r["confidence"] for r in out} == {0.2}
    tail = rows.filter("asset = 'A'").orderBy(F.col("date").desc()).limit(30).agg(F.avg("y")).first()[0]
    assert next(r for r in out if r["asset"] == "A")["expected_daily"] == pytest.approx(tail / 63)


def test_classifier_confidence_dampers(spark):
    rows = [(0.5, 0.6, 0.05, 0.1, False, 0.5, 1), (0.5, 0.6, 0.2, 0.3, True, 0.41, 1)]
    df = spark.createDataFrame(rows, "mean_f1 DOUBLE, max_prob DOUBLE, fold_std DOUBLE, calibration_error DOUBLE, disagreement BOOLEAN, ensemble_f1 DOUBLE, raw_signal INT")
    a, b = L.classifier_confidence(df).collect()
    assert (a["signal"], a["confidence"]) == (1, pytest.approx(0.3))
    assert (b["signal"], b["confidence"]) == (0, pytest.approx(0.3 * 0.76 * 0.84 * 0.87))


def test_registered_boosted_trees_use_all_rounds(spark, monkeypatch):
    from tidepanel.plans import learning as PL

    made = []
    monkeypatch.setattr(PL, "_classification", lambda spark, sf: None)
    monkeypatch.setattr(PL.L, "fit_folds", lambda x, cols, make, name, classifier: made.append(make()))
    monkeypatch.setattr(PL, "_classifier_scores", lambda pred: None)
    PL.ml_08(spark, "")
    assert made[0].getClassifier().getMaxIter() == 200


def class_rows(spark, flip_after=99):
    """Two models' predictions over five folds of ten days; labels of late folds may turn."""
    import datetime as dt

    r = np.random.default_rng(5)
    rows = []
    for a in ("x", "z"):
        for k in range(50):
            y, fold = int(r.integers(-1, 2)), k // 10
            shown = -y if fold > flip_after else y
            for model, noise in (("good", 0.1), ("bad", 0.8)):
                p = r.dirichlet(np.ones(3)) * noise + np.eye(3)[y + 1] * (1 - noise)
                rows.append((a, model, fold, dt.date(2000, 1, 3) + dt.timedelta(days=k), shown, p.tolist(), int(p.argmax()) - 1))
    return spark.createDataFrame(rows, "asset STRING, model STRING, fold INT, date DATE, y INT, probs ARRAY<DOUBLE>, pred INT")


def test_views_know_nothing_of_their_own_or_later_folds(spark):
    plain = {(r["asset"], r["date"]): r for r in L.views_as_of(class_rows(spark)).collect()}
    turned = {(r["asset"], r["date"]): r for r in L.views_as_of(class_rows(spark, flip_after=2)).collect()}
    assert len(plain) == len(turned) == 100
    for key, r in plain.items():
        same = [r[c] == turned[key][c] for c in ("signal", "confidence", "pred", "probs")]
        assert all(same) or r["fold"] > 3  # fold 3 has turned labels, but only fold 4 may know them
    assert all(r["signal"] == 0 and r["confidence"] == 0.30 for r in plain.values() if r["fold"] == 0)
    assert any(plain[k]["confidence"] != turned[k]["confidence"] for k, r in plain.items() if r["fold"] == 4)


def test_weights_as_of_the_end_are_those_of_all_folds(spark):
    rows = class_rows(spark)
    whole = {(r["asset"], r["model"]): r["weight"] for r in L.model_weights(rows).collect()}
    last = {(r["asset"], r["model"]): r["weight"] for r in L.weights_as_of(rows, 5).filter("fold = 5").collect()}
    assert last == pytest.approx(whole)
    early = L.weights_as_of(rows, 5).filter("fold = 2 AND asset = 'x' AND model = 'good'").first()["weight"]
    assert early == pytest.approx(L.model_weights(rows.filter("fold < 2 AND asset = 'x' AND model = 'good'")).first()["weight"])


def test_newest_view_up_to_a_day(spark):
    days = spark.sql("SELECT a AS asset, date'2000-01-01' + INTERVAL 1 DAY * d AS date FROM (SELECT explode(array('x', 'z')) AS a), (SELECT explode(sequence(0, 5)) AS d)").selectExpr("asset", "cast(date AS date) date")
    views = spark.createDataFrame([("x", "2000-01-02", 1), ("x", "2000-01-04", 2)], "asset STRING, d STRING, v INT").selectExpr("asset", "to_date(d) AS date", "v")
    got = {(r["asset"], r["date"].day): (r["v"], r["view_date"] and r["view_date"].day) for r in L.newest_before(days, views, ["v"]).collect()}
    assert got == {
        **{("x", d): (None, None) if d < 2 else (1, 2) if d < 4 else (2, 4) for d in range(1, 7)},
        **{("z", d): (None, None) for d in range(1, 7)},
    }


def test_forecasts_use_targets_known_by_then(spark):
    """A target may count only ``horizon`` rows after its own day."""
    import datetime as dt

    day = lambda k: dt.date(2000, 1, 3) + dt.timedelta(days=k)
    y = [0.01 * k for k in range(40)]
    rows = spark.createDataFrame([("x", day(k), v) for k, v in enumerate(y)], "asset STRING, date DATE, y DOUBLE")
    cells = [("x", "m", k // 10 - 1, day(k), k, 40, (k // 10 + 1) * 10, y[k], 0.0, 0.5) for k in range(10, 40)]
    preds = spark.createDataFrame(cells, "asset STRING, model STRING, fold INT, date DATE, pos INT, n INT, test_end INT, y DOUBLE, train_mean DOUBLE, pred DOUBLE")
    got = {r["date"]: r for r in L.forecast_as_of(rows, preds, 3, horizon=5).collect()}
    assert len(got) == 30
    early = got[day(12)]  # fold 0: the mean of targets 0 to 7
    assert early["method"] == "recent_mean" and early["expected_daily"] == pytest.approx(np.mean(y[:8]) / 5)
    assert got[day(35)]["method"] == "ensemble"
    none = L.forecast_as_of(rows, preds.filter("fold < 0"), 3, horizon=5)
    assert none.count() == 0


def test_report_values_are_long_rows(spark):
    from tidepanel.plans.completion import section_values

    df = spark.createDataFrame([("b", True, 1, 0.5, [1]), (None, False, 2, None, [2])], "book STRING, ok BOOLEAN, n INT, x DOUBLE, more ARRAY<INT>")
    got = {(r["row"], r["column"], r["value"]) for r in section_values("s", df).collect()}
    assert got == {("b|true", "n", 1.0), ("b|true", "x", 0.5), ("false", "n", 2.0), ("false", "x", None)}
    assert section_values("s", df.select("book")).select("column").first()["column"] == "present"
