"""Registered learning queries.

The SQL twins use models that SQL can fit exactly: one-feature ridge regressions, and
two fixed score rules standing in for classifiers. MLlib models run through the same
folds and scores and are registered without a twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.expr import rnd
from tidepanel.operators import features as X
from tidepanel.operators import learning as L
from tidepanel.plans.registry import W, d, query, r
from tidepanel.plans.statistics import rounded
from tidepanel.plans.windows import FEATURES_CTE
from tidepanel.session import stage
from tidepanel.sources import panels as P

_FWD = f"({W} ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING)"
SINGLES = ("ret_lag1", "dist_to_ma5", "rsi")


def base_sql(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p.strip() for p in (FEATURES_CTE, *parts)) + "\n"


REG_ROWS = f"""
rr0 AS (SELECT asset, date, ret_lag1, dist_to_ma5, rsi, CASE WHEN count(ret) OVER {_FWD} = 63 THEN product(1 + ret) OVER {_FWD} - 1 END AS y FROM feats),
rr AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS n FROM rr0 WHERE y IS NOT NULL)"""


def folds_sql(src: str, k: int, min_train: int, min_size: int, min_rows: int, min_test: int) -> str:
    size = f"greatest({min_size}, (n - {min_train}) // {k})"
    return f"""
fo0 AS (SELECT *, {min_train} + fold * {size} AS train_end, least(n, {min_train} + fold * {size} + {size}) AS test_end FROM {src}, range(0, {k}) t(fold) WHERE n >= {min_rows}),
fo AS (SELECT *, CASE WHEN pos < train_end THEN 'train' ELSE 'test' END AS role FROM fo0 WHERE test_end - train_end >= {min_test} AND pos < test_end)"""


REG_FOLDS = folds_sql("rr", 4, 60, 15, 90, 1)
CLS_ROWS = f"""
ca AS (SELECT asset, date, ret, ret_lag1, rsi, label, lead(ret) OVER ({W}) AS nxt FROM feats),
cb AS (SELECT asset, quantile_cont(nxt, 0.33) AS lo, quantile_cont(nxt, 0.67) AS hi FROM ca GROUP BY asset),
cc AS (SELECT ca.*, CASE WHEN nxt >= hi THEN 1 WHEN nxt <= lo THEN -1 ELSE 0 END AS tri FROM ca JOIN cb USING (asset)),
ck AS (SELECT asset, count(DISTINCT tri) AS k FROM cc GROUP BY asset),
rr AS (SELECT cc.asset, date, ret_lag1, rsi, CASE WHEN k >= 3 THEN tri ELSE label END AS y, row_number() OVER (PARTITION BY cc.asset ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY cc.asset) AS n FROM cc JOIN ck ON ck.asset = cc.asset)"""
CLS_FOLDS = folds_sql("rr", 5, 120, 30, 150, 30)
FOLD_TABLE = "SELECT asset, CAST(fold AS INTEGER) AS fold, CAST(train_end AS INTEGER) AS train_end, CAST(test_end AS INTEGER) AS test_end, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test FROM fo GROUP BY 1, 2, 3, 4"


def fold_table(x):
    n = lambda role: F.sum((F.col("role") == role).cast("long"))
    return x.groupBy("asset", "fold", "train_end", "test_end").agg(n("train").alias("n_train"), n("test").alias("n_test"))


def features(spark, sf):
    return X.technical_features(P.daily_prices(spark, sf))


def regression_rows(spark, sf):
    return L.regression_rows(features(spark, sf), SINGLES)


def forecast_inputs(spark, sf):
    """Rows and model skill, with the rows staged because both sides read them."""
    rows = stage(regression_rows(spark, sf), "regression-rows")
    return rows, L.model_skill(L.fold_skill(single_ridges(spark, sf, rows)))


@query("ml_01_regression_folds", base_sql(REG_ROWS, REG_FOLDS) + FOLD_TABLE)
def ml_01(spark, sf):
    return fold_table(L.regression_folds(regression_rows(spark, sf)))


@query("ml_02_classification_folds", base_sql(CLS_ROWS, CLS_FOLDS) + FOLD_TABLE)
def ml_02(spark, sf):
    return fold_table(L.classification_folds(L.classification_rows(features(spark, sf))))


CAL_FOLDS = """
cd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM rr)),
cf AS (SELECT *, 60 + fold * greatest(15, (n - 60) // 4) AS train_end FROM cd, range(0, 4) t(fold) WHERE n >= 90),
ce AS (SELECT date, fold, pos < train_end AS train FROM cf WHERE least(n, train_end + greatest(15, (n - 60) // 4)) - train_end >= 1 AND pos < least(n, train_end + greatest(15, (n - 60) // 4)))"""


@query(
    "ml_fold_leakage",
    base_sql(REG_ROWS, CAL_FOLDS)
    + f"SELECT CAST(fold AS INTEGER) AS fold, {d('max(date) FILTER (train)')} AS train_end, {d('min(date) FILTER (NOT train)')} AS test_start, max(date) FILTER (train) >= min(date) FILTER (NOT train) AS overlap FROM ce GROUP BY fold",
)
def ml_fold_leakage(spark, sf):
    return L.fold_leakage(L.calendar_folds(regression_rows(spark, sf), 4, 60, 15, 90, 1))


def _single_sql(f: str) -> str:
    return f"""
q_{f} AS (SELECT asset, fold, quantile_cont({f}, 0.01) AS lo, quantile_cont({f}, 0.99) AS hi FROM fo WHERE role = 'train' GROUP BY 1, 2),
c_{f} AS (SELECT fo.*, least(greatest({f}, lo), hi) AS x FROM fo JOIN q_{f} q ON q.asset = fo.asset AND q.fold = fo.fold),
s_{f} AS (SELECT asset, fold, avg(x) AS m, stddev_pop(x) AS s FROM c_{f} WHERE role = 'train' GROUP BY 1, 2),
z_{f} AS (SELECT c.*, (x - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS z FROM c_{f} c JOIN s_{f} s ON s.asset = c.asset AND s.fold = c.fold),
b_{f} AS (SELECT asset, fold, avg(y) AS ym, sum(z * y) / (sum(z * z) + 1.0) AS b FROM z_{f} WHERE role = 'train' GROUP BY 1, 2),
p_{f} AS (SELECT 'ridge_{f}' AS model, z.asset, z.fold, date, pos, n, test_end, y, ym AS train_mean, ym + b * z AS pred FROM z_{f} z JOIN b_{f} b ON b.asset = z.asset AND b.fold = z.fold WHERE role = 'test')"""


PREDS = ",".join(_single_sql(f) for f in SINGLES) + ", preds AS (" + " UNION ALL ".join(f"SELECT * FROM p_{f}" for f in SINGLES) + ")"


def single_ridges(spark, sf, rows=None):
    """One-feature ridge models on a shared, once prepared set of folds."""
    rows = regression_rows(spark, sf) if rows is None else rows
    prepared = L.standardise(L.regression_folds(rows), SINGLES)
    prepared = stage(prepared, "regression-folds")
    out = None
    for f in SINGLES:
        one = L.ridge(prepared, [f], name=f"ridge_{f}")
        out = one if out is None else out.unionByName(one)
    return out


@query("ml_03_ridge_single_feature", base_sql(REG_ROWS, REG_FOLDS, PREDS) + f"SELECT model, asset, CAST(fold AS INTEGER) AS fold, {d()} AS date, {r('pred', 5)} AS pred FROM preds")
def ml_03(spark, sf):
    return single_ridges(spark, sf).select("model", "asset", "fold", "date", rnd("pred", 5).alias("pred"))


SKILL = f"""
ym AS (SELECT model, asset, fold, avg(y) AS m FROM preds GROUP BY 1, 2, 3),
fk AS (SELECT p.model, p.asset, p.fold, greatest(-1, least(1, 1 - sum(pow(y - pred, 2)) / (sum(pow(y - m, 2)) + 1e-12))) AS r2, avg(abs(y - pred)) AS mae, avg(abs(y - train_mean)) AS base, avg(CASE WHEN sign(pred) = sign(y) THEN 1.0 ELSE 0.0 END) AS dir,
  arg_max(pred, pos) AS last_pred, max(CASE WHEN test_end = n THEN 1 ELSE 0 END) AS fin FROM preds p JOIN ym ON ym.model = p.model AND ym.asset = p.asset AND ym.fold = p.fold GROUP BY 1, 2, 3),
sk AS (SELECT model, asset, median(r2) AS r2, median(mae) AS mae, median(base) AS base, median(dir) AS dir, count(*) AS fold_count, arg_max(last_pred, fold) FILTER (fold = 3 OR fin = 1) AS latest FROM fk GROUP BY 1, 2),
ski AS (SELECT *, 1 - mae / (base + 1e-12) AS ms, 0.45 * r2 + 0.35 * (1 - mae / (base + 1e-12)) + 0.20 * 2 * (dir - 0.5) AS comp FROM sk)"""


@query(
    "ag_30_fold_skill",
    base_sql(REG_ROWS, REG_FOLDS, PREDS, SKILL)
    + f"SELECT asset, model, fold_count, {r('r2', 5)} AS median_r2, {r('mae', 5)} AS median_mae, {r('base', 5)} AS median_baseline_mae, {r('dir', 5)} AS median_directional, {r('comp', 5)} AS composite, {r('latest', 5)} AS latest_prediction FROM ski",
)
def ag_30(spark, sf):
    return L.score_table(single_ridges(spark, sf))


@query(
    "ag_31_best_model",
    base_sql(REG_ROWS, REG_FOLDS, PREDS, SKILL, "bm AS (SELECT asset, model, row_number() OVER (PARTITION BY asset ORDER BY comp DESC, model DESC) AS rk FROM ski)")
    + "SELECT asset, model AS best_model, count(*) OVER (PARTITION BY model) AS wins, (SELECT model FROM bm WHERE rk = 1 GROUP BY model ORDER BY count(*) DESC, model DESC LIMIT 1) AS overall_winner FROM bm WHERE rk = 1",
)
def ag_31(spark, sf):
    return L.best_models(L.model_skill(L.fold_skill(single_ridges(spark, sf))))


FORECAST = f"""
tb AS (SELECT asset, y, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS b FROM rr),
an AS (SELECT asset, count(*) AS n, avg(y) FILTER (b <= 30) AS rm, median(y) FILTER (b <= 90) AS anchor FROM tb GROUP BY asset),
ms AS (SELECT asset, median(latest) AS pr, max(comp) AS best, median(r2) AS r2, median(dir) AS dir, median(ms) AS ms FROM ski GROUP BY asset),
fj AS (SELECT an.asset, n, rm, anchor, pr, greatest(0.15, least(0.95, 0.5 + 0.45 * greatest(-1, least(1, best)))) AS sh, greatest(0.05, least(0.95, 0.12 + 0.32 * r2 + 0.28 * ms + 0.28 * (dir - 0.5))) AS cf FROM an LEFT JOIN ms ON ms.asset = an.asset)"""


@query("ml_12_median_prediction", base_sql(REG_ROWS, REG_FOLDS, PREDS, SKILL) + f"SELECT asset, {r('median(latest)', 5)} AS predicted FROM ski GROUP BY asset")
def ml_12(spark, sf):
    s = L.model_skill(L.fold_skill(single_ridges(spark, sf)))
    return s.groupBy("asset").agg(rnd(F.median("latest_prediction"), 5).alias("predicted"))


@query(
    "scl_16_forecast_shrink",
    base_sql(REG_ROWS, REG_FOLDS, PREDS, SKILL, FORECAST)
    + f"SELECT asset, n, {r('CASE WHEN n < 80 OR pr IS NULL THEN rm ELSE sh * pr + (1 - sh) * anchor END / 63', 7)} AS expected_daily, {r('CASE WHEN n < 80 OR pr IS NULL THEN 0.2 ELSE cf END', 5)} AS confidence, CASE WHEN n < 80 OR pr IS NULL THEN 'recent_mean' ELSE 'ensemble' END AS method FROM fj",
)
def scl_16(spark, sf):
    f = L.forecast(*forecast_inputs(spark, sf))
    return f.select("asset", "n", rnd("expected_daily", 7).alias("expected_daily"), rnd("confidence", 5).alias("confidence"), "method")


@query(
    "ml_11_fallback_forecast",
    base_sql(REG_ROWS, "tb AS (SELECT asset, y, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS b FROM rr)")
    + f"SELECT asset, count(*) AS n, {r('avg(y) FILTER (b <= 30) / 63', 7)} AS expected_daily, CAST(0.2 AS DOUBLE) AS confidence FROM tb GROUP BY asset",
)
def ml_11(spark, sf):
    rows, skill = forecast_inputs(spark, sf)
    return L.forecast(rows, skill.filter("false")).select("asset", "n", rnd("expected_daily", 7).alias("expected_daily"), "confidence")


# --- classification with fixed score rules ----------------------------------


def rule_predictions(spark, sf):
    """Two score rules with class probabilities on the test rows of every fold."""
    rows = L.classification_folds(L.classification_rows(features(spark, sf), ("ret_lag1", "rsi"))).filter("role = 'test'")
    score = F.explode(
        F.array(
            F.struct(F.lit("lag").alias("model"), (F.col("ret_lag1") * 100).alias("s")),
            F.struct(F.lit("rsi").alias("model"), ((F.col("rsi") - 50) / 25).alias("s")),
        )
    )
    x = rows.select("asset", "date", "fold", "y", score.alias("m")).select("asset", "date", "fold", "y", "m.model", "m.s")
    t = F.exp(-F.col("s")) + 1.02 + F.exp("s")
    x = x.withColumn("probs", F.array(F.exp(-F.col("s")) / t, 1.02 / t, F.exp("s") / t))
    return x.withColumn("pred", L.argmax_class("probs")).drop("s")


RULES = """
ru0 AS (SELECT asset, date, fold, y, unnest(['lag', 'rsi']) AS model, unnest([ret_lag1 * 100, (rsi - 50) / 25]) AS s FROM fo WHERE role = 'test'),
ru1 AS (SELECT *, exp(-s) + 1.02 + exp(s) AS t FROM ru0),
ru AS (SELECT asset, date, fold, y, model, exp(-s) / t AS p0, 1.02 / t AS p1, exp(s) / t AS p2, CASE WHEN exp(-s) >= 1.02 AND exp(-s) >= exp(s) THEN -1 WHEN 1.02 >= exp(s) THEN 0 ELSE 1 END AS pred FROM ru1)"""


def scores_sql(src: str, keys: str, name: str) -> str:
    return f"""
{name}_l AS (SELECT {keys}, y AS label, 1 AS su, 0 AS pr, CASE WHEN y = pred THEN 1 ELSE 0 END AS tp FROM {src} UNION ALL SELECT {keys}, pred, 0, 1, 0 FROM {src}),
{name}_c AS (SELECT {keys}, label, sum(su) AS support, sum(pr) AS predicted, sum(tp) AS tp FROM {name}_l GROUP BY ALL),
{name}_k AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / CAST(predicted AS DOUBLE) END AS pc, CASE WHEN support = 0 THEN 0.0 ELSE tp / CAST(support AS DOUBLE) END AS rc, CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / CAST(support + predicted AS DOUBLE) END AS f1 FROM {name}_c),
{name} AS (SELECT {keys}, CAST(sum(support) AS BIGINT) AS n, sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy, sum(pc * support) / CAST(sum(support) AS DOUBLE) AS pw, sum(rc * support) / CAST(sum(support) AS DOUBLE) AS rw, sum(f1 * support) / CAST(sum(support) AS DOUBLE) AS fw FROM {name}_k GROUP BY ALL)"""


RULE_BASE = (CLS_ROWS, CLS_FOLDS, RULES)


@query("ag_28_confusion_matrix", base_sql(*RULE_BASE) + "SELECT asset, model, y, pred, count(*) AS n FROM ru GROUP BY ALL")
def ag_28(spark, sf):
    return L.confusion(rule_predictions(spark, sf), ["asset", "model"])


@query("ag_28b_class_scores", base_sql(*RULE_BASE, scores_sql("ru", "asset, model", "ws")) + f"SELECT asset, model, label, CAST(support AS BIGINT) AS support, {r('pc', 5)} AS precision, {r('rc', 5)} AS recall, {r('f1', 5)} AS f1 FROM ws_k")
def ag_28b(spark, sf):
    return rounded(L.class_scores(rule_predictions(spark, sf), ["asset", "model"]), "precision", "recall", "f1", digits=5, keep=("asset", "model", "label", "support"))


@query("ag_28c_weighted_scores", base_sql(*RULE_BASE, scores_sql("ru", "asset, model", "ws")) + f"SELECT asset, model, n, {r('accuracy', 5)} AS accuracy, {r('pw', 5)} AS precision_weighted, {r('rw', 5)} AS recall_weighted, {r('fw', 5)} AS f1_weighted FROM ws")
def ag_28c(spark, sf):
    s = L.weighted_scores(rule_predictions(spark, sf), ["asset", "model"])
    return rounded(s, "accuracy", "precision_weighted", "recall_weighted", "f1_weighted", digits=5, keep=("asset", "model", "n"))


@query("ag_29_calibration_error", base_sql(*RULE_BASE) + f"SELECT asset, model, {r('avg(abs(greatest(p0, p1, p2) - CASE WHEN y = pred THEN 1.0 ELSE 0.0 END))')} AS calibration_error FROM ru GROUP BY ALL")
def ag_29(spark, sf):
    return rounded(L.calibration_error(rule_predictions(spark, sf), ["asset", "model"]), "calibration_error", keep=("asset", "model"))


ENSEMBLE = (
    scores_sql("ru", "asset, model", "wo")
    + ","
    + scores_sql("ru", "asset, model, fold", "wf")
    + """,
mw0 AS (SELECT wo.asset, wo.model, wo.fw AS f1, CASE WHEN count(*) >= 2 THEN stddev_pop(wf.fw) ELSE 0.0 END AS sd FROM wo JOIN wf ON wf.asset = wo.asset AND wf.model = wo.model GROUP BY 1, 2, 3),
mw AS (SELECT *, greatest(0.05, f1 * greatest(0.45, least(1.0, 1 - 2 * sd))) AS weight FROM mw0),
ms AS (SELECT asset, model, weight / (sum(weight) OVER (PARTITION BY asset) + 1e-12) AS share FROM mw),
en0 AS (SELECT ru.asset, date, fold, any_value(y) AS y, count(DISTINCT pred) AS votes, sum(p0 * share) AS p0, sum(p1 * share) AS p1, sum(p2 * share) AS p2 FROM ru JOIN ms ON ms.asset = ru.asset AND ms.model = ru.model GROUP BY 1, 2, 3),
en AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN -1 WHEN p1 >= p2 THEN 0 ELSE 1 END AS pred FROM en0)"""
)


@query("ml_09_skill_weighted_ensemble", base_sql(*RULE_BASE, ENSEMBLE) + f"SELECT asset, {d()} AS date, CAST(fold AS INTEGER) AS fold, y, pred, {r('p0', 5)} AS p_down, {r('p1', 5)} AS p_flat, {r('p2', 5)} AS p_up FROM en")
def ml_09(spark, sf):
    x = stage(rule_predictions(spark, sf), "rule-predictions")
    e = L.ensemble(x, L.model_weights(x))
    return e.select("asset", "date", "fold", "y", "pred", *[rnd(F.col("probs")[i], 5).alias(n) for i, n in enumerate(("p_down", "p_flat", "p_up"))])


CONF = (
    scores_sql("en", "asset", "we")
    + """,
cal AS (SELECT asset, avg(abs(greatest(p0, p1, p2) - CASE WHEN y = pred THEN 1.0 ELSE 0.0 END)) AS ce FROM en GROUP BY asset),
lv AS (SELECT asset, arg_max(greatest(p0, p1, p2), date) AS mp, arg_max(pred, date) AS sg, arg_max(votes, date) > 1 AS dis FROM en GROUP BY asset),
mf AS (SELECT asset, avg(f1) AS mf, max(sd) AS sd FROM mw GROUP BY asset),
cq AS (SELECT lv.asset, sg, we.fw, greatest(0.05, least(0.95, mf * mp)) * CASE WHEN sd > 0.10 THEN greatest(0.55, least(1.0, 1.2 - 2.2 * sd)) ELSE 1.0 END * CASE WHEN ce > 0.28 THEN 0.84 ELSE 1.0 END * CASE WHEN dis THEN 0.87 ELSE 1.0 END AS c
  FROM lv JOIN we ON we.asset = lv.asset JOIN cal ON cal.asset = lv.asset JOIN mf ON mf.asset = lv.asset)"""
)


@query(
    "scl_17_classifier_confidence",
    base_sql(*RULE_BASE, ENSEMBLE, CONF)
    + f"SELECT asset, CASE WHEN fw < 0.42 THEN 0 ELSE sg END AS signal, {r('CASE WHEN fw < 0.42 THEN least(greatest(0.05, least(0.95, c)), 0.35) ELSE greatest(0.05, least(0.95, c)) END', 5)} AS confidence FROM cq",
)
def scl_17(spark, sf):
    x = stage(rule_predictions(spark, sf), "rule-predictions")
    weights = L.model_weights(x)
    e = stage(L.ensemble(x, weights), "ensemble")
    live = e.groupBy("asset").agg(F.max_by(F.struct(F.array_max("probs").alias("max_prob"), F.col("pred").alias("raw_signal"), (F.col("votes") > 1).alias("disagreement")), "date").alias("s")).select("asset", "s.*")
    skill = weights.groupBy("asset").agg(F.avg("f1").alias("mean_f1"), F.max("fold_std").alias("fold_std"))
    j = live.join(skill, "asset").join(L.calibration_error(e, ["asset"]), "asset")
    j = j.join(L.weighted_scores(e, ["asset"]).select("asset", F.col("f1_weighted").alias("ensemble_f1")), "asset")
    return L.classifier_confidence(j).select("asset", "signal", rnd("confidence", 5).alias("confidence"))


# Models as of a date: weights and trust by earlier folds alone.
AS_OF = (
    "rk AS (SELECT ru.*, k FROM ru JOIN range(1, 6) t(k) ON fold < k),"
    + scores_sql("rk", "asset, model, k", "xo")
    + ","
    + scores_sql("ru", "asset, model, fold", "wf")
    + """,
mw0 AS (SELECT xo.asset, xo.model, xo.k, xo.fw AS f1, CASE WHEN count(*) >= 2 THEN stddev_pop(wf.fw) ELSE 0.0 END AS sd FROM xo JOIN wf ON wf.asset = xo.asset AND wf.model = xo.model AND wf.fold < xo.k GROUP BY 1, 2, 3, 4),
mw AS (SELECT *, greatest(0.05, f1 * greatest(0.45, least(1.0, 1 - 2 * sd))) AS weight FROM mw0),
ej AS (SELECT ru.*, coalesce(weight, 0.05) AS wt FROM ru LEFT JOIN mw ON mw.asset = ru.asset AND mw.model = ru.model AND mw.k = ru.fold),
en0 AS (SELECT asset, date, fold, any_value(y) AS y, count(DISTINCT pred) AS votes, sum(p0 * wt) / (sum(wt) + 1e-12) AS p0, sum(p1 * wt) / (sum(wt) + 1e-12) AS p1, sum(p2 * wt) / (sum(wt) + 1e-12) AS p2 FROM ej GROUP BY 1, 2, 3),
en AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN -1 WHEN p1 >= p2 THEN 0 ELSE 1 END AS pred FROM en0),
ek AS (SELECT en.*, k FROM en JOIN range(1, 6) t(k) ON fold < k),"""
    + scores_sql("ek", "asset, k", "we")
    + """,
cal AS (SELECT asset, k, avg(abs(greatest(p0, p1, p2) - CASE WHEN y = pred THEN 1.0 ELSE 0.0 END)) AS ce FROM ek GROUP BY 1, 2),
mf AS (SELECT asset, k, avg(f1) AS mf, max(sd) AS sd FROM mw GROUP BY 1, 2),
vw AS (SELECT en.*, mf, fw, greatest(0.05, least(0.95, mf * greatest(p0, p1, p2))) * CASE WHEN sd > 0.10 THEN greatest(0.55, least(1.0, 1.2 - 2.2 * sd)) ELSE 1.0 END * CASE WHEN ce > 0.28 THEN 0.84 ELSE 1.0 END * CASE WHEN votes > 1 THEN 0.87 ELSE 1.0 END AS c
  FROM en LEFT JOIN mf ON mf.asset = en.asset AND mf.k = en.fold LEFT JOIN we ON we.asset = en.asset AND we.k = en.fold LEFT JOIN cal ON cal.asset = en.asset AND cal.k = en.fold)"""
)


@query(
    "ml_09b_views_as_of",
    base_sql(*RULE_BASE, AS_OF)
    + f"""SELECT asset, {d()} AS date, CAST(fold AS INTEGER) AS fold, pred, {r('p0', 5)} AS p_down, {r('p2', 5)} AS p_up,
 CASE WHEN mf IS NULL OR fw < 0.42 THEN 0 ELSE pred END AS signal, {r('CASE WHEN mf IS NULL THEN 0.30 WHEN fw < 0.42 THEN least(greatest(0.05, least(0.95, c)), 0.35) ELSE greatest(0.05, least(0.95, c)) END', 5)} AS confidence FROM vw""",
)
def ml_09b(spark, sf):
    """What the classifiers said on each date, by what was known of them on that date."""
    v = L.views_as_of(stage(rule_predictions(spark, sf), "rule-predictions"))
    return v.select(
        "asset", "date", "fold", "pred", rnd(F.col("probs")[0], 5).alias("p_down"), rnd(F.col("probs")[2], 5).alias("p_up"), "signal", rnd("confidence", 5).alias("confidence")
    )


FORECAST_AS_OF = """
sa AS (SELECT model, asset, k, median(r2) AS r2, median(mae) AS mae, median(base) AS base, median(dir) AS dir FROM fk JOIN range(1, 5) t(k) ON fold < k GROUP BY 1, 2, 3),
sb AS (SELECT *, 1 - mae / (base + 1e-12) AS ms, 0.45 * r2 + 0.35 * (1 - mae / (base + 1e-12)) + 0.20 * 2 * (dir - 0.5) AS comp FROM sa),
sc AS (SELECT asset, k, max(comp) AS best, median(r2) AS r2, median(dir) AS dir, median(ms) AS ms FROM sb GROUP BY 1, 2),
mp AS (SELECT asset, date, fold, median(pred) AS pr FROM preds GROUP BY 1, 2, 3),
kn AS (SELECT asset, date, avg(y) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 92 PRECEDING AND 63 PRECEDING) AS rm, median(y) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 152 PRECEDING AND 63 PRECEDING) AS anchor FROM rr),
fa AS (SELECT mp.asset, mp.date, fold, pr, rm, anchor, best IS NULL OR anchor IS NULL AS thin, greatest(0.15, least(0.95, 0.5 + 0.45 * greatest(-1, least(1, best)))) AS sh, greatest(0.05, least(0.95, 0.12 + 0.32 * r2 + 0.28 * ms + 0.28 * (dir - 0.5))) AS cf
  FROM mp JOIN kn ON kn.asset = mp.asset AND kn.date = mp.date LEFT JOIN sc ON sc.asset = mp.asset AND sc.k = mp.fold)"""


@query(
    "scl_16b_forecast_as_of",
    base_sql(REG_ROWS, REG_FOLDS, PREDS, SKILL, FORECAST_AS_OF)
    + f"SELECT asset, {d()} AS date, CAST(fold AS INTEGER) AS fold, {r('CASE WHEN thin THEN rm ELSE sh * pr + (1 - sh) * anchor END / 63', 7)} AS expected_daily, {r('CASE WHEN thin THEN 0.2 ELSE cf END', 5)} AS confidence, CASE WHEN thin THEN 'recent_mean' ELSE 'ensemble' END AS method FROM fa",
)
def scl_16b(spark, sf):
    rows = stage(regression_rows(spark, sf), "regression-rows")
    f = L.forecast_as_of(rows, stage(single_ridges(spark, sf, rows), "single-ridges"))
    return f.select("asset", "date", "fold", rnd("expected_daily", 7).alias("expected_daily"), rnd("confidence", 5).alias("confidence"), "method")


@query(
    "ml_13_point_in_time",
    base_sql(CLS_ROWS, CLS_FOLDS, "fe AS (SELECT asset, fold, max(date) AS e FROM fo WHERE role = 'train' GROUP BY 1, 2)")
    + f"SELECT fo.asset, CAST(fo.fold AS INTEGER) AS fold, {d('max(e)')} AS fold_end, {d('min(date)')} AS first_use, {d('max(date)')} AS last_use, CAST(sum(CASE WHEN e >= date THEN 1 ELSE 0 END) AS BIGINT) AS leaks, CAST(date_diff('day', max(e), min(date)) AS INTEGER) AS gap_days FROM fo JOIN fe ON fe.asset = fo.asset AND fe.fold = fo.fold WHERE role = 'test' GROUP BY 1, 2",
)
def ml_13(spark, sf):
    return L.point_in_time(L.classification_folds(L.classification_rows(features(spark, sf))))


@query(
    "ml_10_gates",
    base_sql(CLS_ROWS, """gh AS (SELECT asset, y, count(*) AS c FROM rr WHERE pos < n - 1 GROUP BY 1, 2),
gn AS (SELECT asset, CAST(sum(c) AS BIGINT) AS n_hist, min(c) AS min_class FROM gh GROUP BY asset),
gr AS (SELECT *, greatest(12, CAST(floor(0.02 * n_hist) AS BIGINT)) AS min_required FROM gn)""")
    + "SELECT asset, n_hist, min_class, min_required, CASE WHEN n_hist + 1 < 180 OR n_hist < 150 THEN 'insufficient_history' WHEN min_class < min_required THEN 'class_imbalance' ELSE 'ok' END AS status FROM gr",
)
def ml_10(spark, sf):
    return L.gates(L.classification_rows(features(spark, sf))).select("asset", "n_hist", "min_class", "min_required", "status")


# --- MLlib and multi-feature models (no SQL twin) ----------------------------


def _regression(spark, sf):
    return stage(L.pooled_regression(P.daily_prices(spark, sf)), "regression-folds")


def _classification(spark, sf):
    return stage(L.pooled_classification(P.daily_prices(spark, sf)), "classification-folds")


@query("ml_03b_ridge_all_features")
def ml_03b(spark, sf):
    return L.score_table(L.ridge(stage(L.prepared_regression(P.daily_prices(spark, sf)), "regression-folds")))


@query("ml_04_random_forest")
def ml_04(spark, sf):
    return L.score_table(L.fit_folds(_regression(spark, sf), L.FEATURES, L.random_forest, "random_forest"))


@query("ml_05_kernel_regression")
def ml_05(spark, sf):
    x, cols = L.fourier_features(_regression(spark, sf))
    return L.score_table(L.fit_folds(x, cols, L.robust_linear, "kernel_regression"))


def _classifier_scores(pred):
    s = L.weighted_scores(pred, ["asset", "model"])
    return rounded(s, "accuracy", "precision_weighted", "recall_weighted", "f1_weighted", digits=5, keep=("asset", "model", "n"))


@query("ml_06_balanced_logistic")
def ml_06(spark, sf):
    return _classifier_scores(L.fit_folds(_classification(spark, sf), L.FEATURES, L.balanced_logistic, "logistic", classifier=True))


@query("ml_07_kernel_classifier")
def ml_07(spark, sf):
    x, cols = L.fourier_features(_classification(spark, sf))
    return _classifier_scores(L.fit_folds(x, cols, L.balanced_logistic, "kernel_classifier", classifier=True))


@query("ml_08_boosted_trees")
def ml_08(spark, sf):
    return _classifier_scores(L.fit_folds(_classification(spark, sf), L.FEATURES, L.boosted_trees, "boosted_trees", classifier=True))
