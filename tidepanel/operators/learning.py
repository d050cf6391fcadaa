"""Walk-forward learning jobs over all assets at once.

Folds are rows: every feature row fans out into the folds that use it, tagged train or
test, and preparation, closed-form fits and scores are grouped by (asset, fold). A
group holds at most one row per trading day. MLlib models are fitted once per fold on
the rows of all assets, with the asset as a feature, so the number of fits does not
grow with the universe.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.expr import clip, rnd, series, whole
from tidepanel.operators.features import forward_return, technical_features, ternary_label
from tidepanel.session import stage

FEATURES = ("ret_lag1", "ret_lag2", "dist_to_ma5", "macd_hist", "rsi", "bb_pb")
HORIZON = 63


def regression_rows(features: DataFrame, cols: Sequence[str] = FEATURES, horizon: int = HORIZON) -> DataFrame:
    """(asset, date, features..., y): compounded forward return as the target."""
    x = forward_return(features, horizon, "y")
    return x.select("asset", "date", *cols, "y").dropna()


def classification_rows(features: DataFrame, cols: Sequence[str] = FEATURES, train_share: float | None = None) -> DataFrame:
    """(asset, date, features..., y): ternary next-day label. ``train_share`` learns
    the thresholds on the leading share of each series only."""
    fit_on = None
    if train_share is not None:
        n = F.count("*").over(whole())
        features = features.withColumn("__t", F.row_number().over(series()) <= n * train_share)
        fit_on = F.col("__t")
    return ternary_label(features, fit_on=fit_on).select("asset", "date", *cols, F.col("tri_label").alias("y"))


def expanding_folds(rows: DataFrame, n_folds: int, min_train: int, min_size: int, min_rows: int, min_test: int) -> DataFrame:
    """Fan rows out into expanding folds: adds fold, role, train_end, test_end.

    Fold k trains on the first min_train + k*size rows and tests on the next ``size``.
    The fan-out happens on the row itself; no fold table is joined.
    """
    x = rows.withColumns({"pos": F.row_number().over(series()) - 1, "n": F.count("*").over(whole())})
    size = F.greatest(F.lit(min_size), F.floor((F.col("n") - min_train) / n_folds)).cast("int")
    x = x.withColumn("size", size).filter(F.col("n") >= min_rows)
    x = x.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    start = (F.col("fold") * F.col("size") + min_train).cast("int")
    x = x.withColumn("train_end", start).withColumn("test_end", F.least(F.col("n").cast("int"), F.col("train_end") + F.col("size")))
    x = x.filter((F.col("test_end") - F.col("train_end") >= min_test) & (F.col("pos") < F.col("test_end")))
    return x.withColumn("role", F.when(F.col("pos") < F.col("train_end"), "train").otherwise("test")).drop("size")


def calendar_folds(rows: DataFrame, n_folds: int, min_train: int, min_size: int, min_rows: int, min_test: int) -> DataFrame:
    """Expanding folds for models fitted on all assets together: cut by date, on the
    common calendar, so that no asset's training row is later than another's test row.

    Same columns as ``expanding_folds``; pos and n count days of the calendar.
    """
    # one row per calendar day
    order = Window.orderBy("date")
    days = rows.select("date").distinct().select(
        "date", (F.row_number().over(order) - 1).alias("pos"), F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n")
    )
    size = F.greatest(F.lit(min_size), F.floor((F.col("n") - min_train) / n_folds)).cast("int")
    days = days.filter(F.col("n") >= min_rows).withColumn("size", size).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    days = days.withColumn("train_end", (F.col("fold") * F.col("size") + min_train).cast("int"))
    days = days.withColumn("test_end", F.least(F.col("n").cast("int"), F.col("train_end") + F.col("size")))
    days = days.filter((F.col("test_end") - F.col("train_end") >= min_test) & (F.col("pos") < F.col("test_end")))
    days = days.withColumn("role", F.when(F.col("pos") < F.col("train_end"), "train").otherwise("test")).drop("size")
    return rows.join(days, "date")


def fold_leakage(folds: DataFrame) -> DataFrame:
    """Last training day against first test day of every fold, over all assets."""
    edge = lambda f, role: f(F.when(F.col("role") == role, F.col("date")))
    ends = folds.groupBy("fold").agg(edge(F.max, "train").alias("train_end"), edge(F.min, "test").alias("test_start"))
    return ends.withColumn("overlap", F.col("train_end") >= F.col("test_start"))


def pooled(prepared: DataFrame, cols: Sequence[str]) -> DataFrame:
    """An asset without training rows in a fold has no scale of its own there: its
    features count as average."""
    return prepared.withColumns({c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)) for c in cols})


def regression_folds(rows: DataFrame) -> DataFrame:
    return expanding_folds(rows, 4, 60, 15, 90, 1)


def classification_folds(rows: DataFrame) -> DataFrame:
    return expanding_folds(rows, 5, 120, 30, 150, 30)


def standardise(stacked: DataFrame, cols: Sequence[str] = FEATURES, keys: Sequence[str] = ("asset", "fold")) -> DataFrame:
    """Winsorise at the train rows' 1 % / 99 % and scale by the train rows' mean and
    population deviation, per (asset, fold); one shuffle for all features."""
    w = Window.partitionBy(*keys)
    train = F.col("role") == "train"
    q = F.array(F.lit(0.01), F.lit(0.99))
    x = stacked.withColumns({f"__b_{c}": F.percentile(F.when(train, F.col(c)), q).over(w) for c in cols})
    x = x.withColumns({c: F.least(F.greatest(F.col(c), F.col(f"__b_{c}")[0]), F.col(f"__b_{c}")[1]) for c in cols})
    x = x.drop(*[f"__b_{c}" for c in cols])
    x = x.withColumns(
        {f"__m_{c}": F.avg(F.when(train, F.col(c))).over(w) for c in cols}
        | {f"__s_{c}": F.stddev_pop(F.when(train, F.col(c))).over(w) for c in cols}
    )
    z = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in cols}
    return x.withColumns(z).drop(*[f"__{k}_{c}" for c in cols for k in "ms"])


def ridge(prepared: DataFrame, cols: Sequence[str] = FEATURES, alpha: float = 1.0, name: str = "ridge", keys: Sequence[str] = ("asset", "fold")) -> DataFrame:
    """Ridge predictions on the test rows, all groups in one job.

    Normal equations are ordinary sums over the train rows; only the p x p solve of
    each group, a batch of tiny matrices, is numpy.
    """
    p = len(cols)
    train = prepared.filter("role = 'train'")
    pairs = [F.sum(F.col(cols[i]) * F.col(cols[j])) for i in range(p) for j in range(p)]
    eqs = train.groupBy(*keys).agg(
        F.avg("y").alias("y_mean"),
        F.array(*pairs).alias("g"),
        F.array(*[F.sum(F.col(c) * F.col("y")) for c in cols]).alias("b"),
    )

    def solve(batches):
        for batch in batches:
            g = np.array(batch["g"].tolist(), dtype=float).reshape(-1, p, p) + alpha * np.eye(p)
            b = np.array(batch["b"].tolist(), dtype=float).reshape(-1, p, 1)
            beta = np.linalg.solve(g, b)[:, :, 0]
            yield pd.DataFrame({**{k: batch[k] for k in keys}, "y_mean": batch["y_mean"], "beta": list(beta)})

    types = dict(eqs.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", y_mean DOUBLE, beta ARRAY<DOUBLE>"
    coef = eqs.mapInPandas(solve, schema)
    j = prepared.filter("role = 'test'").join(coef, list(keys))
    pred = sum((F.col(c) * F.col("beta")[i] for i, c in enumerate(cols)), F.col("y_mean"))
    return j.select(*keys, "date", "pos", "n", "test_end", "y", F.col("y_mean").alias("train_mean"), F.lit(name).alias("model"), pred.alias("pred"))


def fold_skill(predictions: DataFrame) -> DataFrame:
    """R2 (clipped to +-1), MAE, baseline MAE and sign accuracy per fold."""
    keys = ["asset", "model", "fold"]
    y, p = F.col("y"), F.col("pred")
    w = Window.partitionBy(*keys)
    x = predictions.withColumn("__ym", F.avg("y").over(w))
    s = x.groupBy(*keys).agg(
        (1 - F.sum(F.pow(y - p, F.lit(2.0))) / (F.sum(F.pow(y - F.col("__ym"), F.lit(2.0))) + 1e-12)).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg(F.abs(y - F.col("train_mean"))).alias("baseline_mae"),
        F.avg((F.signum(p) == F.signum(y)).cast("double")).alias("directional"),
        F.max_by("pred", "pos").alias("last_pred"),
        F.max((F.col("test_end") == F.col("n")).cast("int")).alias("reaches_end"),
    )
    return s.withColumn("r2", clip("r2", -1.0, 1.0))


def model_skill(folds: DataFrame, last_fold: int = 3) -> DataFrame:
    """Medians over folds, the composite score and the newest prediction."""
    final = (F.col("fold") == last_fold) | (F.col("reaches_end") == 1)
    m = folds.groupBy("asset", "model").agg(
        F.median("r2").alias("median_r2"),
        F.median("mae").alias("median_mae"),
        F.median("baseline_mae").alias("median_baseline_mae"),
        F.median("directional").alias("median_directional"),
        F.count("*").alias("fold_count"),
        F.max_by(F.when(final, F.col("last_pred")), F.when(final, F.col("fold"))).alias("latest_prediction"),
    )
    mae_skill = 1 - F.col("median_mae") / (F.col("median_baseline_mae") + 1e-12)
    composite = 0.45 * F.col("median_r2") + 0.35 * mae_skill + 0.20 * (2 * (F.col("median_directional") - 0.5))
    return m.withColumns({"mae_skill": mae_skill, "composite": composite})


def best_models(skill: DataFrame) -> DataFrame:
    """Winner per asset, how often it wins over all assets, and the model with most wins."""
    win = skill.groupBy("asset").agg(F.max(F.struct("composite", "model")).alias("s")).select("asset", F.col("s.model").alias("best_model"))
    # One row per model, however many assets there are.
    wins = win.groupBy("best_model").agg(F.count("*").alias("wins"))
    overall = wins.groupBy().agg(F.max_by("best_model", F.struct("wins", "best_model"))).scalar()
    return win.join(F.broadcast(wins), "best_model").withColumn("overall_winner", overall)


def forecast(rows: DataFrame, skill: DataFrame, min_rows: int = 80, horizon: int = HORIZON) -> DataFrame:
    """Daily expected return and confidence per asset.

    The median model prediction is shrunk towards the median of the last 90 targets
    in line with the best model's skill. With fewer than ``min_rows`` rows the mean
    of the last 30 targets is used instead.
    """
    back = F.row_number().over(whole().orderBy(F.col("date").desc()))
    x = rows.withColumn("__b", back)
    base = x.groupBy("asset").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("__b") <= 30, F.col("y"))).alias("recent_mean"),
        F.median(F.when(F.col("__b") <= 90, F.col("y"))).alias("anchor"),
    )
    s = skill.groupBy("asset").agg(
        F.median("latest_prediction").alias("predicted"),
        F.max("composite").alias("best"),
        F.median("median_r2").alias("r2"),
        F.median("median_directional").alias("directional"),
        F.median("mae_skill").alias("mae_skill"),
    )
    j = base.join(s, "asset", "left")
    shrink = clip(0.50 + 0.45 * clip("best", -1.0, 1.0), 0.15, 0.95)
    blended = shrink * F.col("predicted") + (1 - shrink) * F.col("anchor")
    conf = clip(0.12 + 0.32 * F.col("r2") + 0.28 * F.col("mae_skill") + 0.28 * (F.col("directional") - 0.5), 0.05, 0.95)
    thin = (F.col("n") < min_rows) | F.col("predicted").isNull()
    return j.select(
        "asset",
        "n",
        F.when(thin, F.col("recent_mean")).otherwise(blended).alias("__e"),
        F.when(thin, 0.20).otherwise(conf).alias("confidence"),
        F.when(thin, "recent_mean").otherwise("ensemble").alias("method"),
    ).withColumn("expected_daily", F.col("__e") / float(horizon)).drop("__e")


# --- classification ---------------------------------------------------------


def confusion(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, "y", "pred").agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, keys: Sequence[str], counted: str | None = None) -> DataFrame:
    """Precision, recall and F1 per class from one pass over the predictions, or over rows
    that stand for as many of them as ``counted`` says."""
    sides = df.groupBy(*keys, "y", "pred").agg((F.sum(counted) if counted else F.count("*")).alias("c"))
    long = sides.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("y").alias("label"), F.col("c").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y") == F.col("pred"), F.col("c")).otherwise(0).alias("tp")),
                F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("c").alias("predicted"), F.lit(0).cast("long").alias("tp")),
            )
        ),
    )
    s = long.groupBy(*keys, "label").agg(*[F.sum(n).alias(n) for n in ("support", "predicted", "tp")])
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return s.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("predicted")),
            "recall": ratio(F.col("tp"), F.col("support")),
            "f1": ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")),
        }
    )


def weighted_scores(df: DataFrame, keys: Sequence[str], counted: str | None = None) -> DataFrame:
    s = class_scores(df, keys, counted)
    total = F.sum("support")
    mean = lambda c: F.sum(F.col(c) * F.col("support")) / total
    return s.groupBy(*keys).agg(
        total.alias("n"),
        (F.sum("tp") / total).alias("accuracy"),
        mean("precision").alias("precision_weighted"),
        mean("recall").alias("recall_weighted"),
        mean("f1").alias("f1_weighted"),
    )


def calibration_error(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    hit = (F.col("y") == F.col("pred")).cast("double")
    return df.groupBy(*keys).agg(F.avg(F.abs(F.array_max("probs") - hit)).alias("calibration_error"))


CLASSES = (-1, 0, 1)


def argmax_class(probs: Column | str, classes: Sequence[int] = CLASSES) -> Column:
    """Class of the largest probability, the first one on ties."""
    p = F.col(probs) if isinstance(probs, str) else probs
    return F.array(*[F.lit(c) for c in classes])[(F.array_position(p, F.array_max(p)) - 1).cast("int")]


def model_weights(predictions: DataFrame) -> DataFrame:
    """(asset, model, f1, fold_std, weight): out-of-fold F1 damped by its spread."""
    overall = weighted_scores(predictions, ["asset", "model"]).select("asset", "model", F.col("f1_weighted").alias("f1"))
    per = weighted_scores(predictions, ["asset", "model", "fold"])
    spread = per.groupBy("asset", "model").agg(
        F.when(F.count("*") >= 2, F.stddev_pop("f1_weighted")).otherwise(0.0).alias("fold_std")
    )
    j = overall.join(spread, ["asset", "model"])
    return j.withColumn("weight", F.greatest(F.lit(0.05), F.col("f1") * clip(1 - 2 * F.col("fold_std"), 0.45, 1.0)))


def ensemble(predictions: DataFrame, weights: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Skill-weighted class probabilities per (asset, date), matched on the date so
    that models with different folds cannot slip against each other."""
    total = F.sum("weight").over(whole())
    w = weights.withColumn("share", F.col("weight") / (total + 1e-12)).select("asset", "model", "share")
    j = predictions.join(w, ["asset", "model"])
    parts = [F.sum(F.col("probs")[i] * F.col("share")).alias(f"p{i}") for i in range(len(classes))]
    out = j.groupBy("asset", "date", "fold").agg(F.first("y").alias("y"), F.countDistinct("pred").alias("votes"), *parts)
    out = out.withColumn("probs", F.array(*[F.col(f"p{i}") for i in range(len(classes))]))
    return out.withColumn("pred", argmax_class("probs", classes)).drop(*[f"p{i}" for i in range(len(classes))])


def classifier_confidence(df: DataFrame) -> DataFrame:
    """Final signal and confidence from mean_f1, max_prob, fold_std, calibration_error,
    disagreement, ensemble_f1 and raw_signal."""
    c = clip(F.col("mean_f1") * F.col("max_prob"), 0.05, 0.95)
    c = c * F.when(F.col("fold_std") > 0.10, clip(1.2 - 2.2 * F.col("fold_std"), 0.55, 1.0)).otherwise(1.0)
    c = c * F.when(F.col("calibration_error") > 0.28, 0.84).otherwise(1.0)
    c = c * F.when(F.col("disagreement"), 0.87).otherwise(1.0)
    c = clip(c, 0.05, 0.95)
    weak = F.col("ensemble_f1") < 0.42
    return df.withColumns(
        {"signal": F.when(weak, 0).otherwise(F.col("raw_signal")), "confidence": F.when(weak, F.least(c, F.lit(0.35))).otherwise(c)}
    )


# --- models as of a date -----------------------------------------------------
#
# A prediction of fold k is made by models that saw nothing after the fold's training
# days, and here it is weighted and trusted by nothing but what folds before k showed. So
# what holds on a date was known on that date.


def _of_earlier_folds(per_fold: DataFrame, folds: int) -> DataFrame:
    """Rows of each fold, once for every later one, up to ``folds`` (after the last); for
    tables of a few rows a fold."""
    return per_fold.withColumnRenamed("fold", "__of").withColumn("fold", F.explode(F.sequence(F.col("__of") + 1, F.lit(folds))))


def weights_as_of(predictions: DataFrame, folds: int) -> DataFrame:
    """(asset, model, fold, f1, fold_std, weight): as ``model_weights``, by the predictions of
    earlier folds alone. The first fold has no row."""
    counts = predictions.groupBy("asset", "model", "fold", "y", "pred").agg(F.count("*").alias("n_rows"))
    key = ["asset", "model", "fold"]
    overall = weighted_scores(_of_earlier_folds(counts, folds), key, "n_rows").select(*key, F.col("f1_weighted").alias("f1"))
    per = _of_earlier_folds(weighted_scores(counts, key, "n_rows").select(*key, "f1_weighted"), folds)
    spread = per.groupBy(*key).agg(F.when(F.count("*") >= 2, F.stddev_pop("f1_weighted")).otherwise(0.0).alias("fold_std"))
    j = overall.join(spread, key)
    return j.withColumn("weight", F.greatest(F.lit(0.05), F.col("f1") * clip(1 - 2 * F.col("fold_std"), 0.45, 1.0)))


def views_as_of(predictions: DataFrame, folds: int = 5, classes: Sequence[int] = CLASSES) -> DataFrame:
    """The classifiers' joint view per (asset, date): fold, y, votes, probs, pred, signal and
    confidence. Models weigh by their skill in earlier folds; in the first fold, which has
    none, they weigh the same and the view is neutral, as for thin history."""
    weights = stage(weights_as_of(predictions, folds), "weights-as-of")
    j = predictions.join(weights.select("asset", "model", "fold", "weight"), ["asset", "model", "fold"], "left")
    j = j.withColumn("weight", F.coalesce("weight", F.lit(0.05)))
    total = F.sum("weight") + 1e-12
    parts = F.array(*[F.sum(F.col("probs")[i] * F.col("weight")) / total for i in range(len(classes))])
    e = j.groupBy("asset", "date", "fold").agg(F.first("y").alias("y"), F.countDistinct("pred").alias("votes"), parts.alias("probs"))
    e = stage(e.withColumn("pred", argmax_class("probs", classes)), "ensemble-as-of")
    miss = F.abs(F.array_max("probs") - (F.col("y") == F.col("pred")).cast("double"))
    seen = e.groupBy("asset", "fold", "y", "pred").agg(F.count("*").alias("n_rows"), F.sum(miss).alias("miss"))
    seen = _of_earlier_folds(seen, folds)
    quality = weighted_scores(seen, ["asset", "fold"], "n_rows").select("asset", "fold", F.col("f1_weighted").alias("ensemble_f1"))
    error = seen.groupBy("asset", "fold").agg((F.sum("miss") / F.sum("n_rows")).alias("calibration_error"))
    skill = weights.groupBy("asset", "fold").agg(F.avg("f1").alias("mean_f1"), F.max("fold_std").alias("fold_std"))
    known = quality.join(error, ["asset", "fold"]).join(skill, ["asset", "fold"])
    x = e.join(known, ["asset", "fold"], "left").withColumns(
        {"max_prob": F.array_max("probs"), "raw_signal": F.col("pred"), "disagreement": F.col("votes") > 1}
    )
    x = classifier_confidence(x)
    thin = F.col("mean_f1").isNull()
    x = x.withColumns({"signal": F.when(thin, 0).otherwise(F.col("signal")), "confidence": F.when(thin, 0.30).otherwise(F.col("confidence"))})
    return x.select("asset", "date", "fold", "y", "votes", "probs", "pred", "signal", "confidence")


def _middle(ordered: Column) -> Column:
    """Median of a sorted array; null if it is empty."""
    n = F.size(ordered)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, low) + F.get(ordered, high)) / 2)


def forecast_as_of(rows: DataFrame, predictions: DataFrame, folds: int = 4, horizon: int = HORIZON) -> DataFrame:
    """Daily expected return and confidence per (asset, date) of the folds' test rows: the
    models' median prediction, shrunk by the skill of earlier folds towards the median of
    the 90 newest targets that were known by then (a target is known ``horizon`` rows
    later). Without earlier folds the mean of the 30 newest known targets stands."""
    w = series()
    known = rows.select(
        "asset",
        "date",
        F.avg("y").over(w.rowsBetween(-horizon - 29, -horizon)).alias("recent_mean"),
        _middle(F.sort_array(F.collect_list("y").over(w.rowsBetween(-horizon - 89, -horizon)))).alias("anchor"),
    )
    median = predictions.groupBy("asset", "date", "fold").agg(F.median("pred").alias("predicted"))
    past = _of_earlier_folds(fold_skill(predictions).select("asset", "model", "fold", "r2", "mae", "baseline_mae", "directional"), folds)
    m = past.groupBy("asset", "model", "fold").agg(*[F.median(c).alias(c) for c in ("r2", "mae", "baseline_mae", "directional")])
    mae_skill = 1 - F.col("mae") / (F.col("baseline_mae") + 1e-12)
    m = m.withColumns({"mae_skill": mae_skill, "composite": 0.45 * F.col("r2") + 0.35 * mae_skill + 0.20 * (2 * (F.col("directional") - 0.5))})
    s = m.groupBy("asset", "fold").agg(F.max("composite").alias("best"), *[F.median(c).alias(c) for c in ("r2", "directional", "mae_skill")])
    j = median.join(known, ["asset", "date"]).join(s, ["asset", "fold"], "left")
    shrink = clip(0.50 + 0.45 * clip("best", -1.0, 1.0), 0.15, 0.95)
    conf = clip(0.12 + 0.32 * F.col("r2") + 0.28 * F.col("mae_skill") + 0.28 * (F.col("directional") - 0.5), 0.05, 0.95)
    thin = F.col("best").isNull() | F.col("anchor").isNull()
    blended = F.when(thin, F.col("recent_mean")).otherwise(shrink * F.col("predicted") + (1 - shrink) * F.col("anchor"))
    return j.select(
        "asset", "date", "fold", (blended / float(horizon)).alias("expected_daily"),
        F.when(thin, 0.20).otherwise(conf).alias("confidence"), F.when(thin, "recent_mean").otherwise("ensemble").alias("method"),
    )


def newest_before(days: DataFrame, views: DataFrame, cols: Sequence[str]) -> DataFrame:
    """For every (asset, date) of ``days`` the newest row of ``views`` up to that date, and
    its own date as ``view_date``; both are merged in one ordering of an asset's days."""
    at = F.struct(F.col("date").alias("view_date"), *cols)
    rows = days.select("asset", "date", F.lit(True).alias("__day"), F.lit(None).cast(views.select(at.alias("v")).schema["v"].dataType).alias("v"))
    rows = rows.unionByName(views.select("asset", "date", F.lit(False).alias("__day"), at.alias("v")))
    # on one date the view comes before the day that looks for it
    w = Window.partitionBy("asset").orderBy("date", "__day").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("v", F.last("v", ignorenulls=True).over(w)).filter("__day").select("asset", "date", "v.*")


def point_in_time(folds: DataFrame) -> DataFrame:
    """Per (asset, fold): last training day, first and last day its models are used, days
    between, and rows used on or before the last training day (none, if nothing leaks)."""
    train = folds.filter("role = 'train'").groupBy("asset", "fold").agg(F.max("date").alias("fold_end"))
    used = folds.filter("role = 'test'").join(train, ["asset", "fold"])
    s = used.groupBy("asset", "fold").agg(
        F.max("fold_end").alias("fold_end"),
        F.min("date").alias("first_use"),
        F.max("date").alias("last_use"),
        F.sum((F.col("fold_end") >= F.col("date")).cast("long")).alias("leaks"),
    )
    return s.withColumn("gap_days", F.datediff("first_use", "fold_end"))


def gates(rows: DataFrame) -> DataFrame:
    """Whether an asset has enough history and balanced classes to be modelled."""
    last = F.row_number().over(whole().orderBy(F.col("date").desc())) == 1
    x = rows.withColumn("__last", last)
    hist = x.filter(~F.col("__last")).groupBy("asset", "y").agg(F.count("*").alias("c"))
    per = hist.groupBy("asset").agg(F.sum("c").alias("n_hist"), F.min("c").alias("min_class"))
    need = F.greatest(F.lit(12), F.floor(0.02 * F.col("n_hist"))).cast("long")
    status = (
        F.when((F.col("n_hist") + 1 < 180) | (F.col("n_hist") < 150), "insufficient_history")
        .when(F.col("min_class") < need, "class_imbalance")
        .otherwise("ok")
    )
    conf = F.when(F.col("status") == "insufficient_history", 0.30).when(F.col("status") == "class_imbalance", 0.28)
    return per.withColumns({"min_required": need, "status": status}).withColumn("neutral_confidence", conf)


# --- MLlib models -----------------------------------------------------------


def fourier_features(prepared: DataFrame, cols: Sequence[str] = FEATURES, n: int = 64, gamma: float | None = None, seed: int = 7) -> tuple[DataFrame, list[str]]:
    """Random Fourier features of an RBF kernel (Rahimi and Recht, 2007): a linear
    model on them stands in for a kernel machine and scales with the rows."""
    rng = np.random.default_rng(seed)
    gamma = 1.0 / len(cols) if gamma is None else gamma
    omega = rng.normal(0.0, np.sqrt(2 * gamma), size=(n, len(cols)))
    phase = rng.uniform(0, 2 * np.pi, size=n)
    root = float(np.sqrt(2.0 / n))
    terms = {
        f"rff{k}": "cos(" + " + ".join(f"{c} * {omega[k, i]!r}D".replace("np.float64(", "").replace(")D", "D") for i, c in enumerate(cols)) + f" + {float(phase[k])!r}D) * {root!r}D"
        for k in range(n)
    }
    return prepared.selectExpr("*", *[f"{e} AS {n_}" for n_, e in terms.items()]), list(terms)


def fit_folds(prepared: DataFrame, cols: Sequence[str], make: Callable[[], object], name: str, classifier: bool = False, workers: int = 4) -> DataFrame:
    """Fit one MLlib estimator per fold on the train rows of all assets and predict
    the test rows. The asset enters as one-hot columns; the driver only starts the
    fits, a few at a time."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    folds = [r["fold"] for r in prepared.select("fold").distinct().orderBy("fold").collect()]
    labelled = prepared.withColumn("label", (F.col("y") + 1).cast("double") if classifier else F.col("y"))
    if classifier:
        # classes and folds are few: counts by a map-side-combined aggregate, joined back
        counts = labelled.filter("role = 'train'").groupBy("fold", "y").agg(F.count("*").alias("of_class"))
        fold = Window.partitionBy("fold")
        weights = counts.select("fold", "y", (F.sum("of_class").over(fold) / (F.count("*").over(fold) * F.col("of_class"))).alias("weight"))
        labelled = labelled.join(weights, ["fold", "y"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    stages = [
        StringIndexer(inputCol="asset", outputCol="__ai", handleInvalid="keep"),
        OneHotEncoder(inputCol="__ai", outputCol="__av"),
        VectorAssembler(inputCols=[*cols, "__av"], outputCol="features"),
    ]
    ready = Pipeline(stages=stages).fit(labelled).transform(labelled)
    keep = ["asset", "fold", "date", "pos", "n", "test_end", "y", "label", "role", "features"] + (["weight"] if classifier else [])
    # Read once per fold and role; written out so that each fit prunes to its rows.
    ready = stage(ready.select(*keep), "model-rows")

    def one(fold: int) -> DataFrame:
        part = ready.filter(F.col("fold") == fold)
        model = make().fit(part.filter("role = 'train'"))
        return model.transform(part.filter("role = 'test'"))

    pool = ThreadPool(min(workers, max(1, len(folds))))
    try:
        outs = pool.map(inheritable_thread_target(ready.sparkSession)(one), folds)
    finally:
        pool.close()
    out = outs[0]
    for more in outs[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    base = ["asset", "fold", "date", "pos", "n", "test_end", "y", F.lit(name).alias("model")]
    if not classifier:
        means = prepared.filter("role = 'train'").groupBy("asset", "fold").agg(F.avg("y").alias("train_mean"))
        return out.select(*base, F.col("prediction").alias("pred")).join(means, ["asset", "fold"], "left").withColumn(
            "train_mean", F.coalesce("train_mean", F.lit(0.0))
        )
    from pyspark.ml.functions import vector_to_array

    probs = vector_to_array("probability") if "probability" in out.columns else _softmax(vector_to_array("rawPrediction"))
    return out.select(*base, probs.alias("probs")).withColumn("pred", argmax_class("probs"))


def _softmax(raw: Column) -> Column:
    e = F.transform(raw, lambda v: F.exp(v))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def random_forest(trees: int = 200):
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(numTrees=trees, maxDepth=4, minInstancesPerNode=10, seed=7)


def robust_linear():
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(loss="huber", regParam=1e-3, maxIter=50)


def balanced_logistic(iterations: int = 40):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(family="multinomial", weightCol="weight", maxIter=iterations, regParam=1e-3, tol=1e-4)


def boosted_trees(rounds: int = 200):
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    tree = GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.05, subsamplingRate=0.85, seed=42)
    return OneVsRest(classifier=tree, parallelism=3)


def prepared_regression(prices: DataFrame) -> DataFrame:
    """Folds by position, for models fitted per asset."""
    return standardise(regression_folds(regression_rows(technical_features(prices))))


def pooled_regression(prices: DataFrame) -> DataFrame:
    """Folds by date, for models fitted on all assets."""
    return pooled(standardise(calendar_folds(regression_rows(technical_features(prices)), 4, 60, 15, 90, 1)), FEATURES)


def pooled_classification(prices: DataFrame) -> DataFrame:
    return pooled(standardise(calendar_folds(classification_rows(technical_features(prices)), 5, 120, 30, 150, 30)), FEATURES)


def score_table(predictions: DataFrame) -> DataFrame:
    s = model_skill(fold_skill(predictions))
    names = ("median_r2", "median_mae", "median_baseline_mae", "median_directional", "composite", "latest_prediction")
    return s.select("asset", "model", "fold_count", *[rnd(n, 5).alias(n) for n in names])
