"""The whole job from prices to decisions, one saved table per section."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import align as A
from tidepanel.operators import backtest as B
from tidepanel.operators import capital as C
from tidepanel.operators import drift as D
from tidepanel.operators import features as X
from tidepanel.operators import fusion as FU
from tidepanel.operators import impute as I
from tidepanel.operators import learning as L
from tidepanel.operators import portfolio as PF
from tidepanel.operators import quality as Q
from tidepanel.operators import resample as RS
from tidepanel.operators import risk as R
from tidepanel.operators import search as S
from tidepanel.operators import tactical as T
from tidepanel.session import stage


@dataclass(frozen=True)
class Settings:
    """Who is who in the universe, and the numbers the report is made with."""

    assets: tuple[str, ...]
    roles: Mapping[str, str]
    focus: str
    cash: str
    sinks: tuple[str, ...]
    rf: float = 0.02
    cost_bps: float = 12.0
    eval_start: str = "1999-01-01"
    steps: int = 20
    paths: int = 5000
    target_vol: float = 0.15
    dd_tol: float = 0.25
    drift_tail: int = 504
    fallback_action: tuple[str, float] = ("Wait for clearer setup; rebalance to profile target.", 0.55)
    cash_like: tuple[str, ...] = field(default=())
    # "boosted" fits a tree for each fold, class and round, so it is asked for by name
    classifiers: tuple[str, ...] = ("logistic", "kernel")
    regressors: tuple[str, ...] = ("ridge", "forest", "kernel")


def class_predictions(prices: DataFrame, s: Settings) -> DataFrame:
    """Out-of-fold class probabilities of every classifier the settings name."""
    prepared = stage(L.pooled_classification(prices), "classification-folds")
    mapped, cols = L.fourier_features(prepared)
    fits = {
        "logistic": lambda: L.fit_folds(prepared, L.FEATURES, L.balanced_logistic, "logistic", classifier=True),
        "kernel": lambda: L.fit_folds(mapped, cols, L.balanced_logistic, "kernel", classifier=True),
        "boosted": lambda: L.fit_folds(prepared, L.FEATURES, L.boosted_trees, "boosted", classifier=True),
    }
    cells = ("asset", "model", "fold", "date", "y", "probs", "pred")
    return stage(reduce(DataFrame.unionByName, [fits[n]().select(*cells) for n in s.classifiers]), "class-predictions")


def return_predictions(prices: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """Out-of-fold return forecasts of every regression the settings name."""
    pooled = stage(L.pooled_regression(prices), "regression-folds")
    mapped, cols = L.fourier_features(pooled)
    fits = {
        "ridge": lambda: L.ridge(L.standardise(L.regression_folds(rows))),
        "forest": lambda: L.fit_folds(pooled, L.FEATURES, L.random_forest, "forest"),
        "kernel": lambda: L.fit_folds(mapped, cols, L.robust_linear, "kernel"),
    }
    cells = ("asset", "model", "fold", "date", "pos", "n", "test_end", "y", "train_mean", "pred")
    return stage(reduce(DataFrame.unionByName, [fits[n]().select(*cells) for n in s.regressors]), "return-predictions")


def live_state(rets: DataFrame, focus: str, views: DataFrame) -> DataFrame:
    """Momentum, regime and the classifiers' newest view of the focus asset, per date. Where
    there is none yet, their neutral answer for thin history is used."""
    x = rets.filter(F.col("asset") == focus)
    m = X.momentum(x).withColumnsRenamed({"signal": "mom_signal", "strength": "mom_strength"})
    s = m.join(X.regime(x).drop("asset", "price", "ret"), "date").select(
        F.col("date").alias("as_of"), "mom_signal", "mom_strength", "regime", "risk_off", "realized_vol", "long_vol", "regime_drawdown"
    )
    days = s.select(F.lit(focus).alias("asset"), F.col("as_of").alias("date"))
    newest = L.newest_before(days, views.filter(F.col("asset") == focus).select("asset", "date", "signal", "confidence"), ["signal", "confidence"])
    newest = newest.select(F.col("date").alias("as_of"), F.coalesce("signal", F.lit(0)).alias("cls_signal"), F.coalesce("confidence", F.lit(0.3)).alias("cls_confidence"))
    return s.join(newest, "as_of")


def segment_signals(rets: DataFrame, s: Settings, views: DataFrame, roles: DataFrame):
    """Overlay inputs as of the last training day of each segment, judged against the
    segment's own weights shortly before its rebalance."""
    state = live_state(rets, s.focus, views).withColumn("next_rebalance", B.next_quarter_end(F.col("as_of"))).withColumn("quality_scale", F.lit(1.0))

    def of(train: DataFrame, weights: DataFrame) -> DataFrame:
        ends = train.groupBy("segment").agg(F.max("date").alias("as_of"))
        bias = T.strategic_bias(weights.withColumnRenamed("segment", "book"), roles).select(F.col("book").alias("segment"), "bias")
        decided = T.decide(ends.join(state, "as_of").join(bias, "segment"), s.target_vol)
        return decided.select("segment", "signal", "confidence", "size")

    return of


def full_report(prices: DataFrame, s: Settings, path: str, matrix: DataFrame, baseline: DataFrame | None = None) -> dict[str, str]:
    """Run every layer and save each section under ``path``; sections of earlier runs
    that this one does not produce stay as they are. Returns section -> folder.

    The classifiers' views and the return forecasts are those known on each date
    (``views_as_of``, ``forecast_as_of``); the newest forecast is the median over the models.
    """
    spark = prices.sparkSession
    saved: dict[str, str] = {}

    def save(name: str, df: DataFrame) -> DataFrame:
        saved[name] = f"{path}/{name}"
        df.write.mode("overwrite").parquet(saved[name])
        return spark.read.schema(df.schema).parquet(saved[name])

    rets = stage(X.simple_return(prices), "returns")
    seen = rets.filter("ret IS NOT NULL")
    names = spark.createDataFrame([(a,) for a in s.assets], "asset STRING")
    flags = save("quality_flags", Q.quality_flags(rets))
    from tidepanel.sources.files import missing_assets

    warnings = save("quality_warnings", Q.quality_warnings(flags, Q.trading_days(seen, len(s.assets)), missing_assets(names, seen)))
    panel, failure = I.completed_panel(seen.select("asset", "date", "ret"), s.assets)
    completed = save("panel", panel)
    if failure:
        save("panel_failure", spark.createDataFrame([(failure,)], "code STRING"))

    rows = stage(L.regression_rows(X.technical_features(prices)), "regression-rows")
    predicted = return_predictions(prices, rows, s)
    skill = save("model_skill", L.model_skill(L.fold_skill(predicted)))
    save("forecast_as_of", L.forecast_as_of(rows, predicted))
    forecast = save("forecast", L.forecast(rows, skill))
    classes = class_predictions(prices, s)
    save("classifier_scores", L.weighted_scores(classes, ["asset", "model"]))
    views = save("classifier_views", L.views_as_of(classes).drop("probs"))
    days = seen.agg(F.countDistinct("date").alias("n")).scalar()
    extras = seen.groupBy("asset").agg((1 - F.count("*") / days).alias("imputed_fraction")).join(
        forecast.select("asset", F.col("expected_daily").alias("forecast_daily")), "asset", "left"
    )
    book = completed.select(F.lit("optimal").alias("book"), "asset", "date", "ret")
    cma = save(
        "assumptions",
        C.assumptions(book, s.assets, s.rf, cash_like=s.cash_like, extras=extras.withColumn("book", F.lit("optimal"))),
    )
    p = len(s.assets)
    cloud = S.score(S.lattice(cma, p, s.steps), p, s.rf)
    save("frontier", S.frontier(cloud, p))
    top = S.max_sharpe(cloud, p)
    cells = F.array(*[F.struct(F.lit(a).alias("asset"), F.col(f"w{i}").alias("w")) for i, a in enumerate(s.assets)])
    weights = save("weights", top.select("book", F.inline(cells)))
    exposure = save("exposure", PF.exposures(weights, s.assets, cma, s.rf))
    daily = PF.book_returns(weights, completed, s.assets)
    save("risk", R.risk_pack(daily, ["book"], s.rf))
    paths = save("paths", RS.summarise(RS.path_outcomes(RS.parametric_paths(exposure, s.paths)), -abs(s.dd_tol)))
    save("paths_bootstrap", RS.summarise(RS.bootstrap_outcomes(daily, s.paths), -abs(s.dd_tol)))

    roles = spark.createDataFrame(list(s.roles.items()), "asset STRING, role STRING")
    state = live_state(rets, s.focus, views)
    newest = state.groupBy().agg(F.max_by(F.struct(*state.columns), "as_of").alias("v")).select("v.*")
    newest = newest.withColumn("next_rebalance", B.next_quarter_end(F.col("as_of")))
    newest = newest.withColumn("quality_scale", T.quality_scale(warnings, flags).scalar())
    bias = T.strategic_bias(weights, roles)
    one = newest.groupBy().agg(F.collect_list(F.struct(*newest.columns)).alias("v")).scalar()
    tactical = save("tactical", T.decide(bias.select("book", "bias", F.inline(one)), s.target_vol))
    conf = paths.select("book", FU.allocation_confidence(F.col("downside_probability"), forecast.agg(F.median("confidence").alias("c")).scalar()).alias("strategic_confidence"))
    decided = FU.decisions(tactical.join(conf, "book"), matrix, s.fallback_action)
    save("decision", decided.withColumn("fused_confidence", FU.fused_confidence(F.col("base_conf"), F.col("confidence"), F.col("strategic_confidence"))))

    calendar = completed.select("date").distinct()
    roles_of = stage(B.calendar_roles(calendar, B.segments(calendar, s.eval_start)), "roles")
    save("leakage", B.leakage_checks(roles_of))
    walk = save(
        "walk_forward",
        B.walk_forward(
            completed.select("asset", "date", "ret"), roles_of, s.assets, segment_signals(rets, s, views, roles), s.rf, s.cost_bps,
            s.focus, s.sinks, s.cash, s.target_vol, s.dd_tol, s.steps, cash_like=s.cash_like,
        ),
    )
    segments = save("segments", B.segment_metrics(walk, s.rf))
    save("segment_summary", B.summarise_segments(segments))
    current = save("fingerprint", D.fingerprint(completed, s.focus, s.drift_tail))
    base = baseline if baseline is not None else current.filter("false")
    found = save("drift", D.violations(current, base))
    save("drift_status", D.status(found, base))
    return saved
