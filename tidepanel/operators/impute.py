"""Completion of missing returns under a multivariate normal model (EM).

The E-step is affine in the observed cells for every missingness pattern, so the
count, sums and cross-products per pattern are sufficient: Spark makes one
aggregation over the panel, the iterations run on p x p matrices, and one projection
with the final coefficients fills the cells. Where the number of patterns is not
small, or the universe is wide, every iteration is a Spark aggregation over the staged
panel instead, and a wide universe starts from the tiles of ``gram_moments``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.align import wide
from tidepanel.operators.moments import MAX_UNROLLED, gram_moments
from tidepanel.session import stage

MAX_PATTERNS = 4096
# Condition up to which a covariance is inverted whole, once for all patterns.
MAX_CONDITION = 1e6


@dataclass
class EMModel:
    assets: list[str]
    mu: np.ndarray
    cov: np.ndarray
    iterations: int
    converged: bool
    deltas: list[float] = field(default_factory=list)
    # Parameters of the last E-step, which are the ones the cells are filled with.
    fill_mu: np.ndarray | None = None
    fill_cov: np.ndarray | None = None


def nearest_psd(m: np.ndarray, ratio: float = 1e-10) -> np.ndarray:
    sym = (m + m.T) / 2
    values, vectors = np.linalg.eigh(sym)
    values = np.maximum(values, max(ratio * np.trace(sym), 1e-12))
    return vectors @ np.diag(values) @ vectors.T


def whole_precision(cov: np.ndarray) -> np.ndarray | None:
    """Inverse of the whole covariance, or None where that is not well conditioned. A
    block's condition is never above the whole's."""
    cond = np.linalg.cond(cov)
    return np.linalg.inv(cov) if np.isfinite(cond) and cond <= MAX_CONDITION else None


def regression(mu: np.ndarray, cov: np.ndarray, obs: np.ndarray, precision: np.ndarray | None = None):
    """Coefficients of missing on observed cells, and the residual covariance.
    A near-singular observed block is shrunk 20 % towards its diagonal.

    With the whole ``precision`` only the missing cells' block is inverted, which is
    cheaper where fewer cells are missing than observed."""
    mis = ~obs
    if not obs.any():
        return np.zeros((int(mis.sum()), 0)), cov[np.ix_(mis, mis)]
    if precision is not None and mis.sum() < obs.sum():
        resid = np.linalg.inv(precision[np.ix_(mis, mis)])
        return -resid @ precision[np.ix_(mis, obs)], resid
    block = cov[np.ix_(obs, obs)]
    cond = np.linalg.cond(block) if precision is None else 1.0
    if not np.isfinite(cond) or cond > 1e10:
        block = 0.8 * block + 0.2 * np.diag(np.diag(block))
    try:
        inv = np.linalg.inv(block)
    except np.linalg.LinAlgError:
        inv = np.linalg.inv(block + 1e-8 * np.eye(len(block)))
    beta = cov[np.ix_(mis, obs)] @ inv
    return beta, cov[np.ix_(mis, mis)] - beta @ cov[np.ix_(obs, mis)]


def expected_sums(mu, cov, obs, n, s, ss):
    """Expected sum and cross-product of the completed rows of one pattern, given
    the observed rows' count, sum and cross-product (zero where missing)."""
    p = len(mu)
    beta, resid = regression(mu, cov, obs)
    mis = ~obs
    a = np.zeros((p, p))  # completed = a @ row + b
    a[np.ix_(obs, obs)] = np.eye(int(obs.sum()))
    a[np.ix_(mis, obs)] = beta
    b = np.zeros(p)
    b[mis] = mu[mis] - beta @ mu[obs]
    total = a @ s + n * b
    cross = a @ ss @ a.T + np.outer(a @ s, b) + np.outer(b, a @ s) + n * np.outer(b, b)
    cross[np.ix_(mis, mis)] += n * resid
    return total, cross


def _pattern_sums(rows: DataFrame, p: int) -> DataFrame:
    cells = [F.col(f"a{i}") for i in range(p)]
    bits = F.concat(*[F.when(c.isNotNull(), "1").otherwise("0") for c in cells])
    zero = [F.coalesce(c, F.lit(0.0)) for c in cells]
    return rows.groupBy(bits.alias("pattern")).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(z) for z in zero]).alias("s"),
        F.array(*[F.sum(zero[i] * zero[j]) for i in range(p) for j in range(i, p)]).alias("ss"),
    )


def _square(flat, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = flat
    return m + np.triu(m, 1).T


def _starting_point(rows: DataFrame, p: int):
    aggs = [F.avg(f"a{i}").alias(f"m{i}") for i in range(p)]
    aggs += [F.covar_samp(f"a{i}", f"a{j}").alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    one = rows.agg(*aggs).first()
    mu = np.array([one[f"m{i}"] or 0.0 for i in range(p)])
    flat = [one[f"c{i}_{j}"] for i in range(p) for j in range(i, p)]
    flat = [0.0 if v is None or not np.isfinite(v) else v for v in flat]
    return mu, nearest_psd(_square(flat, p))


def _wide_starting_point(df: DataFrame, keep: Sequence[str]):
    """The same from long rows: no expression for each pair."""
    means = {row["asset"]: row["m"] for row in df.filter(F.col("asset").isin(*keep)).groupBy("asset").agg(F.avg("ret").alias("m")).collect()}
    cov = np.zeros((len(keep), len(keep)))
    pairs = gram_moments(df, keep).filter("cov IS NOT NULL").select("i", "j", "cov").toPandas()
    cov[pairs["i"], pairs["j"]] = pairs["cov"]
    return np.array([means[a] or 0.0 for a in keep]), nearest_psd(cov)


def em_fit(df: DataFrame, assets: Sequence[str], max_iter: int = 150, tol: float = 1e-7, min_rows: int = 5, max_patterns: int = MAX_PATTERNS) -> EMModel:
    """Mean and covariance of the panel. Assets with fewer than ``min_rows``
    observations are left out of the model."""
    counts = {row["asset"]: row["n"] for row in df.filter(F.col("asset").isin(*assets)).groupBy("asset").agg(F.count("ret").alias("n")).collect()}
    keep = [a for a in assets if counts.get(a, 0) >= min_rows]
    if not keep:
        raise ValueError("no asset has enough observations")
    p = len(keep)
    # A date with no kept asset has no observed cell but still is a row of the panel.
    rows = stage(wide(df, keep), "em-panel")
    narrow = p <= MAX_UNROLLED
    mu, cov = _starting_point(rows, p) if narrow else _wide_starting_point(df, keep)
    n_rows = rows.count()
    stats = _pattern_sums(rows, p).limit(max_patterns + 1).collect() if narrow else None
    if stats is not None and len(stats) <= max_patterns:
        patterns = [
            (np.array([ch == "1" for ch in s["pattern"]]), s["n"], np.array(s["s"]), _square(s["ss"], p)) for s in stats
        ]

        def sums(mu, cov):
            parts = [expected_sums(mu, cov, *t) for t in patterns]
            return sum(t for t, _ in parts), sum(c for _, c in parts)
    else:

        def sums(mu, cov):
            return _distributed_sums(rows, mu, cov)

    deltas: list[float] = []
    converged = False
    last = (mu, cov)
    for _ in range(max_iter):
        last = (mu, cov)
        total, cross = sums(mu, cov)
        new_mu = total / n_rows
        new_cov = nearest_psd(cross / n_rows - np.outer(new_mu, new_mu))
        deltas.append(float(np.linalg.norm(new_cov - cov) / (np.linalg.norm(cov) + 1e-12)))
        mu, cov = new_mu, new_cov
        if deltas[-1] < tol:
            converged = True
            break
    return EMModel(keep, mu, cov, len(deltas), converged, deltas, *last)


def _distributed_sums(rows: DataFrame, mu: np.ndarray, cov: np.ndarray):
    """One E-step as a Spark job: each task completes its rows pattern by pattern and
    returns a single p x p partial sum, which is added up as arrays."""
    p = len(mu)
    cols = [f"a{i}" for i in range(p)]
    precision = whole_precision(cov)

    def partial(batches):
        total, cross = np.zeros(p), np.zeros((p, p))
        for batch in batches:
            x = batch[cols].to_numpy(dtype=float)
            kinds, where = np.unique(~np.isnan(x), axis=0, return_inverse=True)
            for k, obs in enumerate(kinds):
                mis = np.flatnonzero(~obs)
                if not len(mis):
                    continue
                hit = np.flatnonzero(where.ravel() == k)
                beta, resid = regression(mu, cov, obs, precision)
                x[np.ix_(hit, mis)] = mu[mis] + (x[np.ix_(hit, np.flatnonzero(obs))] - mu[obs]) @ beta.T
                cross[np.ix_(mis, mis)] += len(hit) * resid
            total += x.sum(axis=0)
            cross += x.T @ x
        i, j = np.meshgrid(np.arange(-1, p), np.arange(p), indexing="ij")
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": np.vstack([total, cross]).ravel()})

    parts = rows.select(*cols).mapInPandas(partial, "i INT, j INT, v DOUBLE")
    sums = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((p + 1, p))
    out[sums["i"] + 1, sums["j"]] = sums["v"]
    return out[0], out[1:]


def em_complete(df: DataFrame, assets: Sequence[str], model: EMModel) -> DataFrame:
    """Long (asset, date, ret, is_imputed) panel with the missing cells filled by the
    conditional mean. Assets outside the model stay NULL."""
    p, keep = len(model.assets), model.assets
    mu, cov = model.fill_mu, model.fill_cov
    rows = wide(df, assets)
    place = [list(assets).index(a) for a in keep]
    precision = whole_precision(cov)

    def fill(batches):
        for batch in batches:
            x = batch[[f"a{k}" for k in place]].to_numpy(dtype=float)
            seen = ~np.isnan(x)
            kinds, where = np.unique(seen, axis=0, return_inverse=True)
            for k, obs in enumerate(kinds):
                if obs.all():
                    continue
                hit = np.flatnonzero(where.ravel() == k)
                beta, _ = regression(mu, cov, obs, precision)
                part = x[np.ix_(hit, np.flatnonzero(obs))]
                x[np.ix_(hit, np.flatnonzero(~obs))] = mu[~obs] + (part - mu[obs]) @ beta.T
            n = len(batch)
            out = {"date": np.repeat(batch["date"].to_numpy(), p), "asset": np.tile(np.array(keep, dtype=object), n)}
            yield pd.DataFrame({**out, "ret": x.ravel(), "is_imputed": ~seen.ravel()})

    full = rows.mapInPandas(fill, "date DATE, asset STRING, ret DOUBLE, is_imputed BOOLEAN")
    dropped = [a for a in assets if a not in keep]
    if dropped:
        hollow = rows.select(
            "date", F.explode(F.array(*[F.lit(a) for a in dropped])).alias("asset"), F.lit(None).cast("double").alias("ret"), F.lit(False).alias("is_imputed")
        )
        full = full.unionByName(hollow)
    return full


def completed_panel(df: DataFrame, assets: Sequence[str], enabled: bool = True) -> tuple[DataFrame, str | None]:
    """The completed panel, or the strict-overlap panel plus a warning code where
    completion is off or fails."""
    from tidepanel.operators.align import strict_overlap

    df = df.filter(F.col("asset").isin(*assets))
    plain = strict_overlap(df.filter("ret IS NOT NULL"), len(assets)).select("date", "asset", "ret", F.lit(False).alias("is_imputed"))
    if not enabled:
        return plain, None
    try:
        return em_complete(df, assets, em_fit(df, assets)), None
    except (ValueError, np.linalg.LinAlgError):
        return plain, "EM_FAILURE"


def covariance_rows(spark, model: EMModel) -> DataFrame:
    """(asset_a, asset_b, mu_a, v) of the fitted model."""
    names = model.assets
    rows = [
        (a, b, float(model.mu[i]), float(model.cov[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)
    ]
    return spark.createDataFrame(rows, "asset_a STRING, asset_b STRING, mu_a DOUBLE, v DOUBLE")


def imputation_diagnostics(df: DataFrame, observed: str = "ret", completed: str = "filled") -> DataFrame:
    """Share of cells that were filled and the spread of the filled values."""
    made = F.col(observed).isNull() & F.col(completed).isNotNull()
    return df.groupBy("asset").agg(
        F.avg(made.cast("double")).alias("imputed_fraction"),
        F.var_pop(F.when(made, F.col(completed))).alias("imputed_var"),
    )
