"""Portfolio construction as a distributed search over a weight lattice.

Each book row carries its own means and covariance and fans out into every long-only
mix on a grid of 1/steps; scoring is one projection, constraints are filters, and an
optimum is a max/min over structs, which combines map-side to one row per task. The
fan-out is redistributed after two dimensions, so one book fills a whole cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.draws import with_uniforms

EPS = 1e-12
MAX_UNROLLED = 12


def lattice(cma: DataFrame, p: int, steps: int) -> DataFrame:
    """Every weight vector with entries in multiples of 1/steps, for every book."""
    if not 2 <= p <= MAX_UNROLLED:
        raise ValueError(f"the lattice covers 2 to {MAX_UNROLLED} assets")
    df, left = cma, F.lit(steps)
    for i in range(p - 1):
        df = df.withColumn(f"i{i}", F.explode(F.sequence(F.lit(0), left)))
        left = left - F.col(f"i{i}")
        if i == min(1, p - 2):
            df = df.repartition("book", *[f"i{k}" for k in range(i + 1)])
    cells = [(F.col(f"i{i}") / steps).alias(f"w{i}") for i in range(p - 1)]
    cells.append((left / steps).alias(f"w{p - 1}"))
    return df.select("*", *cells).drop(*[f"i{i}" for i in range(p - 1)])


def dirichlet(cma: DataFrame, p: int, n: int, seed: int = 7) -> DataFrame:
    """``n`` uniform random mixes per book: normalised exponentials."""
    df = cma.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).repartition("book", "draw")
    raw = with_uniforms(df, {f"e{i}": (F.col("draw"), i, seed) for i in range(p)})
    exp = [-F.log(F.col(f"e{i}")) for i in range(p)]
    total = sum(exp[1:], exp[0])
    mix = F.inline(F.array(F.struct(*[(e / total).alias(f"w{i}") for i, e in enumerate(exp)])))
    return raw.select(*[n for n in cma.columns], mix)


def project(df: DataFrame, p: int, bounds: Sequence[tuple[float, float]]) -> DataFrame:
    """Every mix moved to the nearest one (by distance) that keeps the bounds and adds up to
    one; a mix that does so already stays.

    The nearest mix is w - t, cut to the bounds, for the level t at which it adds up to one.
    The sum falls as t grows and bends only where an entry meets a bound. So t lies on the
    straight piece behind the largest such place at which the sum is still one or more.
    """
    limits = [(float(lo), float(hi)) for lo, hi in bounds]
    if sum(lo for lo, _ in limits) > 1 + 1e-12 or sum(hi for _, hi in limits) < 1 - 1e-12:
        raise ValueError("no mix keeps these bounds")
    names = [f"w{i}" for i in range(p)]
    left = lambda i, t: F.least(F.greatest(F.col(names[i]) - t, F.lit(limits[i][0])), F.lit(limits[i][1]))
    total = lambda t: sum((left(i, t) for i in range(1, p)), left(0, t))
    places = F.array(*[F.col(n) - b for n, own in zip(names, limits, strict=True) for b in own])
    x = df.withColumn("__from", F.array_max(F.filter(places, lambda t: total(t) >= 1.0 - 1e-12)))
    start = F.col("__from")
    moving = [((F.col(n) - hi <= start) & (start < F.col(n) - lo)).cast("int") for n, (lo, hi) in zip(names, limits, strict=True)]
    free = sum(moving[1:], moving[0])
    x = x.withColumn("__level", start + F.when(free == 0, 0.0).otherwise(F.try_divide(total(start) - 1.0, free)))
    return x.withColumns({n: left(i, F.col("__level")) for i, n in enumerate(names)}).drop("__from", "__level")


def weights(p: int) -> list[Column]:
    return [F.col(f"w{i}") for i in range(p)]


def score(df: DataFrame, p: int, rf: float) -> DataFrame:
    """Expected return, volatility, Sharpe and diversification ratio of w0..wp-1."""
    n = range(p)
    ret = " + ".join(f"w{i} * mu[{i}]" for i in n)
    var = " + ".join(
        f"{1 if i == j else 2}D * w{i} * w{j} * cov[{i * p + j}]" for i in n for j in range(i, p)
    )
    sig = " + ".join(f"w{i} * sqrt(cov[{i * p + i}])" for i in n)
    df = df.selectExpr("*", f"{ret} AS ret", f"sqrt(greatest({var}, 0D)) AS vol")
    return df.selectExpr(
        "*", f"(ret - {rf!r}D) / (vol + {EPS!r}D) AS sharpe", f"({sig}) / (vol + {EPS!r}D) AS diversification"
    )


def contributions(p: int, fallback_equal: bool = False) -> list[Column]:
    """Variance share of each asset: w_i (cov w)_i / variance."""
    none, floor = (1.0 / p, 1e-8) if fallback_equal else (0.0, 0.0)
    out = []
    for i in range(p):
        marginal = " + ".join(f"cov[{i * p + j}] * w{j}" for j in range(p))
        out.append(F.expr(f"CASE WHEN vol > {floor!r}D THEN w{i} * ({marginal}) / (vol * vol) ELSE {none!r}D END"))
    return out


def resolve_bounds(assets: Sequence[str], limits: Mapping[str, tuple[float, float]] | None, weight_cap: float = 1.0) -> tuple[list[tuple[float, float]], bool]:
    """(lower, upper) per asset under the cap, and whether any mix can satisfy them."""
    out = []
    for a in assets:
        lo, hi = (limits or {}).get(a, (0.0, weight_cap))
        lo, hi = max(0.0, lo), min(hi, weight_cap)
        out.append((lo, max(lo, hi)))
    feasible = sum(lo for lo, _ in out) <= 1 + 1e-9 and sum(hi for _, hi in out) >= 1 - 1e-9
    return out, feasible


def within(df: DataFrame, assets: Sequence[str], limits=None, weight_cap: float = 1.0, group: Sequence[str] = (), group_cap: float | None = None, tol: float = 1e-9) -> DataFrame:
    """Only mixes inside the per-asset bounds and under the joint group cap.
    Infeasible bounds fall back to the plain weight cap."""
    bounds, feasible = resolve_bounds(assets, limits, weight_cap)
    if not feasible:
        bounds, _ = resolve_bounds(assets, None, weight_cap)
    for i, (lo, hi) in enumerate(bounds):
        if lo > 0:
            df = df.filter(F.col(f"w{i}") >= lo - tol)
        if hi < 1:
            df = df.filter(F.col(f"w{i}") <= hi + tol)
    members = [F.col(f"w{i}") for i, a in enumerate(assets) if a in group]
    if group_cap is not None and len(members) >= 2:
        df = df.filter(sum(members[1:], members[0]) <= group_cap + tol)
    return df


def _point(p: int) -> list[Column]:
    return [*weights(p), F.col("ret"), F.col("vol"), F.col("sharpe")]


def best(df: DataFrame, p: int, metric: Column, largest: bool = True, name: str = "objective") -> DataFrame:
    """One optimum per book; ties go to the lexicographically larger weights."""
    key = metric if largest else -metric
    top = F.max(F.struct(key.alias("__m"), *_point(p))).alias("s")
    sign = F.col("s.__m") if largest else -F.col("s.__m")
    return df.groupBy("book").agg(top).select(
        "book", sign.alias(name), *[F.col(f"s.w{i}").alias(f"w{i}") for i in range(p)], "s.ret", "s.vol", "s.sharpe"
    )


def max_sharpe(df: DataFrame, p: int) -> DataFrame:
    return best(df, p, F.col("sharpe"))


def min_variance(df: DataFrame, p: int) -> DataFrame:
    return best(df, p, F.col("vol"), largest=False)


def max_return(df: DataFrame, p: int) -> DataFrame:
    return best(df, p, F.col("ret"))


def utility(df: DataFrame, p: int, risk_aversion: float) -> DataFrame:
    return best(df, p, F.col("ret") - 0.5 * risk_aversion * F.col("vol") * F.col("vol"))


def equal_risk(df: DataFrame, p: int) -> DataFrame:
    gap = sum((F.pow(x - 1.0 / p, F.lit(2.0)) for x in contributions(p)), F.lit(0.0))
    return best(df, p, gap, largest=False)


def target_volatility(df: DataFrame, p: int, target: float) -> DataFrame:
    """Highest return with volatility at most ``target``; the minimum-variance mix
    where no mix is that quiet. Both optima come from one aggregation."""
    inside = F.when(F.col("vol") <= target, F.struct(F.col("ret").alias("__m"), *_point(p)))
    quiet = F.struct((-F.col("vol")).alias("__m"), *_point(p))
    s = df.groupBy("book").agg(F.max(inside).alias("hit"), F.max(quiet).alias("mv"))
    pick = F.coalesce(F.col("hit"), F.col("mv"))
    return s.select("book", F.col("hit").isNotNull().alias("met"), pick.alias("s")).select("book", "met", *_fields(p))


def _fields(p: int) -> list[Column]:
    return [*[F.col(f"s.w{i}").alias(f"w{i}") for i in range(p)], F.col("s.ret"), F.col("s.vol"), F.col("s.sharpe")]


def exact_volatility(df: DataFrame, p: int, target: float, band: float = 0.01, tolerance: float = 1e-4) -> DataFrame:
    """Highest return among mixes whose volatility is within ``band`` (relative) of
    the target; clamped to the minimum-variance or maximum-return end outside the
    attainable range, and to the nearest volatility if the band is empty."""
    pt = _point(p)
    near = F.when(F.abs(F.col("vol") - target) <= band * target, F.struct(F.col("ret").alias("__m"), *pt))
    s = df.groupBy("book").agg(
        F.max(near).alias("hit"),
        F.max(F.struct((-F.col("vol")).alias("__m"), *pt)).alias("mv"),
        F.max(F.struct(F.col("ret").alias("__m"), *pt)).alias("mr"),
        F.max(F.struct((-F.abs(F.col("vol") - target)).alias("__m"), *pt)).alias("close"),
    )
    low, high = target <= F.col("mv.vol") + tolerance, target >= F.col("mr.vol") - tolerance
    pick = F.when(low, F.col("mv")).when(high, F.col("mr")).otherwise(F.coalesce("hit", "close"))
    case = F.when(low, "min_variance").when(high, "max_return").otherwise("target")
    return s.select("book", case.alias("case"), pick.alias("s")).select("book", "case", *_fields(p))


def inverse_volatility(vols: DataFrame, keys: Sequence[str] = ("book",)) -> DataFrame:
    """1/sigma weights per book; assets without volatility are left out."""
    x = vols.filter("vol > 0").withColumn("__i", 1 / F.col("vol"))
    return x.withColumn("w", F.col("__i") / F.sum("__i").over(Window.partitionBy(*keys))).drop("__i")


def pareto(points: DataFrame, keys: Sequence[str] = ("book",), slack: float = 1e-10, shards: int = 64) -> DataFrame:
    """Keep points whose return is at least the best seen at lower volatility."""


    def undominated(df: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("vol", "ret").rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("__b", F.max("ret").over(w)).filter(F.col("ret") >= F.col("__b") - slack).drop("__b")

    # A point beaten inside its own shard is beaten overall, so shards thin the
    # points out in parallel and only their few survivors meet in one window.
    sharded = points.withColumn("__shard", F.pmod(F.xxhash64("vol", "ret"), F.lit(shards)))
    return undominated(undominated(sharded, [*keys, "__shard"]).drop("__shard"), keys)


def frontier(df: DataFrame, p: int, points: int = 70, floor: float = 0.02, approx_accuracy: int | None = None) -> DataFrame:
    """Lowest volatility per return bucket from the floor percentile to the largest
    asset mean, plus the maximum-return mix, non-dominated points only."""
    if approx_accuracy:
        lo = F.percentile_approx("ret", floor, approx_accuracy)
    else:
        lo = F.percentile("ret", floor)
    ends = df.groupBy("book").agg(
        lo.alias("lo"),
        F.max(F.array_max("mu")).alias("hi"),
        F.max(F.struct(F.col("ret").alias("__m"), *_point(p))).alias("s"),
    )
    slot = F.floor(F.try_divide(F.col("ret") - F.col("lo"), F.col("hi") - F.col("lo")) * (points - 1) + 0.5).cast("int")
    quiet = F.max(F.struct((-F.col("vol")).alias("__m"), *_point(p))).alias("s")
    line = (
        df.join(ends.select("book", "lo", "hi"), "book")
        .withColumn("slot", slot)
        .filter(F.col("slot").between(0, points - 1))
        .groupBy("book", "slot")
        .agg(quiet)
        .select("book", *_fields(p))
    )
    top = ends.select("book", *_fields(p))
    return pareto(line.unionByName(top).distinct())


def refine(cma: DataFrame, p: int, rf: float, around: DataFrame, step: float, steps: int = 10) -> DataFrame:
    """Finer grid of the simplex around one earlier optimum per book: every mix whose
    first p-1 weights move by at most ``step`` in increments of step/steps."""
    df = cma.join(around.select("book", *[F.col(f"w{i}").alias(f"c{i}") for i in range(p)]), "book")
    for i in range(p - 1):
        df = df.withColumn(f"d{i}", F.explode(F.sequence(F.lit(-steps), F.lit(steps))))
        if i == min(1, p - 2):
            df = df.repartition("book", *[f"d{k}" for k in range(i + 1)])
        df = df.withColumn(f"w{i}", F.col(f"c{i}") + F.col(f"d{i}") * (step / steps)).filter(F.col(f"w{i}") >= -1e-12)
    rest = F.lit(1.0) - sum((F.col(f"w{i}") for i in range(1, p - 1)), F.col("w0"))
    df = df.withColumn(f"w{p - 1}", rest).filter(F.col(f"w{p - 1}") >= -1e-12)
    return score(df.drop(*[f"d{i}" for i in range(p - 1)], *[f"c{i}" for i in range(p)]), p, rf)


def downsample(df: DataFrame, n: int, order: Sequence[str], rule: str = "linspace", keys: Sequence[str] = ("book",)) -> DataFrame:
    """``n`` evenly spaced rows of an ordered series per key.

    ``linspace`` takes int(i (len-1)/(n-1)) and so both ends; ``floor`` takes
    floor(i len/n). A row qualifies by arithmetic on its own rank, so no index table
    is joined. The series are report curves of one key each.
    """
    w = Window.partitionBy(*keys)
    x = df.withColumns({"__r": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    r, size = F.col("__r"), F.col("__n")
    if rule == "linspace":
        step = (size - 1) / (n - 1)
    else:
        step = size / F.lit(n)
    # Row r is picked when some integer i < n has floor(i * step) = r.
    i = F.coalesce(F.ceil(F.try_divide(r, step)), F.lit(0))
    hit = (F.floor(i * step) == r) & (i < n)
    # Guard against i*step landing just below an integer.
    hit = hit | ((F.floor((i + 1) * step) == r) & (i + 1 < n)) | ((i >= 1) & (F.floor((i - 1) * step) == r))
    return x.filter((size <= n) | hit).drop("__r", "__n")
