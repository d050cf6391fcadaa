"""Registered portfolio queries: exposures, search, bounds, drift, walk-forward."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions.draws import uniform_sql
from tidepanel.functions.expr import rnd
from tidepanel.operators import align as A
from tidepanel.operators import backtest as B
from tidepanel.operators import capital as C
from tidepanel.operators import critical_line as CL
from tidepanel.operators import features as X
from tidepanel.operators import portfolio as PF
from tidepanel.operators import risk as R
from tidepanel.operators import search as S
from tidepanel.plans import parameters as K
from tidepanel.plans.alignment import BENCH, benchmark_returns, returns, staggered_returns
from tidepanel.plans.registry import BOOKS, PRICES, RETS, SRETS, W, ctes, d, query, r, returns_cte, values
from tidepanel.plans.statistics import BRETS, book_returns, rounded
from tidepanel.plans.windows import MOM_SQL, REG_SQL
from tidepanel.sources import panels as P
from tidepanel.sources.panels import ASSETS

NP = len(ASSETS)
RF = K.RISK_FREE
STEPS = 20
WCOLS = [f"w{i}" for i in range(NP)]
CASH = (K.CASH_LIKE,)


# --- SQL generators ---------------------------------------------------------


def _each(fmt: str, sep: str = ", ") -> str:
    return sep.join(fmt.format(i=i, a=a) for i, a in enumerate(ASSETS))


def cma_sql(src: str) -> str:
    pairs = [(i, j) for i in range(NP) for j in range(i, NP)]
    prior = f"CASE WHEN asset = '{K.CASH_LIKE}' THEN {RF} ELSE {RF} + 0.06 END"
    cell = lambda i, j: (
        f"greatest(c{i}_{j}, 1e-12) * 252 + 1e-10 AS s{i}_{j}" if i == j else f"c{i}_{j} * (1 - 5.0 / (5.0 + n)) * 252 AS s{i}_{j}"
    )
    return f"""
cw AS (SELECT book, date, {_each("max(ret) FILTER (asset = '{a}') AS a{i}")}, count(ret) AS k FROM {src} GROUP BY 1, 2 HAVING count(ret) > 0),
ce AS (SELECT book, count(*) FILTER (k = 5) AS complete FROM cw GROUP BY book),
cp AS (SELECT cw.book, {_each("coalesce(a{i}, 0.0) AS a{i}")} FROM cw JOIN ce USING (book) WHERE k = 5 OR complete < 20),
cb AS (SELECT book, {_each("quantile_cont(a{i}, 0.005) AS l{i}, quantile_cont(a{i}, 0.995) AS h{i}")} FROM cp GROUP BY book),
cc AS (SELECT cp.book, {_each("least(greatest(a{i}, l{i}), h{i}) AS a{i}")} FROM cp JOIN cb USING (book)),
cs AS (SELECT book, count(*) AS n, {', '.join(f'covar_samp(a{i}, a{j}) AS c{i}_{j}' for i, j in pairs)} FROM cc GROUP BY book),
hb AS (SELECT book, asset, quantile_cont(ret, 0.005) AS lo, quantile_cont(ret, 0.995) AS hi FROM {src} GROUP BY 1, 2),
hm AS (SELECT s.book, s.asset, avg(least(greatest(ret, lo), hi)) * 252 AS m FROM {src} s JOIN hb ON hb.book = s.book AND hb.asset = s.asset WHERE ret IS NOT NULL GROUP BY 1, 2),
hp AS (SELECT book, asset, m, {prior} AS prior, 0.7 * m + 0.3 * ({prior}) AS hist FROM hm),
mus AS (SELECT book, {_each("max(greatest(-0.10, least(0.55, hist))) FILTER (asset = '{a}') AS m{i}")} FROM hp GROUP BY book),
cma AS (SELECT cs.book, n, {_each("m{i}")}, {', '.join(cell(i, j) for i, j in pairs)} FROM cs JOIN mus USING (book))"""


def _s(i, j):
    return f"s{min(i, j)}_{max(i, j)}"


NAMES = _each("'{a}'")
RET_SQL = _each("w{i} * m{i}", " + ")
VAR_SQL = " + ".join(f"{'' if i == j else '2.0 * '}w{i} * w{j} * {_s(i, j)}" for i in range(NP) for j in range(i, NP))
RC_SQL = [f"w{i} * ({' + '.join(f'{_s(i, j)} * w{j}' for j in range(NP))}) / (vol * vol)" for i in range(NP)]


def score_sql(weights: str, on: str) -> str:
    return f"""
sc0 AS (SELECT *, {RET_SQL} AS ret, sqrt(greatest({VAR_SQL}, 0.0)) AS vol, {_each("w{i} * sqrt(s{i}_{i})", " + ")} AS wsig FROM {weights} {on}),
scored AS (SELECT *, (ret - {RF}) / (vol + 1e-12) AS sharpe, wsig / (vol + 1e-12) AS diversification FROM sc0)"""


def lattice_sql(steps: int) -> str:
    ranges = ", ".join(f"range(0, {steps + 1}) t{i}(i{i})" for i in range(NP - 1))
    total = " + ".join(f"i{i}" for i in range(NP - 1))
    cells = ", ".join(f"i{i} / CAST({steps} AS DOUBLE) AS w{i}" for i in range(NP - 1))
    return f"lat AS (SELECT {cells}, ({steps} - ({total})) / CAST({steps} AS DOUBLE) AS w{NP - 1} FROM {ranges} WHERE {total} <= {steps})"


ALL = "src AS (SELECT 'ALL' AS book, asset, date, ret FROM rets)"
SEARCH = (RETS, ALL, cma_sql("src"), lattice_sql(STEPS), score_sql("cma", "CROSS JOIN lat"))
POINT = ", ".join(f"{r(c, 4)} AS {c}" for c in WCOLS) + f", {r('ret')} AS ret, {r('vol')} AS vol, {r('sharpe', 5)} AS sharpe"
BYW = ", ".join(f"{c} DESC" for c in WCOLS)


def best_sql(metric: str, direction: str = "DESC", src: str = "scored", where: str = "TRUE") -> str:
    return f"SELECT book, {POINT} FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY {metric} {direction}, {BYW}) AS rk FROM {src} WHERE {where}) WHERE rk = 1"


def one_book(df):
    return df.select(F.lit("ALL").alias("book"), "asset", "date", "ret")


def cma(spark, sf):
    return C.assumptions(one_book(returns(spark, sf)), ASSETS, RF, cash_like=CASH)


def cloud(spark, sf, steps=STEPS):
    return S.score(S.lattice(cma(spark, sf), NP, steps), NP, RF)


def point(df, *extra):
    return df.select("book", *extra, *[rnd(c, 4).alias(c) for c in WCOLS], rnd("ret").alias("ret"), rnd("vol").alias("vol"), rnd("sharpe", 5).alias("sharpe"))


# --- portfolio search -------------------------------------------------------


@query("opt_01_candidate_cloud", ctes(*SEARCH) + f"SELECT book, {POINT} FROM scored")
def opt_01(spark, sf):
    return point(cloud(spark, sf))


LIMITS = " AND ".join(f"w{i} >= {K.BOUNDS[a][0]} - 1e-9 AND w{i} <= {K.BOUNDS[a][1]} + 1e-9" for i, a in enumerate(ASSETS)) + f" AND w0 + w1 <= {K.GROUP_CAP} + 1e-9"
DIRICHLET = "dx AS (SELECT " + ", ".join(f"-ln({uniform_sql('p', str(i), '7')}) AS e{i}" for i in range(NP)) + " FROM range(1, 25001) t(p)), lat AS (SELECT " + _each("e{i} / (e0 + e1 + e2 + e3 + e4) AS w{i}") + " FROM dx)"


BOUND = [K.BOUNDS[a] for a in ASSETS]


def _cut(i: int, t: str) -> str:
    return f"least(greatest(w{i} - {t}, {BOUND[i][0]}), {BOUND[i][1]})"


def _cut_sum(t: str) -> str:
    return " + ".join(_cut(i, t) for i in range(NP))


MOVING = " + ".join(f"CASE WHEN w{i} - {hi} <= st AND st < w{i} - {lo} THEN 1 ELSE 0 END" for i, (lo, hi) in enumerate(BOUND))
PROJECTED = f"""
pj0 AS (SELECT *, list_max(list_filter([{", ".join(f"w{i} - {b}" for i in range(NP) for b in BOUND[i])}], lambda t: {_cut_sum("t")} >= 1.0 - 1e-12)) AS st FROM lat),
pj1 AS (SELECT *, st + CASE WHEN ({MOVING}) = 0 THEN 0.0 ELSE ({_cut_sum("st")} - 1.0) / ({MOVING}) END AS lv FROM pj0),
pj AS (SELECT {", ".join(f"{_cut(i, 'lv')} AS w{i}" for i in range(NP))} FROM pj1)"""
BOUNDED_CLOUD = (RETS, ALL, cma_sql("src"), DIRICHLET, PROJECTED, score_sql("cma", "CROSS JOIN pj"))


def bounded_cloud(spark, sf):
    """Dirichlet draws, each moved to the nearest mix within the bounds."""
    return S.score(S.project(S.dirichlet(cma(spark, sf), NP, 25_000), NP, BOUND), NP, RF)


@query("opt_01b_dirichlet_cloud", ctes(*BOUNDED_CLOUD) + f"SELECT book, {POINT} FROM scored WHERE w0 + w1 <= {K.GROUP_CAP} + 1e-9")
def opt_01b(spark, sf):
    return point(S.within(bounded_cloud(spark, sf), ASSETS, None, 1.0, P.EQUITY, K.GROUP_CAP))


@query("opt_01c_projected_cloud", ctes(*BOUNDED_CLOUD) + f"SELECT book, {POINT} FROM scored")
def opt_01c(spark, sf):
    return point(bounded_cloud(spark, sf))


@query("opt_02_bounds_and_group_cap", ctes(*SEARCH) + f"SELECT book, {POINT} FROM scored WHERE {LIMITS}")
def opt_02(spark, sf):
    return point(S.within(cloud(spark, sf), ASSETS, K.BOUNDS, 1.0, P.EQUITY, K.GROUP_CAP))


@query("opt_03_max_sharpe", ctes(*SEARCH) + best_sql("sharpe"))
def opt_03(spark, sf):
    return point(S.max_sharpe(cloud(spark, sf), NP))


# A finer grid around the coarse optimum: +-5 steps of 0.01 in the first four weights.
REFINE = f"""
co AS (SELECT * FROM (SELECT book AS b, {", ".join(f"w{i} AS c{i}" for i in range(NP))}, row_number() OVER (PARTITION BY book ORDER BY sharpe DESC, {BYW}) AS rk FROM scored) WHERE rk = 1),
fg0 AS (SELECT b, {", ".join(f"c{i} + d{i} * CAST(0.01 AS DOUBLE) AS w{i}" for i in range(NP - 1))} FROM co, {", ".join(f"range(-5, 6) g{i}(d{i})" for i in range(NP - 1))}),
fg AS (SELECT *, 1.0 - ({" + ".join(f"w{i}" for i in range(NP - 1))}) AS w{NP - 1} FROM fg0 WHERE {" AND ".join(f"w{i} >= -1e-12" for i in range(NP - 1))}),"""
FINE = score_sql("cma", "JOIN fg ON fg.b = cma.book").replace("sc0", "fsc0").replace("scored", "fine")


@query("opt_03b_max_sharpe_refined", ctes(*SEARCH, REFINE, FINE.replace("fsc0 AS (SELECT *", "fsc0 AS (SELECT cma.*, " + ", ".join(f"fg.w{i}" for i in range(NP)))) + best_sql("sharpe", src="fine", where="w4 >= -1e-12"))
def opt_03b(spark, sf):
    params = cma(spark, sf)
    coarse = S.max_sharpe(S.score(S.lattice(params, NP, STEPS), NP, RF), NP)
    return point(S.max_sharpe(S.refine(params, NP, RF, coarse, 1.0 / STEPS, 5), NP))


@query("opt_04_min_variance", ctes(*SEARCH) + best_sql("vol", "ASC"))
def opt_04(spark, sf):
    return point(S.min_variance(cloud(spark, sf), NP))


TARGET = 0.11


@query(
    "opt_05_target_volatility",
    ctes(*SEARCH, f"mv AS ({best_sql('vol', 'ASC')}), hit AS ({best_sql('ret', where=f'vol <= {TARGET}')})")
    + f"SELECT (SELECT count(*) FROM hit) > 0 AS met, * FROM (SELECT * FROM hit UNION ALL SELECT * FROM mv WHERE NOT EXISTS (SELECT 1 FROM hit))",
)
def opt_05(spark, sf):
    return point(S.target_volatility(cloud(spark, sf), NP, TARGET), "met")


@query(
    "opt_06_exact_volatility",
    ctes(*SEARCH, f"mv AS ({best_sql('vol', 'ASC')}), mr AS ({best_sql('ret')}), hit AS ({best_sql('ret', where=f'abs(vol - {TARGET}) <= 0.01 * {TARGET}')}), nr AS ({best_sql(f'abs(vol - {TARGET})', 'ASC')})")
    + f"""SELECT 'min_variance' AS "case", * FROM mv WHERE {TARGET} <= vol + 1e-4
 UNION ALL SELECT 'max_return', * FROM mr WHERE {TARGET} >= vol - 1e-4 AND NOT EXISTS (SELECT 1 FROM mv WHERE {TARGET} <= vol + 1e-4)
 UNION ALL SELECT 'target', * FROM (SELECT * FROM hit UNION ALL SELECT * FROM nr WHERE NOT EXISTS (SELECT 1 FROM hit)) WHERE NOT EXISTS (SELECT 1 FROM mv WHERE {TARGET} <= vol + 1e-4) AND NOT EXISTS (SELECT 1 FROM mr WHERE {TARGET} >= vol - 1e-4)""",
)
def opt_06(spark, sf):
    return point(S.exact_volatility(cloud(spark, sf), NP, TARGET), "case")


@query("opt_07_mean_variance_utility", ctes(*SEARCH) + best_sql("ret - 0.5 * 3.0 * vol * vol"))
def opt_07(spark, sf):
    return point(S.utility(cloud(spark, sf), NP, 3.0))


@query("opt_08_equal_risk_contribution", ctes(*SEARCH) + best_sql("(" + " + ".join(f"pow({x} - 0.2, 2)" for x in RC_SQL) + ")", "ASC"))
def opt_08(spark, sf):
    return point(S.equal_risk(cloud(spark, sf), NP))


@query(
    "opt_09_inverse_volatility",
    ctes(RETS, ALL, cma_sql("src"), f"iv AS (SELECT book, unnest([{NAMES}]) AS asset, unnest([{_each('1 / sqrt(s{i}_{i})')}]) AS inv FROM cma)")
    + f"SELECT book, asset, {r('inv / sum(inv) OVER (PARTITION BY book)')} AS w FROM iv",
)
def opt_09(spark, sf):
    cells = F.array(*[F.struct(F.lit(a).alias("asset"), F.sqrt(F.col("cov")[i * NP + i]).alias("vol")) for i, a in enumerate(ASSETS)])
    vols = cma(spark, sf).select("book", F.inline(cells))
    return S.inverse_volatility(vols).select("book", "asset", rnd("w").alias("w"))


FRONT = f"""
fe AS (SELECT book, quantile_cont(ret, 0.02) AS lo, max(greatest({_each('m{i}')})) AS hi FROM scored GROUP BY book),
fs AS (SELECT s.*, CAST(floor((ret - lo) / (hi - lo) * 69 + 0.5) AS INTEGER) AS slot FROM scored s JOIN fe USING (book)),
fl AS (SELECT *, row_number() OVER (PARTITION BY book, slot ORDER BY vol, {BYW}) AS rk FROM fs WHERE slot BETWEEN 0 AND 69),
ft AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ret DESC, {BYW}) AS rk FROM scored),
fu AS (SELECT book, {', '.join(WCOLS)}, ret, vol, sharpe FROM fl WHERE rk = 1 UNION SELECT book, {', '.join(WCOLS)}, ret, vol, sharpe FROM ft WHERE rk = 1),
fp AS (SELECT *, max(ret) OVER (PARTITION BY book ORDER BY vol, ret ROWS UNBOUNDED PRECEDING) AS top FROM fu),
front AS (SELECT * FROM fp WHERE ret >= top - 1e-10)"""


@query("opt_10_efficient_frontier", ctes(*SEARCH, FRONT) + f"SELECT book, {POINT} FROM front")
def opt_10(spark, sf):
    return point(S.frontier(cloud(spark, sf), NP))


BOOK_PANELS = f"""
bp0 AS (SELECT c_mktsegment AS book, o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS p0 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
bp1 AS (SELECT book, asset, date, avg(p0) OVER (PARTITION BY book, asset ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS price FROM bp0),
src AS (SELECT book, asset, date, price / lag(price) OVER (PARTITION BY book, asset ORDER BY date) - 1 AS ret FROM bp1)"""


def book_panels(spark, sf):
    """One return panel per market segment."""
    daily = (
        P.table(spark, sf, "orders")
        .groupBy("o_custkey", F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("date"))
        .agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))
    )
    seg = P.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("book"))
    px = daily.join(seg, F.col("o_custkey") == F.col("c_custkey")).groupBy("book", "asset", "date").agg((F.sum("v") / F.sum("n")).alias("p0"))
    w = Window.partitionBy("book", "asset").orderBy("date")
    px = px.withColumn("price", F.avg("p0").over(w.rowsBetween(-59, 0)))
    return px.select("book", "asset", "date", (F.col("price") / F.lag("price").over(w) - 1).alias("ret"))


@query("opt_11_many_books_max_sharpe", ctes(BOOK_PANELS, cma_sql("src"), lattice_sql(STEPS), score_sql("cma", "CROSS JOIN lat")) + best_sql("sharpe"))
def opt_11(spark, sf):
    params = C.assumptions(book_panels(spark, sf), ASSETS, RF, cash_like=CASH)
    return point(S.max_sharpe(S.score(S.lattice(params, NP, STEPS), NP, RF), NP))


# --- exact optima by the critical line --------------------------------------

SWEEPS = 400


def _grad(i: int, slope: str) -> str:
    return "(" + " + ".join(f"w{j} * {_s(i, j)}" for j in range(NP)) + f" - {slope} * m{i})"


def _inside(cte: str, book: str, step: str, begin: str) -> str:
    """A recursion that carries a book's parameters along; ``step`` is nested over FROM."""
    params = ", ".join([*(f"m{i}" for i in range(NP)), *(f"s{i}_{j}" for i in range(NP) for j in range(i, NP))])
    cols = f"{book}, {params}, {', '.join(WCOLS)}"
    return f"{cte}(it, {cols}) AS (SELECT 0, {book}, {params}, {begin} FROM cma UNION ALL SELECT it + 1, {cols} FROM ({step}) WHERE it < {SWEEPS})"


def pairs_sql(cte: str, price: float) -> str:
    """Bounded quadratic programme, one pair of assets after another: an exact line search
    each, until nothing moves."""
    room = sum(hi - lo for lo, hi in BOUND)
    free = 1 - sum(lo for lo, _ in BOUND)
    begin = ", ".join(f"CAST({lo + (hi - lo) * free / room!r} AS DOUBLE) AS w{i}" for i, (lo, hi) in enumerate(BOUND))
    step = cte
    for i in range(NP):
        for j in range(i + 1, NP):
            best = f"({_grad(j, repr(price))} - {_grad(i, repr(price))}) / ({_s(i, i)} + {_s(j, j)} - 2.0 * {_s(i, j)})"
            least = f"greatest({BOUND[i][0]} - w{i}, w{j} - {BOUND[j][1]})"
            most = f"least({BOUND[i][1]} - w{i}, w{j} - {BOUND[j][0]})"
            step = f"SELECT * EXCLUDE (t) REPLACE (w{i} + t AS w{i}, w{j} - t AS w{j}) FROM (SELECT *, greatest({least}, least({most}, {best})) AS t FROM {step if step == cte else f'({step})'})"
    return _inside(cte, "book", step, begin)


def ratio_sql(cte: str) -> str:
    """Largest Sharpe ratio without bounds above: a mix of any size that balances excess
    return against variance, entry by entry, then scaled to one."""
    step = cte
    for i in range(NP):
        others = " + ".join(f"w{j} * {_s(i, j)}" for j in range(NP) if j != i)
        step = f"SELECT * REPLACE (greatest(0.0, (m{i} - {RF} - ({others})) / {_s(i, i)}) AS w{i}) FROM {step if step == cte else f'({step})'}"
    return _inside(cte, "book", step, ", ".join(f"CAST(1 AS DOUBLE) AS w{i}" for i in range(NP)))


def exact_sql(solver: str, scale: str = "1.0") -> tuple[str, str]:
    cells = ", ".join(f"w{i} / ({scale}) AS w{i}" for i in range(NP))
    return solver, f"fin AS (SELECT * REPLACE ({cells}) FROM qp WHERE it = {SWEEPS})," + score_sql("fin", "")


EXACT = f"SELECT book, {', '.join(f'{r(c, 4)} AS {c}' for c in WCOLS)}, {r('ret')} AS ret, {r('vol')} AS vol, {r('sharpe', 5)} AS sharpe, TRUE AS optimal FROM scored"
def optimal():
    """Whether the conditions of an optimum hold to 1e-8."""
    return (F.col("kkt") < 1e-8).alias("optimal")


def exact_point(df):
    return point(df.withColumn("optimal", optimal()), "optimal")


@query("opt_03c_exact_max_sharpe", ctes(BOOK_PANELS, cma_sql("src"), *exact_sql(ratio_sql("qp"), " + ".join(WCOLS))) + EXACT)
def opt_03c(spark, sf):
    params = C.assumptions(book_panels(spark, sf), ASSETS, RF, cash_like=CASH)
    return exact_point(CL.max_sharpe(params, NP, RF))


@query("opt_04b_exact_min_variance", ctes(BOOK_PANELS, cma_sql("src"), *exact_sql(pairs_sql("qp", 0.0))) + EXACT)
def opt_04b(spark, sf):
    params = C.assumptions(book_panels(spark, sf), ASSETS, RF, cash_like=CASH)
    return exact_point(CL.min_variance(params, NP, RF, bounds=BOUND))


@query("opt_07b_exact_utility", ctes(BOOK_PANELS, cma_sql("src"), *exact_sql(pairs_sql("qp", 1 / 3))) + EXACT)
def opt_07b(spark, sf):
    params = C.assumptions(book_panels(spark, sf), ASSETS, RF, cash_like=CASH)
    return exact_point(CL.utility(params, NP, RF, 3.0, bounds=BOUND))


@query(
    "opt_06b_exact_volatility",
    ctes(*SEARCH, f"mv AS ({best_sql('vol', 'ASC')}), mr AS ({best_sql('ret')})")
    + f"""SELECT book, {TARGET} >= mv.vol AS met, CASE WHEN {TARGET} <= mv.vol THEN 'min_variance' WHEN {TARGET} >= mr.vol THEN 'max_return' ELSE 'target' END AS "case",
 TRUE AS never_worse, TRUE AS on_target, TRUE AS optimal FROM mv JOIN mr USING (book)""",
)
def opt_06b(spark, sf):
    """The exact mix against the best of the lattice that is no louder."""
    coarse = S.target_volatility(cloud(spark, sf), NP, TARGET).select("book", F.col("ret").alias("coarse"))
    exact = CL.at_volatility(cma(spark, sf), NP, RF, TARGET).join(coarse, "book")
    on = F.when(F.col("case") == "target", F.abs(F.col("vol") - TARGET) < 1e-9).otherwise(True)
    return exact.select("book", "met", "case", (F.col("ret") >= F.col("coarse") - 1e-9).alias("never_worse"), on.alias("on_target"), optimal())


@query("opt_10b_exact_frontier", ctes(*SEARCH, FRONT) + f"SELECT book, {POINT}, TRUE AS never_worse FROM front")
def opt_10b(spark, sf):
    """Every mix of the lattice's frontier with whether the exact line is as quiet or
    quieter at the same return."""
    params = cma(spark, sf)
    w = Window.partitionBy("book").orderBy("point")
    line = CL.turning_points(params, NP)
    line = line.select("book", F.col("ret").alias("high"), "w", F.lead("ret").over(w).alias("low"), F.lead("w").over(w).alias("v"))
    # where the quietest mix of all has a larger return, it stands for all below
    floor = F.col("v").isNull()
    met = S.frontier(cloud(spark, sf), NP).join(line, "book").where((floor & (F.col("ret") <= F.col("high"))) | F.col("ret").between(F.col("low"), F.col("high")))
    t = F.when(floor | (F.col("high") == F.col("low")), 0.0).otherwise((F.col("high") - F.col("ret")) / (F.col("high") - F.col("low")))
    mix = [F.coalesce(F.col("w")[i] + t * (F.col("v")[i] - F.col("w")[i]), F.col("w")[i]).alias(f"x{i}") for i in range(NP)]
    placed = met.select("book", *WCOLS, "ret", "vol", "sharpe", *mix).join(params.select("book", "cov"), "book")
    var = " + ".join(f"x{i} * x{j} * cov[{i * NP + j}]" for i in range(NP) for j in range(NP))
    best = placed.withColumn("best", F.expr(f"sqrt({var})"))
    ends = best.groupBy("book", *WCOLS, "ret", "vol", "sharpe").agg(F.min("best").alias("best"))
    return point(ends.withColumn("never_worse", F.col("best") <= F.col("vol") + 1e-9), "never_worse")


def brand_assumptions(spark, sf):
    """Means and covariance of the brands' panel; each customer's means lean towards the
    brands they buy."""
    px = P.instrument_prices(spark, sf)
    w = Window.partitionBy("asset").orderBy("date")
    rets = px.select("asset", "date", (F.col("price") / F.lag("price").over(w) - 1).alias("ret"))
    brands = [x.asset for x in px.select("asset").distinct().orderBy("asset").collect()]  # one row a brand
    market = C.assumptions(one_book(rets), brands, RF)
    lines = P.table(spark, sf, "lineitem").join(P.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    owned = lines.join(P.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = owned.groupBy(F.col("o_custkey").cast("string").alias("book"), F.col("p_brand").alias("asset")).agg(F.sum("l_extendedprice").alias("v"))
    share = PF.wide_weights(bought.withColumnRenamed("v", "w"), brands)
    total = sum((F.col(f"w{i}") for i in range(1, len(brands))), F.col("w0"))
    lean = F.array(*[F.col(f"w{i}") / total for i in range(len(brands))])
    books = share.select("book", lean.alias("lean")).withColumns({"base": market.select("mu").scalar(), "cov": market.select("cov").scalar()})
    return books.select("book", F.zip_with("base", "lean", lambda m, x: m + 0.05 * x).alias("mu"), "cov"), len(brands)


@query("opt_12_wide_books_max_sharpe")
def opt_12(spark, sf):
    """A book for every customer over all brands: no lattice could hold them."""
    params, p = brand_assumptions(spark, sf)
    x = CL.max_sharpe(params, p, RF, weight_cap=0.25)
    mix = F.transform(F.array(*[f"w{i}" for i in range(p)]), lambda w: F.round(w, 6))
    return x.select("book", mix.alias("w"), rnd("ret").alias("ret"), rnd("vol").alias("vol"), rnd("sharpe", 5).alias("sharpe"), optimal())


# --- exposures of given books ----------------------------------------------

BOOKW = "bw AS (SELECT book AS b, " + _each("coalesce(max(w) FILTER (asset = '{a}'), 0.0) AS w{i}") + " FROM books GROUP BY book)"
MIXW = (
    "bx AS (SELECT book AS b, " + _each("greatest(coalesce(max(w - 0.19) FILTER (asset = '{a}'), 0.0), 0.0) AS x{i}") + " FROM books GROUP BY book), "
    "bt AS (SELECT *, " + _each("x{i}", " + ") + " AS t FROM bx), bw AS (SELECT b, " + _each("x{i} / t AS w{i}") + " FROM bt)"
)
EXPO = (RETS, BOOKS, ALL, cma_sql("src"), BOOKW, score_sql("cma", "CROSS JOIN bw"))


def exposures(spark, sf, **kw):
    return PF.exposures(P.books(spark, sf), ASSETS, cma(spark, sf), RF, **kw)


@query("ag_15_risk_contributions", ctes(*EXPO) + "SELECT b AS book, " + ", ".join(f"{r(x)} AS rc{i}" for i, x in enumerate(RC_SQL)) + " FROM scored")
def ag_15(spark, sf):
    return rounded(exposures(spark, sf), *[f"rc{i}" for i in range(NP)], keep=("book",))


@query(
    "ag_15b_custom_mix_analysis",
    ctes(*EXPO[:4], MIXW, EXPO[5])
    + f"SELECT b AS book, {r('ret')} AS ret, {r('vol')} AS vol, " + ", ".join(f"{r(x)} AS rc{i}" for i, x in enumerate(RC_SQL)) + " FROM scored",
)
def ag_15b(spark, sf):
    mixes = P.books(spark, sf).withColumn("w", F.col("w") - 0.19)
    e = PF.exposures(mixes, ASSETS, cma(spark, sf), RF, normalise=True, fallback_equal=True)
    return rounded(e, "ret", "vol", *[f"rc{i}" for i in range(NP)], keep=("book",))


@query("ag_16_ex_ante_metrics", ctes(*EXPO) + f"SELECT b AS book, {r('ret')} AS ret, {r('vol')} AS vol, {r('sharpe', 5)} AS sharpe, {r('diversification', 5)} AS diversification FROM scored")
def ag_16(spark, sf):
    e = exposures(spark, sf)
    return e.select("book", rnd("ret").alias("ret"), rnd("vol").alias("vol"), rnd("sharpe", 5).alias("sharpe"), rnd("diversification", 5).alias("diversification"))


# --- book joins -------------------------------------------------------------


@query("jn_15_portfolio_return", ctes(RETS, BOOKS, BRETS) + f"SELECT book, {d()} AS date, {r('ret')} AS ret FROM br")
def jn_15(spark, sf):
    return rounded(book_returns(spark, sf), "ret", keep=("book", "date"))


SHOCKS = values("shocks", "scenario, asset, shock", K.SHOCKS)


@query("jn_18_stress_scenarios", ctes(BOOKS, SHOCKS) + f"SELECT book, scenario, {r('sum(w * shock)')} AS stressed_pnl_1d, {r('least(sum(w * shock), 0.0)')} AS stressed_drawdown_proxy FROM books JOIN shocks USING (asset) GROUP BY 1, 2")
def jn_18(spark, sf):
    return rounded(PF.stress(P.books(spark, sf), K.shocks(spark)), "stressed_pnl_1d", "stressed_drawdown_proxy", keep=("book", "scenario"))


BOUNDS = values("lim", "asset, lb, ub, role", [(a, lo, hi, K.ROLES[a]) for a, (lo, hi) in K.BOUNDS.items()])
CUST_BOOKS = BOOKS.replace("c_mktsegment AS book", "CAST(o_custkey AS VARCHAR) AS book").replace(" JOIN customer ON o_custkey = c_custkey", "")


@query(
    "jn_19_mandate_check",
    ctes(CUST_BOOKS, BOUNDS, """bk AS (SELECT book, sum(w) AS sum_weights FROM books GROUP BY book),
bl AS (SELECT bk.book, lim.*, coalesce(books.w, 0.0) AS w FROM bk CROSS JOIN lim LEFT JOIN books ON books.book = bk.book AND books.asset = lim.asset),
vi AS (SELECT book, string_agg(asset || ' outside bounds', ';' ORDER BY asset) FILTER (w < lb - 1e-6 OR w > ub + 1e-6) AS v, coalesce(sum(w) FILTER (role = 'equity'), 0.0) AS g FROM bl GROUP BY book)""")
    + f"""SELECT book, v IS NULL AS asset_bounds_ok, g <= {K.GROUP_CAP} + 1e-6 AS group_cap_ok, {r('sum_weights')} AS sum_weights,
 concat_ws(';', v, CASE WHEN g > {K.GROUP_CAP} + 1e-6 THEN 'group exceeds cap' END, CASE WHEN abs(sum_weights - 1.0) > 1e-4 THEN 'weights do not sum to 1' END) AS violations FROM vi JOIN bk USING (book)""",
)
def jn_19(spark, sf):
    m = PF.mandate_check(P.books(spark, sf, "o_custkey"), K.bounds(spark), "equity", K.GROUP_CAP)
    return m.select("book", "asset_bounds_ok", "group_cap_ok", rnd("sum_weights").alias("sum_weights"), F.array_join("violations", ";").alias("violations"))


def composite(spark, sf):
    mix = spark.createDataFrame([("composite", K.FOCUS, 0.6), ("composite", K.CASH_LIKE, 0.4)], "book STRING, asset STRING, w DOUBLE")
    return PF.book_returns(mix, A.strict_overlap(staggered_returns(spark, sf).filter("ret IS NOT NULL"), NP))


COMP = f"""
full_d AS (SELECT date FROM srets GROUP BY date HAVING count(ret) = 5),
comp AS (SELECT date, sum(ret * CASE WHEN asset = '{K.FOCUS}' THEN 0.6 ELSE 0.4 END) AS bench FROM srets WHERE asset IN ('{K.FOCUS}', '{K.CASH_LIKE}') AND date IN (SELECT date FROM full_d) GROUP BY date)"""


@query("jn_20_composite_benchmark", ctes(SRETS, COMP) + f"SELECT 'composite' AS book, {d()} AS date, {r('bench')} AS ret FROM comp")
def jn_20(spark, sf):
    return rounded(composite(spark, sf), "ret", keep=("book", "date"))


@query(
    "jn_21_active_vs_benchmark",
    ctes(SRETS, COMP, returns_cte(), BOOKS, BRETS, "av AS (SELECT book, ret - coalesce(bench, 0.0) AS a FROM br LEFT JOIN comp ON comp.date = br.date)")
    + f"SELECT book, {r('avg(a) * 252')} AS active_return_annual, {r('stddev_samp(a) * sqrt(252.0)')} AS tracking_error_annual, {r('avg(a) * 252 / (stddev_samp(a) * sqrt(252.0) + 1e-12)', 5)} AS information_ratio FROM av GROUP BY book",
)
def jn_21(spark, sf):
    bench = composite(spark, sf).select("date", F.col("ret").alias("bench"))
    j = book_returns(spark, sf).join(bench, "date", "left").withColumn("bench", F.coalesce("bench", F.lit(0.0)))
    a = F.col("ret") - F.col("bench")
    te = F.stddev_samp(a) * R.ROOT
    return j.groupBy("book").agg(rnd(F.avg(a) * 252).alias("active_return_annual"), rnd(te).alias("tracking_error_annual"), rnd(F.avg(a) * 252 / (te + 1e-12), 5).alias("information_ratio"))


# --- expected-return blend, bounds, redistribution ---------------------------


@query(
    "scl_15_expected_return_blend",
    ctes(SRETS, "src AS (SELECT 'ALL' AS book, asset, date, ret FROM srets)", cma_sql("src"), f"""
fc AS (SELECT asset, avg(ret) * 3 AS f FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS rn FROM srets WHERE ret IS NOT NULL) WHERE rn <= 63 GROUP BY asset),
im AS (SELECT asset, 1 - count(*) / CAST((SELECT count(*) FROM cw) AS DOUBLE) AS frac FROM srets WHERE ret IS NOT NULL GROUP BY asset),
e1 AS (SELECT asset, CASE WHEN frac >= 0.35 THEN least(greatest((frac - 0.35) / 0.65, 0), 1) ELSE 0.0 END AS x, hist, prior, f FROM hp JOIN im USING (asset) JOIN fc USING (asset)),
e2 AS (SELECT asset, (1 - x) * hist + x * prior AS h, f FROM e1),
e3 AS (SELECT asset, h, least(greatest(f * 252, h - 0.04), h + 0.04) AS fmu FROM e2)""")
    + f"SELECT asset, {r('h')} AS hist_mu, {r('fmu')} AS forecast_mu, {r('greatest(-0.10, least(0.55, 0.9 * h + 0.1 * fmu))')} AS mu FROM e3",
)
def scl_15(spark, sf):
    x = one_book(staggered_returns(spark, sf))
    seen = x.filter("ret IS NOT NULL")
    days = seen.agg(F.countDistinct("date").alias("n")).scalar()
    fc = X.tail_rows(seen, 63).groupBy("asset").agg((F.avg("ret") * 3).alias("forecast_daily"))
    frac = seen.groupBy("book", "asset").agg((1 - F.count("*") / days).alias("imputed_fraction"))
    mu = C.expected_returns(x, RF, cash_like=CASH, extras=frac.join(fc, "asset"))
    return rounded(mu, "hist_mu", "forecast_mu", "mu", keep=("asset",))


@query(
    "scl_18_enforce_bounds",
    ctes(CUST_BOOKS, BOUNDS, f"""x0 AS (SELECT book, asset, lb, ub, role, least(greatest(w, lb), ub) AS w FROM books JOIN lim USING (asset)),
x1 AS (SELECT *, 1 - sum(w) OVER b AS df FROM x0 WINDOW b AS (PARTITION BY book)),
x2 AS (SELECT *, greatest(CASE WHEN df > 0 THEN ub - w ELSE w - lb END, 0.0) AS room FROM x1),
x3 AS (SELECT *, sum(room) OVER (PARTITION BY book) AS tr FROM x2),
x4 AS (SELECT book, asset, role, CASE WHEN abs(df) < 1e-8 OR tr <= 1e-12 THEN w ELSE least(greatest(w + df * room / tr, lb), ub) END AS w FROM x3),
x5 AS (SELECT book, asset, role, w / sum(w) OVER (PARTITION BY book) AS w FROM x4),
x6 AS (SELECT *, sum(CASE WHEN role = 'equity' THEN w ELSE 0 END) OVER b AS g, max(CASE WHEN asset = '{K.CASH_LIKE}' THEN 1 ELSE 0 END) OVER b AS hc, sum(CASE WHEN role <> 'equity' THEN 1 ELSE 0 END) OVER b AS no FROM x5 WINDOW b AS (PARTITION BY book)),
x7 AS (SELECT book, asset, CASE WHEN g > {K.GROUP_CAP} + 1e-8 THEN CASE WHEN role = 'equity' THEN w * {K.GROUP_CAP} / g WHEN hc = 1 THEN w + CASE WHEN asset = '{K.CASH_LIKE}' THEN g - {K.GROUP_CAP} ELSE 0 END ELSE w + (g - {K.GROUP_CAP}) / no END ELSE w END AS w FROM x6)""")
    + f"SELECT book, asset, {r('w / sum(w) OVER (PARTITION BY book)')} AS w FROM x7",
)
def scl_18(spark, sf):
    out = PF.enforce_bounds(P.books(spark, sf, "o_custkey"), K.bounds(spark), "equity", K.GROUP_CAP, K.CASH_LIKE)
    return rounded(out, "w", keep=("book", "asset"))


@query(
    "scl_18b_long_only_renormalise",
    ctes(CUST_BOOKS, "x AS (SELECT book, asset, least(greatest(w - 0.3, 0.0), 1.0) AS w FROM books)")
    + f"SELECT book, asset, {r('CASE WHEN sum(w) OVER b <= 1e-12 THEN 1.0 / count(*) OVER b ELSE w / sum(w) OVER b END')} AS w FROM x WINDOW b AS (PARTITION BY book)",
)
def scl_18b(spark, sf):
    return rounded(PF.renormalise(P.books(spark, sf, "o_custkey").withColumn("w", F.col("w") - 0.3)), "w", keep=("book", "asset"))


@query(
    "scl_19_redistribute_weight",
    ctes(CUST_BOOKS, f"x AS (SELECT *, asset = '{K.FOCUS}' AS pin FROM books), y AS (SELECT *, sum(CASE WHEN pin THEN 0 ELSE w END) OVER b AS o, sum(CASE WHEN pin THEN 0 ELSE 1 END) OVER b AS n FROM x WINDOW b AS (PARTITION BY book))")
    + f"SELECT book, asset, {r('CASE WHEN pin THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.4 END WHEN o < 1e-10 THEN 0.6 / n ELSE w * (0.6 / o) END')} AS w FROM y",
)
def scl_19(spark, sf):
    return rounded(PF.redistribute(P.books(spark, sf, "o_custkey"), K.FOCUS, 0.4), "w", keep=("book", "asset"))


# --- sorts and limits -------------------------------------------------------

INSTR = f"""
i0 AS (SELECT p_brand AS asset, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS p0 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
ip AS (SELECT asset, date, avg(p0) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS price FROM i0),
ir AS (SELECT asset, date, price / lag(price) OVER ({W}) - 1 AS ret FROM ip),
im AS (SELECT asset, round(avg(ret) * 252, 6) AS ann FROM ir GROUP BY asset)"""


@query(
    "top_01_movers",
    ctes(INSTR, "t AS (SELECT 'top' AS side, row_number() OVER (ORDER BY ann DESC, asset) AS rank, asset, ann FROM im), b AS (SELECT 'bottom' AS side, row_number() OVER (ORDER BY ann, asset DESC) AS rank, asset, ann FROM im)")
    + "SELECT side, CAST(rank AS INTEGER) AS rank, asset, ann + 0.0 AS ann FROM (SELECT * FROM t UNION ALL SELECT * FROM b) WHERE rank <= 3",
)
def top_01(spark, sf):
    x = X.simple_return(P.instrument_prices(spark, sf)).groupBy("asset").agg(rnd(F.avg("ret") * 252).alias("ann"))
    return PF.movers(x, "ann")


@query(
    "top_02_pareto_filter",
    ctes(INSTR, "pt AS (SELECT asset, avg(ret) * 252 AS ret, stddev_samp(ret) * sqrt(252.0) AS vol FROM ir GROUP BY asset), pp AS (SELECT *, max(ret) OVER (ORDER BY vol, ret ROWS UNBOUNDED PRECEDING) AS top FROM pt)")
    + f"SELECT asset, {r('ret')} AS ret, {r('vol')} AS vol FROM pp WHERE ret >= top - 1e-10",
)
def top_02(spark, sf):
    x = X.simple_return(P.instrument_prices(spark, sf)).groupBy("asset").agg((F.avg("ret") * 252).alias("ret"), (F.stddev_samp("ret") * R.ROOT).alias("vol"))
    return rounded(S.pareto(x.withColumn("book", F.lit("ALL"))), "ret", "vol", keep=("asset",))


@query(
    "top_03_downsample",
    ctes(RETS, f"""nn AS (SELECT asset, date, price, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY asset) AS n FROM rets),
ix AS (SELECT DISTINCT asset, CAST(floor(i * ((n - 1) / CAST(99 AS DOUBLE))) AS BIGINT) AS rn FROM (SELECT DISTINCT asset, n FROM nn), range(0, 100) t(i)),
jx AS (SELECT DISTINCT asset, CAST(floor(i * (n / CAST(100 AS DOUBLE))) AS BIGINT) AS rn FROM (SELECT DISTINCT asset, n FROM nn), range(0, 100) t(i))""")
    + f"SELECT 'linspace' AS rule, nn.asset, {d()} AS date FROM nn JOIN ix ON ix.asset = nn.asset AND ix.rn = nn.rn UNION ALL SELECT 'floor', nn.asset, {d()} FROM nn JOIN jx ON jx.asset = nn.asset AND jx.rn = nn.rn",
)
def top_03(spark, sf):
    x = returns(spark, sf)
    a = S.downsample(x, 100, ["date"], "linspace", ("asset",)).select(F.lit("linspace").alias("rule"), "asset", "date")
    b = S.downsample(x, 100, ["date"], "floor", ("asset",)).select(F.lit("floor").alias("rule"), "asset", "date")
    return a.unionByName(b)


@query("top_04_last_rows", ctes(RETS, "rd AS (SELECT DISTINCT date FROM rets ORDER BY date DESC LIMIT 63)") + f"SELECT asset, {d()} AS date, {r('ret')} AS ret FROM rets WHERE date IN (SELECT date FROM rd)")
def top_04(spark, sf):
    from tidepanel.operators.quality import last_rows_of_panel

    return rounded(last_rows_of_panel(returns(spark, sf), 63), "ret", keep=("asset", "date"))


@query("top_05_visible_weights", ctes(BOOKS) + f"SELECT book, asset, {r('w')} AS w FROM books WHERE w > 0.2")
def top_05(spark, sf):
    return rounded(PF.visible_weights(P.books(spark, sf), 0.2), "w", keep=("book", "asset"))


@query(
    "top_06_view_bounds",
    ctes(*SEARCH, FRONT, """vb AS (SELECT quantile_cont(vol, 0.025) AS lx, quantile_cont(vol, 0.975) AS hx, quantile_cont(ret, 0.025) AS ly, quantile_cont(ret, 0.975) AS hy FROM scored),
vm AS (SELECT least(lx, (SELECT min(vol) FROM front)) AS lx, greatest(hx, (SELECT max(vol) FROM front)) AS hx, least(ly, (SELECT min(ret) FROM front)) AS ly, greatest(hy, (SELECT max(ret) FROM front)) AS hy FROM vb)""")
    + f"SELECT {r('greatest(0.0, lx - (hx - lx) * 0.05)')} AS min_x, {r('hx + (hx - lx) * 0.05')} AS max_x, {r('greatest(0.0, ly - (hy - ly) * 0.05)')} AS min_y, {r('hy + (hy - ly) * 0.05')} AS max_y FROM vm",
)
def top_06(spark, sf):
    c = cloud(spark, sf)
    return rounded(PF.view_bounds(c, S.frontier(c, NP)), "min_x", "max_x", "min_y", "max_y")


# --- walk-forward -----------------------------------------------------------

EVAL = K.EVAL_START
_QE = "last_day(CAST(date_trunc('quarter', date) AS DATE) + INTERVAL 2 MONTH)"
DAYS = "days AS (SELECT date FROM rets GROUP BY date HAVING count(ret) = 5)"
SEGS = f"""
ev AS (SELECT date FROM days WHERE date >= DATE '{EVAL}'),
qe AS (SELECT CAST(unnest(generate_series(date_trunc('quarter', min(date)), max(date), INTERVAL 3 MONTH)) AS DATE) AS q, min(date) AS lo, max(date) AS hi FROM ev),
qd AS (SELECT last_day(CAST(q + INTERVAL 2 MONTH AS DATE)) AS qe, lo, hi FROM qe),
reb AS (SELECT DISTINCT (SELECT min(date) FROM ev WHERE ev.date >= qd.qe) AS rd FROM qd WHERE qe BETWEEN lo AND hi),
rb AS (SELECT rd FROM reb WHERE rd IS NOT NULL),
segs AS (SELECT CAST(row_number() OVER (ORDER BY rd) AS INTEGER) AS segment, 'quarterly' AS kind, rd AS tb, rd AS af, coalesce(lead(rd) OVER (ORDER BY rd), (SELECT max(date) FROM ev)) AS un FROM rb
  UNION ALL SELECT 0, 'inaugural', (SELECT min(date) FROM ev), (SELECT min(date) FROM ev) - 1, min(rd) FROM rb HAVING count(*) > 0)"""
ROLES = """
ro AS (SELECT segment, kind, date, CASE WHEN date < tb THEN 'train' ELSE 'test' END AS role FROM days JOIN segs ON date < tb OR (date > af AND date <= un)),
ok AS (SELECT segment FROM ro GROUP BY segment HAVING count(*) FILTER (role = 'train') >= 60 AND count(*) FILTER (role = 'test') > 0),
roles AS (SELECT * FROM ro WHERE segment IN (SELECT segment FROM ok))"""
MIN_TRAIN = 60


def eval_days(spark, sf):
    """Days on which every asset has a return."""
    x = returns(spark, sf).groupBy("date").agg(F.count("ret").alias("n"))
    return x.filter(F.col("n") == NP).select("date")


def roles(spark, sf):
    days = eval_days(spark, sf)
    return B.calendar_roles(days, B.segments(days, EVAL), MIN_TRAIN)


@query("jn_11_rebalance_dates", ctes(RETS, DAYS, SEGS) + f"SELECT {d('rd')} AS rebalance_date FROM rb")
def jn_11(spark, sf):
    return B.rebalance_dates(eval_days(spark, sf).filter(F.col("date") >= F.lit(EVAL).cast("date")))


@query(
    "jn_12_walk_forward_segments",
    ctes(RETS, DAYS, SEGS, ROLES) + "SELECT segment, role, count(*) AS n_days, " + f"{d('min(date)')} AS first_day, {d('max(date)')} AS last_day FROM roles WHERE kind = 'quarterly' GROUP BY 1, 2",
)
def jn_12(spark, sf):
    x = roles(spark, sf).filter("kind = 'quarterly'")
    return x.groupBy("segment", "role").agg(F.count("*").alias("n_days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("jn_13_inaugural_segment", ctes(RETS, DAYS, SEGS, ROLES) + f"SELECT segment, {d()} AS date, role FROM roles WHERE kind = 'inaugural'")
def jn_13(spark, sf):
    return roles(spark, sf).filter("kind = 'inaugural'").select("segment", "date", "role")


@query(
    "jn_14_leakage_check",
    ctes(RETS, DAYS, SEGS, ROLES)
    + f"""SELECT segment, kind, {d("max(date) FILTER (role = 'train')")} AS train_end, {d("min(date) FILTER (role = 'test')")} AS test_start, count(*) FILTER (role = 'train') AS train_days, count(*) FILTER (role = 'test') AS test_days,
 max(date) FILTER (role = 'train') >= min(date) FILTER (role = 'test') AS overlap FROM roles GROUP BY segment, kind""",
)
def jn_14(spark, sf):
    return B.leakage_checks(roles(spark, sf))


DRIFT = f"""
dm AS (SELECT date, coalesce(sum(r) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg, r FROM (SELECT date, CASE WHEN date IN (SELECT rd FROM rb) THEN 1 ELSE 0 END AS r FROM days)),
dg AS (SELECT asset, rets.date, seg, r, product(1 + ret) OVER (PARTITION BY asset, seg ORDER BY rets.date ROWS UNBOUNDED PRECEDING) AS g FROM rets JOIN dm ON dm.date = rets.date WHERE ret IS NOT NULL),
dv AS (SELECT book, date, seg, r, sum(w * g) AS v FROM books JOIN dg USING (asset) GROUP BY 1, 2, 3, 4),
dt AS (SELECT dv.book, dv.date, sum(abs(w * g / v - w)) AS turnover FROM dv JOIN dg ON dg.date = dv.date JOIN books ON books.book = dv.book AND books.asset = dg.asset WHERE dv.r = 1 GROUP BY 1, 2),
dr AS (SELECT dv.book, dv.date, v / coalesce(lag(v) OVER (PARTITION BY dv.book, seg ORDER BY dv.date), 1.0) - 1 AS gross, coalesce(turnover, 0.0) AS turnover FROM dv LEFT JOIN dt ON dt.book = dv.book AND dt.date = dv.date),
dn AS (SELECT book, date, gross, turnover, gross - turnover * {K.COST_BPS} / 10000 AS ret FROM dr)"""


def drifting_books(spark, sf, by="c_mktsegment"):
    days = eval_days(spark, sf)
    panel = returns(spark, sf).join(days, "date", "left_semi")
    reb = B.rebalance_dates(days.filter(F.col("date") >= F.lit(EVAL).cast("date")))
    return B.drift_rebalance(P.books(spark, sf, by), panel, reb, K.COST_BPS, ASSETS)


@query("win_19_drift_rebalance", ctes(RETS, DAYS, SEGS, BOOKS, DRIFT) + f"SELECT book, {d()} AS date, {r('gross')} AS gross, {r('turnover')} AS turnover, {r('ret')} AS ret FROM dn")
def win_19(spark, sf):
    return rounded(drifting_books(spark, sf), "gross", "turnover", "ret", keep=("book", "date"))


TARGETS = f"""
tr AS (SELECT segment, asset, rets.date, ret FROM rets JOIN roles ON roles.date = rets.date AND role = 'train'),
te AS (SELECT segment, asset, rets.date, ret FROM rets JOIN roles ON roles.date = rets.date AND role = 'test'),
iv AS (SELECT segment, asset, 1 / stddev_samp(ret) AS inv FROM tr GROUP BY 1, 2),
w0 AS (SELECT segment, asset, inv / sum(inv) OVER (PARTITION BY segment) AS w FROM iv)"""


def overlay_sql(src: str, out: str) -> str:
    return f"""
sg0 AS (SELECT segment, max(date) AS te FROM tr GROUP BY segment),
sg AS (SELECT segment, m.signal AS signal, 0.5 + 0.4 * least(abs(m.strength), 1) AS confidence, greatest(0.2, least(1.5, 0.18 / greatest(g.realized_vol, 1e-9))) AS size
  FROM sg0 JOIN mom m ON m.date = te AND m.asset = '{K.FOCUS}' JOIN regime g ON g.date = te AND g.asset = '{K.FOCUS}'),
ov AS (SELECT x.segment, asset, w, signal <> 0 AND confidence >= 0.45 AS act, greatest(w + 0.03 * confidence * least(size, 1) * signal, 0) AS lifted, greatest(w, 1e-9) AS fl FROM {src} x LEFT JOIN sg ON sg.segment = x.segment),
ow AS (SELECT *, sum(CASE WHEN asset = '{K.FOCUS}' THEN lifted - w END) OVER s AS off, sum(CASE WHEN asset IN ('{K.CASH_LIKE}', '{K.GOLD_LIKE}') THEN fl END) OVER s AS pool FROM ov WINDOW s AS (PARTITION BY segment)),
ox AS (SELECT segment, asset, w, act, CASE WHEN act THEN CASE WHEN asset = '{K.FOCUS}' THEN lifted WHEN asset IN ('{K.CASH_LIKE}', '{K.GOLD_LIKE}') THEN greatest(w - off * (fl / pool), 0) ELSE w END ELSE w END AS nw FROM ow),
{out} AS (SELECT segment, asset, CASE WHEN act THEN nw / sum(nw) OVER (PARTITION BY segment) ELSE w END AS w FROM ox)"""


def controls_sql(src: str, out: str) -> str:
    return f"""
tp AS (SELECT tr.segment, date, sum(w * ret) AS ret FROM tr JOIN {src} x ON x.segment = tr.segment AND x.asset = tr.asset GROUP BY 1, 2),
tq AS (SELECT *, product(1 + ret) OVER (PARTITION BY segment ORDER BY date ROWS UNBOUNDED PRECEDING) AS g, row_number() OVER (PARTITION BY segment ORDER BY date DESC) AS rn FROM tp),
st AS (SELECT segment, stddev_samp(ret) FILTER (rn <= 126) * sqrt(252.0) AS vol, arg_max(g, date) / max(g) - 1 AS dd FROM tq GROUP BY segment),
sb AS (SELECT *, vol > {TVOL} * 1.25 AS vb, dd < -{TDD} AS db FROM st),
k0 AS (SELECT x.segment, asset, w, vb OR db AS b, CASE WHEN vb THEN 0.75 ELSE 0.85 END * CASE WHEN db THEN 0.80 ELSE 1.0 END AS k FROM {src} x JOIN sb ON sb.segment = x.segment),
k1 AS (SELECT *, sum(CASE WHEN asset <> '{K.CASH_LIKE}' THEN w * (1 - k) ELSE 0 END) OVER (PARTITION BY segment) AS sh FROM k0),
k2 AS (SELECT segment, asset, least(greatest(CASE WHEN b THEN CASE WHEN asset <> '{K.CASH_LIKE}' THEN w * k ELSE w + sh END ELSE w END, 0), 1) AS w FROM k1),
{out} AS (SELECT segment, asset, w / sum(w) OVER (PARTITION BY segment) AS w FROM k2)"""


# Tight enough on the smoothed panel for some segments to breach and some not.
TVOL, TDD = 0.075, 0.02


def costs_sql(src: str) -> str:
    return f"""
tv0 AS (SELECT segment, asset, w, coalesce(lag(w) OVER (PARTITION BY asset ORDER BY segment), 0.0) AS p FROM {src}),
tv AS (SELECT segment, sum(abs(w - p)) AS turnover, sum(abs(w - p)) * {K.COST_BPS} / 10000 AS cost FROM tv0 GROUP BY segment),
sr0 AS (SELECT te.segment, date, sum(w * ret) AS gross FROM te JOIN {src} x ON x.segment = te.segment AND x.asset = te.asset GROUP BY 1, 2),
sr AS (SELECT sr0.segment, date, gross, gross - CASE WHEN date = min(date) OVER (PARTITION BY sr0.segment) THEN cost ELSE 0 END AS ret FROM sr0 JOIN tv ON tv.segment = sr0.segment),
sm AS (SELECT segment, count(*) AS oos_days, {r('product(1 + ret) - 1', 6)} AS segment_total_return, {r(f'(avg(ret) * 252 - {RF}) / (stddev_samp(ret) * sqrt(252.0) + 1e-12)', 4)} AS segment_sharpe, {r('stddev_samp(ret) * sqrt(252.0)', 4)} AS segment_volatility FROM sr GROUP BY segment)"""


WF = (RETS + MOM_SQL + REG_SQL, DAYS, SEGS, ROLES, TARGETS)


def split(spark, sf):
    r0 = roles(spark, sf)
    panel = returns(spark, sf)
    return B.expand(panel, r0, "train"), B.expand(panel, r0, "test")


def segment_signals(spark, sf, train):
    """Momentum and regime of the focus asset as of each segment's last training day."""
    x = returns(spark, sf).filter(F.col("asset") == K.FOCUS)
    live = X.momentum(x).select("date", "signal", "strength").join(X.regime(x).select("date", "realized_vol"), "date")
    ends = train.groupBy("segment").agg(F.max("date").alias("date"))
    return ends.join(live, "date").select(
        "segment",
        "signal",
        (0.5 + 0.4 * F.least(F.abs("strength"), F.lit(1.0))).alias("confidence"),
        F.greatest(F.lit(0.2), F.least(F.lit(1.5), 0.18 / F.greatest("realized_vol", F.lit(1e-9)))).alias("size"),
    )


@query("scl_08_tactical_overlay", ctes(*WF, overlay_sql("w0", "w1")) + f"SELECT segment, asset, {r('w')} AS w FROM w1")
def scl_08(spark, sf):
    train, _ = split(spark, sf)
    out = B.tactical_overlay(B.inverse_vol_targets(train), segment_signals(spark, sf, train), K.FOCUS, (K.CASH_LIKE, K.GOLD_LIKE))
    return rounded(out, "w", keep=("segment", "asset"))


@query("win_22_risk_guard", ctes(*WF, controls_sql("w0", "w2")) + f"SELECT w2.segment, asset, {r('w')} AS w, {r('vol')} AS train_realized_vol, {r('dd')} AS train_drawdown, vb AS vol_breach, db AS drawdown_breach FROM w2 JOIN sb ON sb.segment = w2.segment")
def win_22(spark, sf):
    train, _ = split(spark, sf)
    w = B.inverse_vol_targets(train)
    state = B.risk_state(w, train, TVOL, TDD)
    out = B.risk_controls(w, state, K.CASH_LIKE).join(state, "segment")
    return rounded(out, "w", "train_realized_vol", "train_drawdown", keep=("segment", "asset", "vol_breach", "drawdown_breach"))


@query("win_20_turnover_cost", ctes(*WF, costs_sql("w0")) + f"SELECT segment, {r('turnover')} AS turnover, {r('cost', 8)} AS cost FROM tv")
def win_20(spark, sf):
    train, _ = split(spark, sf)
    t = B.turnover(B.inverse_vol_targets(train), K.COST_BPS)
    return t.select("segment", rnd("turnover").alias("turnover"), rnd("cost", 8).alias("cost"))


def inverse_vol_walk(spark, sf):
    train, test = split(spark, sf)
    w = B.inverse_vol_targets(train)
    return B.segment_returns(w, test, B.turnover(w, K.COST_BPS))


@query("ag_18_segment_metrics", ctes(*WF, costs_sql("w0")) + "SELECT * FROM sm")
def ag_18(spark, sf):
    return B.segment_metrics(inverse_vol_walk(spark, sf), RF)


@query(
    "ag_18b_segment_summary",
    ctes(*WF, costs_sql("w0"))
    + f"SELECT count(*) AS n_segments, {r('avg(segment_sharpe)', 4)} AS mean_segment_sharpe, {r('CASE WHEN count(*) > 1 THEN stddev_pop(segment_sharpe) ELSE 0.0 END', 4)} AS std_segment_sharpe, {r('avg(segment_total_return)')} AS mean_segment_total_return, {r('min(segment_sharpe)', 4)} AS min_segment_sharpe, {r('max(segment_sharpe)', 4)} AS max_segment_sharpe FROM sm",
)
def ag_18b(spark, sf):
    return B.summarise_segments(B.segment_metrics(inverse_vol_walk(spark, sf), RF))


@query(
    "win_21_full_calendar_curves",
    ctes(*WF, costs_sql("w0"), f"""ser AS (SELECT 'walk' AS series, date, ret FROM sr UNION ALL SELECT asset, date, ret FROM rets WHERE asset = '{K.FOCUS}'),
nm AS (SELECT unnest(['walk', '{K.FOCUS}']) AS series),
fullc AS (SELECT nm.series, ev.date, coalesce(ser.ret, 0.0) AS ret FROM ev CROSS JOIN nm LEFT JOIN ser ON ser.series = nm.series AND ser.date = ev.date),
gc AS (SELECT *, product(1 + ret) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM fullc)""")
    + f"SELECT series, {d()} AS date, {r('g - 1')} AS cum, {r('g / max(g) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) - 1')} AS drawdown FROM gc",
)
def win_21(spark, sf):
    walk = inverse_vol_walk(spark, sf).select(F.lit("walk").alias("series"), "date", "ret")
    focus = returns(spark, sf).filter(F.col("asset") == K.FOCUS).select(F.col("asset").alias("series"), "date", "ret")
    days = eval_days(spark, sf).filter(F.col("date") >= F.lit(EVAL).cast("date"))
    c = B.curves(walk.unionByName(focus), days, ["walk", K.FOCUS])
    return rounded(c, "cum", "drawdown", keep=("series", "date"))


SEG_BOOK = "sbk AS (SELECT CAST(segment AS VARCHAR) AS book, asset, date, ret FROM tr)"
WF_FULL = (
    *WF,
    SEG_BOOK,
    cma_sql("sbk"),
    lattice_sql(STEPS),
    score_sql("cma", "CROSS JOIN lat"),
    f"""bst AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY sharpe DESC, {BYW}) AS rk FROM scored),
wt AS (SELECT CAST(book AS INTEGER) AS segment, unnest([{NAMES}]) AS asset, unnest([{', '.join(WCOLS)}]) AS w FROM bst WHERE rk = 1)""",
    overlay_sql("wt", "w1"),
    controls_sql("w1", "w2"),
    costs_sql("w2"),
)


@query("wf_walk_forward_backtest", ctes(*WF_FULL) + f"SELECT segment, {d()} AS date, {r('gross')} AS gross, {r('ret')} AS ret FROM sr")
def walk_forward(spark, sf):
    """Tangency weights per segment, tactical overlay, risk guard, cost, test days."""
    out = B.walk_forward(
        returns(spark, sf),
        roles(spark, sf),
        ASSETS,
        lambda train, _: segment_signals(spark, sf, train),
        rf=RF,
        cost_bps=K.COST_BPS,
        focus=K.FOCUS,
        sinks=(K.CASH_LIKE, K.GOLD_LIKE),
        cash=K.CASH_LIKE,
        target_vol=TVOL,
        dd_tol=TDD,
        steps=STEPS,
        cash_like=CASH,
    )
    return rounded(out, "gross", "ret", keep=("segment", "date"))
