"""Resampled risk: block bootstrap and fat-tailed parametric paths, per book.

Paths are made where they are used. ``bootstrap_outcomes`` folds a path over its blocks
in place: what a block of history does to wealth and drawdown is worked out once per
starting day, so a path is one row and none of its days exist. ``bootstrap_paths`` and
``parametric_paths`` give the days themselves; each (book, path) pair is placed once and
fans out in place, so compounding and drawdown need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.draws import box_muller, mix, mix_lambda, with_uniforms
from tidepanel.functions.expr import AF
from tidepanel.session import small_side, stage

HORIZON = 252
PATHS = 5000
FLOOR = 1e-9
# Paths that a book's history is handed out for at a time.
PATHS_A_ROW = 1024
BINS = 4096


def _path_rows(books: DataFrame, paths: int) -> DataFrame:
    ids = F.explode(F.sequence(F.lit(1), F.lit(paths))).alias("path")
    return books.select("*", ids).repartition("book", "path")


def bootstrap_paths(daily: DataFrame, paths: int = PATHS, horizon: int = HORIZON, block: int = 10, seed: int = 8, min_rows: int = 30) -> DataFrame:
    """(book, path, day, ret): blocks of consecutive history rows drawn with
    replacement. Books with no more than ``min_rows`` rows are not resampled."""
    w = Window.partitionBy("book")
    rows = daily.filter("ret IS NOT NULL").select(
        "book",
        (F.row_number().over(w.orderBy("date")) - 1).alias("idx"),
        F.count("*").over(w).alias("n"),
        "ret",
    )
    history = small_side(rows, "history")
    usable = history.filter((F.col("n") > min_rows) & (F.col("n") >= block + 5)).select("book", "n").distinct()
    n_blocks = -(-horizon // block)
    x = _path_rows(usable, paths).withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    x = x.withColumn("start", mix(F.col("path"), F.col("blk"), seed) % (F.col("n") - block + 1))
    x = x.withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    x = x.withColumns({"day": F.col("blk") * block + F.col("off"), "idx": (F.col("start") + F.col("off")).cast("int")})
    return x.filter(F.col("day") < horizon).join(history.select("book", "idx", "ret"), ["book", "idx"]).select("book", "path", "day", "ret")


def _block_table(length: int) -> str:
    """What every block of ``length`` days does, by its first day: its growth, the highest
    and lowest wealth on the way and the deepest drawdown, from a wealth of 1."""
    step = (
        "aggregate(slice(rets, i + 1, {n}), named_struct('g', 1D, 'peak', 1E-300D, 'low', double('Infinity'), 'dd', 0D), (s, r) -> "
        "named_struct('g', s.g * (1 + r), 'peak', greatest(s.peak, s.g * (1 + r)), 'low', least(s.low, s.g * (1 + r)), "
        "'dd', least(s.dd, s.g * (1 + r) / greatest(s.peak, s.g * (1 + r)) - 1)))"
    )
    return f"transform(sequence(0, n - {{block}}), i -> {step.format(n=length)})"


def bootstrap_outcomes(daily: DataFrame, paths: int = PATHS, horizon: int = HORIZON, block: int = 10, seed: int = 8, min_rows: int = 30) -> DataFrame:
    """(book, path, terminal, max_drawdown, days): the outcomes of ``bootstrap_paths``, by
    folding whole blocks.

    Drawdown is a minimum of ratios, so a block adds its own deepest one and its lowest
    wealth against the peak before it. Where a path's wealth falls to the floor, that path
    is followed day by day. A book's history is one row of arrays, no longer than the
    calendar, and is sent out once per ``PATHS_A_ROW`` paths, so a book may have any number
    of paths. Books with no more than ``min_rows`` rows have no outcomes.
    """
    n_blocks = -(-horizon // block)
    rest = horizon - (n_blocks - 1) * block
    rows = daily.filter("ret IS NOT NULL AND book IS NOT NULL").groupBy("book").agg(F.sort_array(F.collect_list(F.struct("date", "ret"))).alias("x"))
    rows = rows.selectExpr("book", "transform(x, d -> d.ret) AS rets", "size(x) AS n").filter((F.col("n") > min_rows) & (F.col("n") >= block + 5))
    # arrays of plain numbers: a row stays a few times the size of the history
    rows = rows.selectExpr("*", f"{_block_table(block).format(block=block)} AS whole", f"{_block_table(rest).format(block=block)} AS last")
    parts = [f"{t}.{c} AS {t}_{c}" for t in ("whole", "last") for c in ("g", "peak", "low", "dd")]
    history = stage(rows.selectExpr("book", "rets", "n", *parts), "history")
    deal = F.explode(F.sequence(F.lit(0), F.lit((paths - 1) // PATHS_A_ROW))).alias("part")
    dealt = history.select("*", deal).repartition("book", "part") if paths > 0 else history.select("*", F.lit(0).alias("part")).limit(0)
    numbers = f"sequence(part * {PATHS_A_ROW} + 1, least((part + 1) * {PATHS_A_ROW}, {paths}))"
    start = f"int({mix_lambda('path', 'b', seed)} % (n - {block} + 1))"
    at = lambda c: f"IF(b = {n_blocks - 1}, last_{c}, whole_{c})[at]"
    # let-bindings: an array of one, transformed
    fold = (
        f"aggregate(sequence(0, {n_blocks - 1}), named_struct('g', 1D, 'peak', {FLOOR}D, 'low', double('Infinity'), 'dd', 0D), (s, b) -> "
        f"transform(array({start}), at -> named_struct('g', s.g * {at('g')}, 'peak', greatest(s.peak, s.g * {at('peak')}), "
        f"'low', least(s.low, s.g * {at('low')}), 'dd', least(s.dd, {at('dd')}, IF(b = 0, 0D, s.g * {at('low')} / s.peak - 1))))[0])"
    )
    days = f"flatten(transform(sequence(0, {n_blocks - 1}), b -> slice(rets, {start} + 1, IF(b = {n_blocks - 1}, {rest}, {block}))))"
    stepped = (
        f"aggregate({days}, named_struct('g', 1D, 'peak', {FLOOR}D, 'low', 0D, 'dd', 0D), (s, r) -> transform(array(s.g * (1 + r)), g -> "
        f"named_struct('g', g, 'peak', greatest(s.peak, g), 'low', 0D, 'dd', least(s.dd, greatest(g, {FLOOR}D) / greatest(s.peak, g) - 1)))[0])"
    )
    outcome = f"transform(array({fold}), s -> IF(s.low >= {FLOOR}D, s, {stepped}))[0]"
    found = f"inline(transform({numbers}, path -> transform(array({outcome}), s -> named_struct('path', path, 's', s))[0]))"
    return dealt.selectExpr("book", found).select(
        "book",
        "path",
        F.greatest("s.g", F.lit(FLOOR)).alias("terminal"),
        F.col("s.dd").alias("max_drawdown"),
        F.lit(horizon).cast("long").alias("days"),
    )


def parametric_paths(books: DataFrame, paths: int = PATHS, horizon: int = HORIZON, df: int | None = 6, seed: int = 7) -> DataFrame:
    """(book, path, day, ret) for books given by annual ``ret`` and ``vol``.

    Daily asset returns are multivariate Student-t with the annual covariance / 252.
    A book is a linear combination of them, which is again Student-t with the book's
    own mean and variance, so one draw per day and book is the same law as drawing
    every asset. The scale keeps the variance exact; ``df=None`` is Gaussian. ``df``
    must be even: chi-square is then a sum of exponentials.
    """
    x = _path_rows(books.select("book", F.col("ret").alias("m"), F.col("vol").alias("s")), paths)
    x = x.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    if df is not None and (df <= 2 or df % 2):
        raise ValueError("df must be an even number above 2")
    half = 0 if df is None else df // 2
    ids = F.col("path"), F.col("day"), seed
    x = with_uniforms(x, {f"u{k}": (*ids, k) for k in (1, 2, *range(10, 10 + half))})
    z = box_muller(F.col("u1"), F.col("u2"))
    if half:
        chi2 = -2.0 * sum((F.log(F.col(f"u{10 + k}")) for k in range(1, half)), F.log(F.col("u10")))
        z = z * F.sqrt(F.lit(float(df - 2)) / F.greatest(chi2, F.lit(1e-12)))
    r = F.col("m") / AF + F.col("s") / F.sqrt(F.lit(float(AF))) * z
    return x.select("book", "path", "day", r.alias("ret"))


def path_outcomes(paths: DataFrame) -> DataFrame:
    """Terminal wealth and maximum drawdown of every path."""
    w = Window.partitionBy("book", "path").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    x = paths.withColumn("g", F.greatest(F.product(1 + F.col("ret")).over(w), F.lit(FLOOR)))
    x = x.withColumn("dd", F.col("g") / F.max("g").over(w) - 1)
    return x.groupBy("book", "path").agg(
        F.max_by("g", "day").alias("terminal"), F.min("dd").alias("max_drawdown"), F.count("*").alias("days")
    )


def quantiles(rows: DataFrame, key: str, wanted: dict[str, list[float]], levels: int = 1) -> DataFrame:
    """Exact quantiles, linear between neighbours: one row per ``key``, a column of each
    name of ``wanted`` holding the array of its shares. Nulls do not count.

    Equal bins between the smallest and largest value are counted; the bins that hold a
    sought rank are cut again between their own ends for every further level, and only the
    values of the last bins with a sought rank are ranked, as counts of different values.
    All counts begin inside the map tasks, so no task sees all rows of a key. ``rows`` is
    read ``levels`` + 2 times and should be a written table. The tables of bins have some
    rows per key and are left to the planner, which knows their written size.
    """
    order = list(enumerate(wanted))
    values = F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in order])
    inside = rows.select(key, F.inline(values)).filter("v IS NOT NULL")
    ends = stage(inside.groupBy(key, "m").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")), "ends")
    shares = F.array(*[F.array(*[F.lit(float(p)) for p in wanted[c]]) for _, c in order])
    place = F.col("p") * (F.col("n") - 1)
    ranks = ends.select("*", F.posexplode(F.get(shares, F.col("m"))).alias("j", "p")).select(
        key, "m", "lo", "hi", "j", (place - F.floor(place)).alias("part"),
        F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank"),
    )
    sought, bins = ranks.select(key, "m", "lo", "hi", "rank", F.lit(0).cast("long").alias("before")).distinct(), ends.select(key, "m", "lo", "hi")
    # the largest value may round up to a bin of its own: the last one takes it
    slot = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
    slot = F.when(F.col("hi") > F.col("lo"), slot).otherwise(0)

    def holding(counted: DataFrame, by: str) -> DataFrame:
        """The sought ranks with the bin or value of ``counted`` that holds them."""
        past = Window.partitionBy(key, "m", "lo", "hi").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        x = sought.join(counted.withColumn("less", F.coalesce(F.sum("c").over(past), F.lit(0))), [key, "m", "lo", "hi"])
        x = x.withColumn("first", F.col("before") + F.col("less"))
        return x.filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("c")))

    for level in range(levels):
        # bins of a key and measure hold disjoint values: each value meets one of them
        cut = inside.join(bins, [key, "m"]).filter("v BETWEEN lo AND hi").withColumn("slot", slot)
        counted = cut.groupBy(key, "m", "lo", "hi", "slot").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        found = holding(counted, "slot").select(key, "m", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("first").alias("before"))
        sought = stage(found, f"bins-{level}")
        bins = sought.select(key, "m", "lo", "hi").distinct()
    same = inside.join(bins, [key, "m"]).filter("v BETWEEN lo AND hi").groupBy(key, "m", "lo", "hi", "v").agg(F.count("*").alias("c"))
    at = holding(same, "v").select(key, "m", "rank", "v")
    each = ranks.join(at, [key, "m", "rank"]).groupBy(key, "m", "j").agg(
        (F.min_by("v", "rank") + F.first("part") * (F.max_by("v", "rank") - F.min_by("v", "rank"))).alias("q")
    )
    columns = [F.transform(F.sort_array(F.collect_list(F.when(F.col("m") == i, F.struct("j", "q")))), lambda x: x["q"]).alias(c) for i, c in order]
    return each.groupBy(key).agg(*columns)


def summarise(outcomes: DataFrame, target_drawdown: float = -0.20) -> DataFrame:
    """Distribution of the outcomes, with exact quantiles; a book may have any number of
    paths. The outcomes are written once and read by every pass."""
    t, d = F.col("terminal"), F.col("max_drawdown")
    cagr = F.pow(t, AF / F.col("days")) - 1
    x = stage(outcomes.select("book", "terminal", "max_drawdown", cagr.alias("cagr"), (1 - t).alias("loss")), "outcomes")
    q = quantiles(x, "book", {"terminal": [0.5], "cagr": [0.05, 0.25, 0.5, 0.75, 0.95], "loss": [0.95, 0.99], "max_drawdown": [0.05]})
    q = q.select("book", *[F.col(c).alias(f"q_{c}") for c in ("terminal", "cagr", "loss", "max_drawdown")])
    v95, v99 = F.col("q_loss")[0], F.col("q_loss")[1]
    c = lambda k: F.first("q_cagr")[k]
    return x.join(q, "book").groupBy("book").agg(
        F.count("*").alias("simulations"),
        F.avg(t).alias("expected_terminal_wealth"),
        F.first("q_terminal")[0].alias("median_terminal_wealth"),
        c(2).alias("expected_cagr"),
        c(0).alias("cagr_5"),
        c(1).alias("cagr_25"),
        c(3).alias("cagr_75"),
        c(4).alias("cagr_95"),
        F.avg((t < 1.0).cast("double")).alias("downside_probability"),
        F.first(v95).alias("var_95_annual"),
        F.avg(F.when(F.col("loss") >= v95, F.col("loss"))).alias("cvar_95_annual"),
        F.first(v99).alias("var_99_annual"),
        F.avg(F.when(F.col("loss") >= v99, F.col("loss"))).alias("cvar_99_annual"),
        F.avg(d).alias("expected_max_drawdown"),
        F.first("q_max_drawdown")[0].alias("worst_max_drawdown"),
        F.avg((d < target_drawdown).cast("double")).alias("target_breach_probability"),
    )
