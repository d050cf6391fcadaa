"""Books of weights: returns, exposures, mandate checks, bounds, stress."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.expr import AF, clip, finite, rnd
from tidepanel.operators import search
from tidepanel.operators.align import MAX_WIDE_ASSETS, wide
from tidepanel.session import small_side, stage

# Calendar days of at most MAX_WIDE_ASSETS numbers that may be sent to every task (64 MB).
BROADCAST_DAYS = 1 << 17


def _book():
    return Window.partitionBy("book")


def book_returns(weights: DataFrame, returns: DataFrame, assets: Sequence[str] | None = None) -> DataFrame:
    """Sum of weight x return per (book, date); missing weights and returns count 0.

    With a known, narrow universe every book is one wide row that unfolds the panel's
    days in place: no join and no shuffle beyond the one that gathers a book. For
    wider universes the weights are clustered by book and the panel is broadcast if
    it is small, so the per-(book, date) sum needs no further shuffle either.
    """
    if assets is not None and len(assets) <= MAX_WIDE_ASSETS:
        x = unfold(wide_weights(weights, assets), _panel_days(returns, assets), "block", "days")
        return x.select("book", "date", F.expr(_mix(len(assets), "r")).alias("ret"))
    panel = small_side(returns.filter("ret IS NOT NULL").select("asset", "date", "ret"), "panel")
    held = weights.select("book", "asset", "w").repartition("book")
    earned = held.join(panel, "asset").select("book", "date", (F.col("w") * F.col("ret")).alias("ret"))
    # every book has a row on every day of the panel, also where none of its assets trades
    calendar = panel.groupBy("date").count().agg(F.sort_array(F.collect_list("date"))).scalar()
    idle = held.select("book").distinct().select("book", F.explode(calendar).alias("date"), F.lit(0.0).alias("ret"))
    return earned.unionByName(idle).groupBy("book", "date").agg(F.sum("ret").alias("ret"))


def _mix(p: int, row: str) -> str:
    return " + ".join(f"w{i} * {row}[{i}]" for i in range(p))


BLOCK_DAYS = 512


def _panel_days(returns: DataFrame, assets: Sequence[str]) -> DataFrame:
    """The panel as (block, days): sorted arrays of (date, r[]) for stretches of the
    calendar, numbered from 0."""
    rows = wide(returns.filter("ret IS NOT NULL"), assets)
    cells = F.array(*[F.coalesce(f"a{i}", F.lit(0.0)) for i in range(len(assets))])
    # one row per calendar day
    block = F.floor((F.row_number().over(Window.orderBy("date")) - 1) / BLOCK_DAYS).cast("int")
    numbered = rows.select(block.alias("block"), F.struct("date", cells.alias("r")).alias("d"))
    return numbered.groupBy("block").agg(F.sort_array(F.collect_list("d")).alias("days"))


def unfold(books: DataFrame, blocks: DataFrame, key: str, days: str) -> DataFrame:
    """Every book with every day of the panel: the panel's blocks, numbered from 0 by
    ``key``, are staged and sent to the books' tasks if small; a book meets each block by
    its number and unfolds it in place, so books are not shuffled."""
    staged = stage(blocks, "panel-blocks")
    n = staged.count()
    if n * BLOCK_DAYS <= BROADCAST_DAYS:
        staged = F.broadcast(staged)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias(key)
    return books.select("*", numbers).join(staged, key).select(*books.columns, F.inline(days))


def book_performance(weights: DataFrame, returns: DataFrame, assets: Sequence[str], rf: float, block: int = 256) -> DataFrame:
    """Performance metrics of very many books without a row per book and day.

    Books are gathered into one wide row each (the only shuffle). The panel, at most
    calendar days x MAX_WIDE_ASSETS numbers, is broadcast, and every task multiplies
    blocks of books with it: a days x books matrix per block is all it holds.
    """
    if len(assets) > MAX_WIDE_ASSETS:
        raise ValueError(f"more than {MAX_WIDE_ASSETS} assets: use book_returns and risk.performance")
    spark = weights.sparkSession
    p = len(assets)
    rows = wide(returns.filter("ret IS NOT NULL"), assets).orderBy("date").toPandas()
    panel = spark.sparkContext.broadcast(rows[[f"a{i}" for i in range(p)]].fillna(0.0).to_numpy(dtype=float))
    cols = [f"w{i}" for i in range(p)]

    def measure(batches):
        r = panel.value
        n = len(r)
        for batch in batches:
            for k in range(0, len(batch), block):
                part = batch.iloc[k : k + block]
                daily = r @ part[cols].to_numpy(dtype=float).T
                growth = np.cumprod(1.0 + daily, axis=0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    dd = (growth / np.maximum.accumulate(growth, axis=0) - 1.0).min(axis=0)
                    cagr = growth[-1] ** (AF / n) - 1.0
                vol = daily.std(axis=0, ddof=1) * np.sqrt(AF) if n > 1 else np.zeros(len(part))
                sharpe = (daily.mean(axis=0) * AF - rf) / (vol + 1e-12)
                yield pd.DataFrame(
                    {"book": part["book"], "n": n, "total_return": growth[-1] - 1.0, "cagr": cagr, "volatility": vol, "sharpe": sharpe, "max_drawdown": dd}
                )

    names = ("total_return", "cagr", "volatility", "sharpe", "max_drawdown")
    schema = "book STRING, n BIGINT, " + ", ".join(f"{x} DOUBLE" for x in names)
    wide_books = wide_weights(weights, assets)
    if not len(rows):
        return spark.createDataFrame([], schema)
    return wide_books.mapInPandas(measure, schema).select("book", "n", *[rnd(finite(x), 4).alias(x) for x in names])


def states_of_books(books: DataFrame, states: DataFrame, keys: tuple[str, str] = ("asset", "as_of")) -> DataFrame:
    """Every book with every (asset, date) row of ``states``, which books do not shuffle for:
    each asset's rows are cut into blocks of days, numbered over all assets, and a book
    meets the blocks by their numbers, as it meets a panel's days."""
    asset, date = keys
    own = states.withColumn("__row", F.row_number().over(Window.partitionBy(asset).orderBy(date)) - 1)
    own = own.withColumn("__part", F.floor(F.col("__row") / BLOCK_DAYS).cast("int"))
    # one row per asset
    sizes = states.groupBy(asset).agg(F.ceil(F.count("*") / BLOCK_DAYS).cast("int").alias("__parts"))
    before = Window.orderBy(asset).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(asset, F.coalesce(F.sum("__parts").over(before), F.lit(0)).cast("int").alias("__first"))
    dealt = own.join(first, asset).withColumn("block", F.col("__first") + F.col("__part"))
    blocks = dealt.groupBy("block").agg(F.collect_list(F.struct(*states.columns)).alias("states"))
    return unfold(books, blocks, "block", "states")


def wide_weights(weights: DataFrame, assets: Sequence[str]) -> DataFrame:
    """One row per book with w0..wp-1; an absent asset weighs 0."""
    cells = [
        F.coalesce(F.max(F.when(F.col("asset") == a, F.col("w"))), F.lit(0.0)).alias(f"w{i}")
        for i, a in enumerate(assets)
    ]
    return weights.groupBy("book").agg(*cells)


def exposures(
    weights: DataFrame, assets: Sequence[str], cma: DataFrame, rf: float, normalise: bool = False, fallback_equal: bool = False, per_book: bool = False
) -> DataFrame:
    """Ex-ante return, volatility, Sharpe, diversification and risk shares per book.

    ``cma`` has one row for all books (more of them are an error), or with ``per_book`` a row
    for each book, joined by ``book``; books become single wide rows, so the quadratic form
    is a projection. ``normalise`` first clamps negative weights and
    rescales to one.
    """
    p = len(assets)
    df = wide_weights(weights, assets)
    if normalise:
        df = df.withColumns({f"w{i}": F.greatest(F.col(f"w{i}"), F.lit(0.0)) for i in range(p)})
        total = sum((F.col(f"w{i}") for i in range(1, p)), F.col("w0"))
        df = df.withColumn("__t", F.when(total == 0, 1.0).otherwise(total))
        df = df.withColumns({f"w{i}": F.col(f"w{i}") / F.col("__t") for i in range(p)}).drop("__t")
    if per_book:
        df = df.join(cma.select("book", "mu", "cov"), "book")
    else:
        df = df.withColumns({"mu": cma.select("mu").scalar(), "cov": cma.select("cov").scalar()})
    df = search.score(df, p, rf)
    return df.withColumns({f"rc{i}": x for i, x in enumerate(search.contributions(p, fallback_equal))})


def stress(weights: DataFrame, shocks: DataFrame) -> DataFrame:
    """Scenario P&L per book and its loss part."""
    j = weights.join(F.broadcast(shocks), "asset")
    pnl = F.sum(F.col("w") * F.col("shock"))
    return j.groupBy("book", "scenario").agg(
        pnl.alias("stressed_pnl_1d"), F.least(pnl, F.lit(0.0)).alias("stressed_drawdown_proxy")
    )


def mandate_check(weights: DataFrame, bounds: DataFrame, group_role: str, group_cap: float) -> DataFrame:
    """Per book: bounds kept, group cap kept, weight sum, and the list of breaches.

    Books are folded to one row each with their own weights in a map, so bounds of
    absent assets are checked too (weight 0).
    """
    lim = bounds.select("asset", "lb", "ub", "role")
    names = F.broadcast(lim.groupBy().agg(F.sort_array(F.collect_list(F.struct("asset", "lb", "ub", "role"))).alias("lim")))
    book = weights.groupBy("book").agg(
        F.map_from_entries(F.collect_list(F.struct("asset", "w"))).alias("m"), F.sum("w").alias("sum_weights")
    )
    j = book.withColumn("lim", names.select("lim").scalar())
    w = lambda x: F.coalesce(F.try_element_at(F.col("m"), x["asset"]), F.lit(0.0))
    out = F.filter("lim", lambda x: (w(x) < x["lb"] - 1e-6) | (w(x) > x["ub"] + 1e-6))
    group = F.aggregate(
        F.filter("lim", lambda x: x["role"] == group_role), F.lit(0.0), lambda acc, x: acc + w(x)
    )
    j = j.withColumns({"__out": out, "group_weight": group})
    per_asset = F.transform("__out", lambda x: F.concat(x["asset"], F.lit(" outside bounds")))
    cap = F.when(F.col("group_weight") > group_cap + 1e-6, F.array(F.lit("group exceeds cap"))).otherwise(F.array().cast("array<string>"))
    total = F.when(F.abs(F.col("sum_weights") - 1.0) > 1e-4, F.array(F.lit("weights do not sum to 1"))).otherwise(F.array().cast("array<string>"))
    return j.select(
        "book",
        (F.size("__out") == 0).alias("asset_bounds_ok"),
        (F.col("group_weight") <= group_cap + 1e-6).alias("group_cap_ok"),
        "sum_weights",
        F.concat(per_asset, cap, total).alias("violations"),
    )


def renormalise(weights: DataFrame) -> DataFrame:
    """Long-only clip and rescale; an empty book becomes equal-weighted."""
    x = weights.withColumn("w", clip("w", 0.0, 1.0))
    total = F.sum("w").over(_book())
    return x.withColumn("w", F.when(total <= 1e-12, 1.0 / F.count("*").over(_book())).otherwise(F.col("w") / total))


def enforce_bounds(weights: DataFrame, bounds: DataFrame, group_role: str, group_cap: float, cash: str, rounds: int = 2) -> DataFrame:
    """Move weights inside their bounds, then under the group cap.

    The shortfall (or excess) is spread over each asset's remaining room and clipped
    again; spreading in proportion to room settles in one pass when the bounds are
    feasible, the further passes absorb rounding. Excess of the capped group goes to
    ``cash``. All passes are windows over one book.
    """
    x = weights.join(F.broadcast(bounds.select("asset", "lb", "ub", "role")), "asset", "left")
    x = x.withColumns({"lb": F.coalesce("lb", F.lit(0.0)), "ub": F.coalesce("ub", F.lit(1.0))})
    inside = lambda e: F.least(F.greatest(e, F.col("lb")), F.col("ub"))
    x = x.withColumn("w", inside(F.col("w")))
    for _ in range(rounds):
        x = x.withColumn("__diff", 1.0 - F.sum("w").over(_book()))
        room = F.when(F.col("__diff") > 0, F.col("ub") - F.col("w")).otherwise(F.col("w") - F.col("lb"))
        x = x.withColumn("__room", F.greatest(room, F.lit(0.0)))
        x = x.withColumn("__total", F.sum("__room").over(_book()))
        moved = F.col("w") + F.col("__diff") * (F.col("__room") / F.col("__total"))
        idle = (F.abs("__diff") < 1e-8) | (F.col("__total") <= 1e-12)
        x = x.withColumn("w", F.when(idle, F.col("w")).otherwise(inside(moved)))
    total = F.sum("w").over(_book())
    x = x.withColumn("w", F.when(total <= 1e-12, 1.0 / F.count("*").over(_book())).otherwise(F.col("w") / total))
    in_group = F.col("role") == group_role
    x = x.withColumn("__g", F.sum(F.when(in_group, F.col("w")).otherwise(0.0)).over(_book()))
    over = F.col("__g") > group_cap + 1e-8
    has_cash = F.max((F.col("asset") == cash).cast("int")).over(_book()) == 1
    others = F.sum((~in_group).cast("int")).over(_book())
    excess = F.col("__g") - group_cap
    share = F.when(has_cash, F.when(F.col("asset") == cash, excess).otherwise(0.0)).otherwise(excess / others)
    capped = F.when(in_group, F.col("w") * (group_cap / F.col("__g"))).otherwise(F.col("w") + share)
    x = x.withColumn("w", F.when(over, capped).otherwise(F.col("w")))
    x = x.withColumn("w", F.col("w") / F.greatest(F.sum("w").over(_book()), F.lit(1e-12)))
    return x.select("book", "asset", "w")


def redistribute(weights: DataFrame, asset: str, target: float) -> DataFrame:
    """Pin one asset's weight and scale the others to fill the rest."""
    t = min(max(target, 0.0), 1.0)
    pinned = F.col("asset") == asset
    others = F.sum(F.when(~pinned, F.col("w")).otherwise(0.0)).over(_book())
    n = F.sum((~pinned).cast("int")).over(_book())
    rest = F.when(others < 1e-10, (1 - t) / n).otherwise(F.col("w") * ((1 - t) / others))
    alone = n == 0
    return weights.withColumn("w", F.when(pinned, F.when(alone, 1.0).otherwise(t)).otherwise(rest))


def movers(stats: DataFrame, value: str, n: int = 3) -> DataFrame:
    """The n best and n worst rows with their rank (ties by asset name). The input is
    one row per asset; each end is found by an ordered limit, not a global sort."""
    top = stats.orderBy(F.col(value).desc(), "asset").limit(n)
    low = stats.orderBy(F.col(value).asc(), F.col("asset").desc()).limit(n)
    up = Window.orderBy(F.col(value).desc(), "asset")
    down = Window.orderBy(F.col(value).asc(), F.col("asset").desc())
    return top.select(F.lit("top").alias("side"), F.row_number().over(up).alias("rank"), "asset", value).unionByName(
        low.select(F.lit("bottom").alias("side"), F.row_number().over(down).alias("rank"), "asset", value)
    )


def visible_weights(weights: DataFrame, floor: float = 0.001) -> DataFrame:
    return weights.filter(F.col("w") > floor).orderBy("book", F.col("w").desc(), "asset")


def view_bounds(cloud: DataFrame, must: DataFrame, pad: float = 0.05) -> DataFrame:
    """Plot window: the central 95 % of the cloud, widened to the points that must
    show, plus padding; lower edges never below zero."""
    q = F.array(F.lit(0.025), F.lit(0.975))
    c = cloud.agg(F.percentile("vol", q).alias("x"), F.percentile("ret", q).alias("y"))
    m = must.agg(*[f("vol").alias(f"{n}x") for f, n in ((F.min, "lo"), (F.max, "hi"))], *[f("ret").alias(f"{n}y") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    one = c.select(
        F.col("x")[0].alias("lx"), F.col("x")[1].alias("hx"), F.col("y")[0].alias("ly"), F.col("y")[1].alias("hy"),
        *[m.select(n).scalar().alias(n) for n in ("lox", "hix", "loy", "hiy")],
    )
    out = one
    edges: dict[str, Column] = {}
    for axis in ("x", "y"):
        lo, hi = F.least(f"l{axis}", f"lo{axis}"), F.greatest(f"h{axis}", f"hi{axis}")
        span = F.when(hi - lo == 0, 0.02).otherwise(hi - lo)
        gap = span * max(pad, 0.02)
        edges[f"min_{axis}"] = F.greatest(lo - gap, F.lit(0.0))
        edges[f"max_{axis}"] = hi + gap
    return out.select(*[e.alias(n) for n, e in edges.items()])
