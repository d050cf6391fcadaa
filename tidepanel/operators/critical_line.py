"""Exact efficient frontiers of very many books by the critical-line method.

A book's frontier under per-asset bounds and full investment is a chain of line segments
between turning points, where one asset starts or stops being held at a bound. The walk
starts at the largest return and lowers the price of variance; at each step the assets off
their bounds move along a line that two solves give, until the next asset meets a bound or
its multiplier changes sign. Books are rows (book, mu, cov) that Spark deals out; within a
task all books of a block walk at once, as stacked systems, and leave as they finish. A book
takes one row in and one row out for each optimum, whatever the number of assets.

Every optimum (largest Sharpe ratio, smallest variance, given volatility, given risk
aversion, points at given returns) lies on a segment and follows from it in closed form.
``kkt`` is the largest violation of the optimality conditions of the mean-variance problem
at the point's own ``lam`` (the trade of variance for return), so results carry their proof.

Defined results: bounds that no mix satisfies fall back to the weight cap, as elsewhere; where
the lower bounds add up to one there is a single point; a book whose best return is below
the risk-free rate gets the point of its frontier with the largest ratio; a target below the
smallest volatility gives the quietest mix with ``met`` false. Assets with equal means are
told apart by the size of their variance, which only decides where the walk starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Books that walk together; their stacked systems take this many times (assets + 1)^2 numbers.
BLOCK_BOOKS = 256
LOW, FREE, UP = 0, 1, 2
TINY = 1e-13
RIDGE = 1e-12


@dataclass
class Lines:
    """Turning points of a block of books: prices of variance, falling, and mixes. Books with
    fewer points repeat their last one."""

    mu: np.ndarray  # books x assets
    cov: np.ndarray  # books x assets x assets
    lam: np.ndarray  # books x points
    w: np.ndarray  # books x points x assets
    n: np.ndarray  # points of each book


def _start(mu: np.ndarray, cov: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States at the largest return, and the one asset that is free there."""
    books, p = mu.shape
    own = np.arange(books)
    order = np.lexsort((np.diagonal(cov, axis1=1, axis2=2), -mu), axis=1)
    state = np.full((books, p), LOW)
    left, free = np.full(books, 1.0 - lo.sum()), np.full(books, -1)
    for k in range(p):
        asset = order[:, k]
        room = hi[asset] - lo[asset]
        used = (left > TINY) & (room > 0)
        # the last asset that takes anything is free, those before it are full
        full = used & (free >= 0)
        state[own[full], free[full]] = UP
        free = np.where(used, asset, free)
        left = left - np.where(used, np.minimum(room, left), 0.0)
    state[own, free] = FREE
    return state, free


def walk(mu: np.ndarray, cov: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Lines:
    """Turning points of all books of a block, from the largest return to the smallest variance."""
    books, p = mu.shape
    if 1.0 - lo.sum() <= TINY:
        w = np.broadcast_to(lo / lo.sum(), (books, 1, p)).copy()
        return Lines(mu, cov, np.zeros((books, 1)), w, np.ones(books, int))
    state, changed = _start(mu, cov, lo, hi)
    exact = cov
    # so that assets that cannot be told apart leave the systems solvable
    ridge = np.maximum(RIDGE * np.diagonal(cov, axis1=1, axis2=2).mean(axis=1), 1e-18)
    cov = cov + ridge[:, None, None] * np.eye(p)
    lam, live = np.full(books, np.inf), np.arange(books)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    eye, movable = np.eye(p), hi - lo > 0
    for _ in range(50 * p + 100):
        if not len(live):
            break
        b, s, m = len(live), state[live], mu[live]
        free = s == FREE
        system = np.zeros((b, p + 1, p + 1))
        system[:, :p, :p] = np.where(free[:, :, None], cov[live], eye)
        system[:, :p, p] = -1.0 * free
        system[:, p, :p] = 1.0
        right = np.zeros((b, p + 1, 2))
        right[:, :p, 0] = np.where(free, 0.0, np.where(s == UP, hi, lo))
        right[:, p, 0] = 1.0
        right[:, :p, 1] = np.where(free, m, 0.0)
        solved = np.linalg.solve(system, right)
        # w = a + lam d; multipliers of the bounds: nu = c + lam e
        a, d = solved[:, :p, 0], solved[:, :p, 1]
        pressure = cov[live] @ solved[:, :p, :]
        c, e = pressure[:, :, 0] - solved[:, p, None, 0], pressure[:, :, 1] - m - solved[:, p, None, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            falls, rises = free & (d > TINY), free & (d < -TINY)
            stops = np.where(falls, (lo - a) / d, np.where(rises, (hi - a) / d, -np.inf))
            sign = ((s == LOW) & (e > TINY) | (s == UP) & (e < -TINY)) & movable
            starts = np.where(sign, -c / e, -np.inf)
        event = np.maximum(stops, starts)
        rows, last = np.arange(b), changed[live]
        back = event[rows, last] >= lam[live] * (1 - 1e-12) - 1e-15
        event[rows, last] = np.where(back, -np.inf, event[rows, last])
        event = np.minimum(event, lam[live][:, None])
        asset = event.argmax(axis=1)
        now = np.maximum(event[rows, asset], 0.0)
        steps.append((live, now, np.clip(a + now[:, None] * d, lo, hi)))
        stopped = s[rows, asset] == FREE
        s[rows, asset] = np.where(stopped, np.where(falls[rows, asset], LOW, UP), FREE)
        state[live], lam[live], changed[live] = s, now, asset
        live = live[now > 0]
    n = np.zeros(books, int)
    points = max(1, len(steps))
    prices, mixes = np.zeros((books, points)), np.zeros((books, points, p))
    for k, (own, price, mix) in enumerate(steps):
        n[own] = k + 1
        prices[own, k], mixes[own, k] = price, mix
        rest = np.setdiff1d(np.arange(books), own, assume_unique=True)
        prices[rest, k], mixes[rest, k] = prices[rest, k - 1], mixes[rest, k - 1]
    return Lines(mu, exact, prices, mixes, n)


@dataclass
class Segments:
    """From each turning point to the next: mix w + t d, return r0 + r1 t, variance
    v0 + v1 t + v2 t^2, for t from 0 to 1."""

    w: np.ndarray
    d: np.ndarray
    r0: np.ndarray
    r1: np.ndarray
    v0: np.ndarray
    v1: np.ndarray
    v2: np.ndarray


def segments(lines: Lines) -> Segments:
    w = lines.w
    d = np.concatenate([w[:, 1:] - w[:, :-1], np.zeros_like(w[:, :1])], axis=1)
    mean, pw, pd = lines.mu[:, :, None], w @ lines.cov, d @ lines.cov
    return Segments(w, d, (w @ mean)[:, :, 0], (d @ mean)[:, :, 0], (pw * w).sum(2), 2 * (pw * d).sum(2), (pd * d).sum(2))


def _at(lines: Lines, s: Segments, k: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixes and prices at place t of segment k of each book."""
    own = np.arange(len(k))
    following = np.minimum(k + 1, lines.lam.shape[1] - 1)
    lam = lines.lam[own, k] + t * (lines.lam[own, following] - lines.lam[own, k])
    return s.w[own, k] + t[:, None] * s.d[own, k], lam


Pick = Callable[[Lines, Segments], tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]


def pick_min_variance(lines: Lines, s: Segments) -> tuple[np.ndarray, np.ndarray, dict]:
    return *_at(lines, s, lines.n - 1, np.zeros(len(lines.n))), {}


def pick_max_return(lines: Lines, s: Segments) -> tuple[np.ndarray, np.ndarray, dict]:
    return *_at(lines, s, np.zeros(len(lines.n), int), np.zeros(len(lines.n))), {}


def pick_max_sharpe(rf: float) -> Pick:
    def pick(lines: Lines, s: Segments) -> tuple[np.ndarray, np.ndarray, dict]:
        n0 = s.r0 - rf
        with np.errstate(divide="ignore", invalid="ignore"):
            # where the ratio's slope along the segment is zero; linear in t
            t = (s.r1 * s.v0 - n0 * s.v1 / 2) / (n0 * s.v2 - s.r1 * s.v1 / 2)
        t = np.clip(np.nan_to_num(t, nan=0.0, posinf=0.0, neginf=0.0), 0.0, 1.0)
        places = np.stack([np.zeros_like(t), t, np.ones_like(t)])
        var = s.v0 + places * (s.v1 + places * s.v2)
        ratio = (n0 + places * s.r1) / np.sqrt(np.maximum(var, 1e-300))
        best = ratio.transpose(1, 2, 0).reshape(len(t), -1).argmax(axis=1)
        k, which = best // 3, best % 3
        return *_at(lines, s, k, places[which, np.arange(len(k)), k]), {}

    return pick


def pick_utility(aversion: float) -> Pick:
    """Largest return less half the aversion times the variance: the price is its inverse."""

    def pick(lines: Lines, s: Segments) -> tuple[np.ndarray, np.ndarray, dict]:
        price = 1.0 / aversion
        k = np.maximum((lines.lam >= price).sum(axis=1) - 1, 0)
        own = np.arange(len(k))
        following = np.minimum(k + 1, lines.lam.shape[1] - 1)
        fall = lines.lam[own, k] - lines.lam[own, following]
        t = np.clip(np.divide(lines.lam[own, k] - price, fall, out=np.zeros(len(k)), where=fall > 0), 0.0, 1.0)
        w, _ = _at(lines, s, k, t)
        # beyond the first turning point the largest return stays
        return w, np.full(len(k), price), {}

    return pick


def pick_volatility(target: float) -> Pick:
    """Largest return with at most this volatility."""

    def pick(lines: Lines, s: Segments) -> tuple[np.ndarray, np.ndarray, dict]:
        books, points = lines.lam.shape
        goal = target * target
        last = lines.n - 1
        quiet = s.v0[np.arange(books), last]
        # variance falls along the line: the first segment that ends at or below the goal
        ends = np.concatenate([s.v0[:, 1:], s.v0[:, -1:]], axis=1)
        k = np.where(s.v0[:, 0] <= goal, 0, np.minimum((ends > goal).sum(axis=1), last))
        own = np.arange(books)
        a, b, c = s.v2[own, k], s.v1[own, k], s.v0[own, k] - goal
        root = np.sqrt(np.maximum(b * b - 4 * a * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            # b < 0: the smaller root, in the form that does not cancel
            t = np.where(c > 0, 2 * c / (-b + root), 0.0)
        t = np.clip(np.nan_to_num(t, nan=1.0, posinf=1.0), 0.0, 1.0)
        t = np.where((s.v0[:, 0] <= goal) | (quiet > goal), 0.0, t)
        k = np.where(quiet > goal, last, k)
        case = np.where(quiet >= goal, "min_variance", np.where(s.v0[:, 0] <= goal, "max_return", "target"))
        return *_at(lines, s, k, t), {"met": quiet <= goal, "case": case}

    return pick


def pick_returns(points: int) -> Pick:
    """Evenly spaced returns from the quietest mix to the largest return; ``points`` mixes a
    book, flattened in that order."""

    def pick(lines: Lines, s: Segments) -> tuple[np.ndarray, np.ndarray, dict]:
        books = len(lines.n)
        own = np.arange(books)
        low, high = s.r0[own, lines.n - 1], s.r0[:, 0]
        goal = low[:, None] + (high - low)[:, None] * np.linspace(0.0, 1.0, points)
        mixes, prices = [], []
        for at in goal.T:
            k = np.minimum(np.maximum((s.r0 >= at[:, None]).sum(axis=1) - 1, 0), lines.n - 1)
            fall = s.r1[own, k]
            t = np.clip(np.divide(at - s.r0[own, k], fall, out=np.zeros(books), where=fall < 0), 0.0, 1.0)
            w, lam = _at(lines, s, k, t)
            mixes.append(w)
            prices.append(lam)
        return np.stack(mixes, 1).reshape(books * points, -1), np.stack(prices, 1).ravel(), {"point": np.tile(np.arange(points, dtype=np.int32), books)}

    return pick


def kkt_violation(mu: np.ndarray, cov: np.ndarray, w: np.ndarray, lam: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Largest violation of feasibility, stationarity and the multipliers' signs."""
    force = (cov @ w[:, :, None])[:, :, 0] - lam[:, None] * mu
    near = 1e-9
    above, below = w > lo + near, w < hi - near  # may fall, may rise
    # moving weight from an asset that may fall to one that may rise must not pay
    gain = np.max(np.where(above, force, -np.inf), axis=1) - np.min(np.where(below, force, np.inf), axis=1)
    bounds = np.maximum(np.max(lo - w, axis=1), np.max(w - hi, axis=1))
    return np.maximum.reduce([np.where(np.isfinite(gain), gain, 0.0), bounds, np.abs(w.sum(axis=1) - 1.0), np.zeros(len(w))])


def _limits(p: int, bounds: Sequence[tuple[float, float]] | None, weight_cap: float) -> tuple[np.ndarray, np.ndarray]:
    limits = list(bounds) if bounds is not None else [(0.0, weight_cap)] * p
    lo = np.array([max(0.0, a) for a, _ in limits])
    hi = np.array([max(max(0.0, a), min(b, weight_cap)) for a, b in limits])
    if len(limits) != p:
        raise ValueError("one pair of bounds an asset")
    if lo.sum() > 1 + 1e-9 or hi.sum() < 1 - 1e-9:
        lo, hi = np.zeros(p), np.full(p, max(weight_cap, 1.0 / p))
    return lo, hi


def _matrices(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray]:
    flat = [batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2)]
    if len(flat[0]) != batch.num_rows * p or len(flat[1]) != batch.num_rows * p * p:
        raise ValueError(f"books need {p} means and {p * p} covariances")
    return flat[0].reshape(-1, p), flat[1].reshape(-1, p, p)


def optimum(
    cma: DataFrame, p: int, rf: float, pick: Pick, bounds: Sequence[tuple[float, float]] | None = None, weight_cap: float = 1.0, extra: str = ""
) -> DataFrame:
    """Per book (and point): what ``pick`` names in ``extra`` (a schema), w0.., ret, vol,
    sharpe, lam, kkt. ``cma`` has book, mu (means) and cov (covariances by rows)."""
    lo, hi = _limits(p, bounds, weight_cap)
    named = [f.split()[0] for f in extra.split(",") if f.strip()]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_BOOKS):
                part = batch.slice(at, BLOCK_BOOKS)
                mu, cov = _matrices(part, p)
                lines = walk(mu, cov, lo, hi)
                w, lam, more = pick(lines, segments(lines))
                of = np.repeat(np.arange(len(mu)), len(w) // len(mu))
                ret, var = (w * mu[of]).sum(1), np.maximum(((cov[of] @ w[:, :, None])[:, :, 0] * w).sum(1), 0.0)
                vol = np.sqrt(var)
                columns = [part.column(0).take(pa.array(of)), *(pa.array(more[n]) for n in named), *(pa.array(x) for x in w.T)]
                columns += [pa.array(x) for x in (ret, vol, (ret - rf) / (vol + 1e-12), lam, kkt_violation(mu[of], cov[of], w, lam, lo, hi))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["book", *named, *[f"w{i}" for i in range(p)], "ret", "vol", "sharpe", "lam", "kkt"]
    numbers = ", ".join(f"{n} double" for n in names[1 + len(named) :])
    schema = ", ".join(x for x in ("book string", extra, numbers) if x)
    return cma.selectExpr("cast(book AS string) book", "mu", "cov").mapInArrow(solve, schema)


def max_sharpe(cma: DataFrame, p: int, rf: float, **limits: object) -> DataFrame:
    return optimum(cma, p, rf, pick_max_sharpe(rf), **limits)


def min_variance(cma: DataFrame, p: int, rf: float, **limits: object) -> DataFrame:
    return optimum(cma, p, rf, pick_min_variance, **limits)


def max_return(cma: DataFrame, p: int, rf: float, **limits: object) -> DataFrame:
    return optimum(cma, p, rf, pick_max_return, **limits)


def utility(cma: DataFrame, p: int, rf: float, aversion: float, **limits: object) -> DataFrame:
    return optimum(cma, p, rf, pick_utility(aversion), **limits)


def at_volatility(cma: DataFrame, p: int, rf: float, target: float, **limits: object) -> DataFrame:
    """Largest return at no more than the target; ``met`` is false where the quietest mix is
    louder, ``case`` tells whether the target binds or an end of the frontier stands."""
    return optimum(cma, p, rf, pick_volatility(target), extra="met boolean, case string", **limits)


def frontier(cma: DataFrame, p: int, rf: float, points: int = 70, **limits: object) -> DataFrame:
    """``points`` exact mixes a book, by evenly spaced returns; ``point`` counts upwards."""
    return optimum(cma, p, rf, pick_returns(points), extra="point int", **limits)


def turning_points(cma: DataFrame, p: int, bounds: Sequence[tuple[float, float]] | None = None, weight_cap: float = 1.0) -> DataFrame:
    """Per book and turning point, from the largest return on: point, lam, w, ret, vol."""
    lo, hi = _limits(p, bounds, weight_cap)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_BOOKS):
                part = batch.slice(at, BLOCK_BOOKS)
                lines = walk(*_matrices(part, p), lo, hi)
                s = segments(lines)
                of, point = np.nonzero(np.arange(lines.lam.shape[1])[None, :] < lines.n[:, None])
                columns = [
                    part.column(0).take(pa.array(of)),
                    pa.array(point.astype(np.int32)),
                    pa.array(lines.lam[of, point]),
                    pa.array(list(lines.w[of, point]), pa.list_(pa.float64())),
                    pa.array(s.r0[of, point]),
                    pa.array(np.sqrt(np.maximum(s.v0[of, point], 0.0))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["book", "point", "lam", "w", "ret", "vol"])

    schema = "book string, point int, lam double, w array<double>, ret double, vol double"
    return cma.selectExpr("cast(book AS string) book", "mu", "cov").mapInArrow(solve, schema)
