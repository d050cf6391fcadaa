"""Packing of token sequences by non-negative least squares.

Pieces of the same length are interchangeable, so packing needs only the histogram of
piece lengths, which is as wide as the window however many documents there are:

1. full windows are cut off long documents; what is left of each is one piece;
2. shallow combinations of lengths that fill a window are enumerated;
3. non-negative least squares finds how often to repeat each so that the histogram is
   used up; the counts are rounded down;
4. what rounding leaves is packed greedily, again length by length, not piece by piece.

The plan says which ranks of each length go into which sequences. Pieces get their rank
within their length by counting per task and adding the counts of earlier tasks, so no
length, however common, meets in one task.

Defined results: a null text is empty and has the end id alone; rows that repeat a doc_id
are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import texts_of
from tidepanel.llm.tokens import encodable, encoder
from tidepanel.session import stage

WINDOW = 4096
# Lengths that pair up to combinations of three.
ANCHORS = 48
ITERATIONS = 400


@dataclass
class Pattern:
    """Lengths that share a sequence, and the number of such sequences."""

    lengths: tuple[int, ...]
    repeats: int


def combinations(histogram: np.ndarray, window: int, anchors: int = ANCHORS) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths in use that fill a window but for 1/64 of it: repeats
    of one length with a fitting remainder, pairs, and triples with frequent lengths."""
    used = np.flatnonzero(histogram)
    if not len(used):
        return []

    def fit(room: int) -> int:
        """The longest length in use that still fits, 0 if none does."""
        k = np.searchsorted(used, room, side="right") - 1
        return int(used[k]) if k >= 0 else 0

    found = set()
    mass = histogram[used] * used
    frequent = used[np.argsort(-mass, kind="stable")[:anchors]].tolist()
    for a in used.tolist():
        for k in {*range(1, min(4, window // a) + 1), window // a}:
            rest = fit(window - k * a)
            found.add(tuple(sorted((a,) * k + ((rest,) if rest else ()))))
        for b in frequent:
            if a + b < window:
                rest = fit(window - a - b)
                found.add(tuple(sorted((a, b) + ((rest,) if rest else ()))))
    # the best filled ones first; what they cannot use is left to the greedy step
    return sorted((c for c in found if sum(c) >= window - window // 64), key=lambda c: (-sum(c), c))


def solve(histogram: np.ndarray, columns: list[tuple[int, ...]], iterations: int = ITERATIONS) -> np.ndarray:
    """x >= 0 with the least ||A x - histogram||, A the lengths' counts per combination,
    by accelerated projected gradients."""
    rows = np.array([length for c in columns for length in c], dtype=np.int64)
    cols = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    target = histogram.astype(float)
    scale = target.max()
    target = target / scale
    times = lambda x: np.bincount(rows, x[cols], minlength=len(target))
    back = lambda r: np.bincount(cols, r[rows], minlength=len(columns))
    probe = np.ones(len(columns))
    for _ in range(12):  # largest eigenvalue of A'A
        probe = back(times(probe))
        largest = np.linalg.norm(probe)
        probe /= largest
    x = np.zeros(len(columns))
    y, t = x, 1.0
    for _ in range(iterations):
        new = np.maximum(0.0, y - back(times(y) - target) / (1.05 * largest))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def greedy(left: np.ndarray, window: int) -> list[Pattern]:
    """Longest first: fill a window from the lengths that are left, as often as they last.
    Each step uses up a length or a repeat of it, so the steps are bounded by the window."""
    left, found = left.copy(), []
    while left.any():
        taken: dict[int, int] = {}
        free, room = left.copy(), window
        while len(fits := np.flatnonzero(free[: room + 1])):
            length = int(fits[-1])
            k = int(min(room // length, free[length]))
            taken[length] = k
            free[length] -= k
            room -= k * length
            if free[length]:
                free[length] = 0  # no room for another of this length
        repeats = int(min(left[length] // k for length, k in taken.items()))
        for length, k in taken.items():
            left[length] -= repeats * k
        found.append(Pattern(tuple(x for length, k in sorted(taken.items(), reverse=True) for x in (length,) * k), repeats))
    return found


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[Pattern]:
    """Patterns that use every piece of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    found = []
    columns = combinations(left, window)
    if columns:
        x = solve(left, columns)
        for k in np.argsort(-x, kind="stable"):
            wanted = pd.Series(columns[k]).value_counts() if x[k] >= 1 else None
            if wanted is None:
                break
            repeats = int(min([np.floor(x[k] + 1e-6), *(left[length] // n for length, n in wanted.items())]))
            if repeats > 0:
                found.append(Pattern(columns[k], repeats))
                for length, n in wanted.items():
                    left[length] -= repeats * n
    return found + greedy(left, window)


def slots(patterns: list[Pattern]) -> pd.DataFrame:
    """Per length, which ranks sit where: ranks from first to last at (length, place in
    the pattern) belong to consecutive sequences from ``sequence``, at ``offset``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for p in patterns:
        offset = 0
        for length in p.lengths:
            first = used.get(length, 0)
            rows.append((length, first, first + p.repeats - 1, sequence, offset))
            used[length] = first + p.repeats
            offset += length
        sequence += p.repeats
    return pd.DataFrame(rows, columns=["length", "first", "last", "sequence", "offset"])


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = 2,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode each document, add the end id and cut it at the window's length. One row per
    piece, with its running number among the pieces of its length in its task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc, seen = TaskContext.get().partitionId(), encoder(tokenizer), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in encodable(batches, 1):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(texts_of(batch.column(1))), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    length = len(part) // 4
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    rows.append((doc_id, start, length, zlib.crc32(part), n, task, rank, part if keep_ids else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
            )

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank", "ids"]
    types = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, rank long, ids binary"
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = 2,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    with ``keep_ids``, its ids as little-endian unsigned 32-bit numbers. The texts are
    encoded once and never shuffled; the plan's table is bounded by the window.
    """
    spark = docs.sparkSession
    cut = stage(token_pieces(docs, tokenizer, window, end_id, keep_ids, id_col, text_col), "pieces")
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = stage(per_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "piece-ranks")
    histogram = np.zeros(window + 1, np.int64)
    # one row per length: at most the window's number of rows
    for row in before.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    where = slots(plan(histogram, window))
    # whole patterns cover ranks without gaps, so a rank finds its slot by bisection; the
    # table goes along with the task's code, being bounded by the window
    by_length = {int(k): tuple(g[c].to_numpy() for c in ("first", "sequence", "offset")) for k, g in where.groupby("length")}
    shared = spark.sparkContext.broadcast(by_length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lengths, ranks = table["length"].to_numpy(), table["place"].to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                first, base, off = shared.value[int(length)]
                k = np.searchsorted(first, ranks[rows], side="right") - 1
                sequence[rows], offset[rows] = base[k] + ranks[rows] - first[k], off[k]
            kept = table.drop_columns(["place"])
            yield from kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if keep_ids else [])
    # counts per task and length grow with the tasks: joined by shuffle, never broadcast
    counts = before.select("task", "length", "before").hint("merge")
    ranked = cut.join(counts, ["task", "length"]).select(
        *columns, (F.col("rank") + F.col("before")).alias("place")
    )
    kinds = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in columns)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
