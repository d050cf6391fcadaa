"""Runs (maximal repetitions) of words, found online by dyadic square catching.

A run is a stretch of words with smallest period q that holds at least two periods and
that no neighbouring word extends. Its words equal those q places on, over at least q
words, so for a fitting power of two b it contains a whole block of b words at a multiple
of b that comes again q places later, with 2b - 1 <= q <= 4b - 2.

Words are appended in portions of any size. Each level (a block size) keeps names of its
windows, each made of the names of its two halves. A completed block is a catcher: every
window that ends in the new words is held against the few blocks at a distance of the
level. Neighbouring catches at one distance are one comparison of the text with itself;
its ends are found by comparing words, never by names alone, and a comparison that reaches
the last known word goes on when more are appended. A comparison of q words or more is a
square; squares that overlap at one distance are the same run. What lies in a run of a
period that divides the distance is left out early, so text that repeats one word many
times catches nothing new.

Texts share one stream, parted by marks that equal nothing, so the work per word is a few
array operations a level. Memory is bounded by the longest text, not by the table.

Defined results: null and wordless texts have no words and no runs; equal rows get equal
results each; a null doc_id stays null; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import bounded, utf8_of

MIN_LENGTH = 12
# Words appended at a time.
PORTION = 1 << 18


def _pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of windows by the names of their halves."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _prime_factors(n: int) -> list[int]:
    found, k = [], 2
    while k * k <= n:
        if n % k == 0:
            found.append(k)
            while n % k == 0:
                n //= k
        k += 1
    return found + [n] if n > 1 else found


class _Level:
    """Names of the last windows of ``block`` words, and the distances it watches."""

    def __init__(self, block: int, least: int, most: int):
        self.block, self.least, self.most = block, least, most
        self.names, self.base = np.empty(0, np.uint64), 0

    def add(self, names: np.ndarray) -> None:
        self.names = np.concatenate([self.names, names])

    def forget(self, end: int) -> None:
        """Keep what windows after place ``end`` can be held against."""
        keep = max(self.base, end - 5 * self.block - 4)
        self.names, self.base = self.names[keep - self.base :], keep


class SquareCatcher:
    """Runs of a growing sequence of word codes; negative codes part texts and equal nothing
    if each is used once. ``longest`` bounds the length of a text, if known."""

    def __init__(self, min_length: int = MIN_LENGTH, longest: int | None = None):
        if min_length < 5:
            raise ValueError("the smallest blocks have two words: runs of five words or more are found")
        self.min_length, self._longest = min_length, longest
        self._words, self._n = np.empty(1024, np.int64), 0
        # by place: the run over it that reaches furthest (-1: none); by run: its period and end
        self._cover = np.full(1024, -1, np.int32)
        self._period, self._end, self._n_runs = np.ones(64, np.int64), np.zeros(64, np.int64), 0
        self._singles = _Level(1, 0, -1)
        self._levels: list[_Level] = []
        # by distance: first, end and run (-1: not yet one) of comparisons that reach the last word
        self._open: dict[int, list[list[int]]] = {}
        self._closed: list[tuple[int, int, int]] = []  # first, end, distance

    def _need(self, q: int) -> int:
        """Words that must equal those q places on."""
        return max(self.min_length - q, q)

    def append(self, codes: np.ndarray) -> None:
        before, now = self._n, self._n + len(codes)
        if now > len(self._words):
            size = max(now, 2 * len(self._words))
            self._words = np.concatenate([self._words[:before], np.empty(size - before, np.int64)])
            self._cover = np.concatenate([self._cover[:before], np.full(size - before, -1, np.int32)])
        self._words[before:now], self._n = codes, now
        self._go_on()
        x = codes.astype(np.int64).view(np.uint64)
        self._singles.add(_pair_names(x, x))
        below = self._singles
        for level in self._watched():
            half = level.block // 2
            start = level.base + len(level.names)
            end = now - level.block + 1
            if end > start:
                left = below.names[start - below.base : end - below.base]
                right = below.names[start + half - below.base : end + half - below.base]
                level.add(_pair_names(left, right))
                self._catch(level, start, end)
            below = level
        for level in (self._singles, *self._levels):
            level.forget(now)

    def _watched(self) -> Iterator[_Level]:
        """Levels whose blocks fit the words so far, smallest first."""
        k = 0
        while True:
            block = 2 << k
            least = 1 if block == 2 else 2 * block - 1
            if self._n < block or self._longest is not None and 2 * least > self._longest:
                return
            if k == len(self._levels):
                self._levels.append(_Level(block, least, 4 * block - 2))
            yield self._levels[k]
            k += 1

    def _go_on(self) -> None:
        """Open comparisons take in the new words."""
        for q, own in list(self._open.items()):
            still = []
            for first, end, run in own:
                end = self._right(end, q)
                run = self._paint(first, end, q, run)
                if end + q == self._n:
                    still.append([first, end, run])
                elif end - first >= self._need(q):
                    self._closed.append((first, end, q))
            if still:
                self._open[q] = still
            else:
                del self._open[q]

    def _right(self, at: int, q: int) -> int:
        """First place from ``at`` on whose word differs from that q places on."""
        step, w = 32, self._words
        while at + q < self._n:
            n = min(step, self._n - q - at)
            differ = w[at : at + n] != w[at + q : at + q + n]
            k = int(differ.argmax())
            if differ[k]:
                return at + k
            at, step = at + n, step * 2
        return at

    def _left(self, at: int, q: int) -> int:
        """First place of the words before ``at`` that equal those q places on."""
        step, w = 32, self._words
        while at > 0:
            n = min(step, at)
            differ = (w[at - n : at] != w[at - n + q : at + q])[::-1]
            k = int(differ.argmax())
            if differ[k]:
                return at - k
            at, step = at - n, step * 2
        return at

    def _catch(self, level: _Level, start: int, end: int) -> None:
        """Hold the windows from ``start`` to ``end`` against the blocks before them."""
        b = level.block
        window = np.arange(start, end)
        names = level.names[start - level.base :]
        nearest = (window - level.least) // b * b
        places, distances = [], []
        for k in range((level.most - level.least + 1) // b):
            block = nearest - k * b
            at = np.flatnonzero(block >= level.base)
            at = at[level.names[block[at] - level.base] == names[at]]
            places.append(block[at])
            distances.append(window[at] - block[at])
        place, distance = np.concatenate(places), np.concatenate(distances)
        if not len(place):
            return
        run = self._cover[place]
        inside = (run >= 0) & (self._end[run] >= place + distance + b) & (distance % self._period[run] == 0)
        place, distance = place[~inside], distance[~inside]
        order = np.lexsort((place, distance))
        place, distance = place[order], distance[order]
        opens = np.flatnonzero(np.append(True, (distance[1:] != distance[:-1]) | (place[1:] != place[:-1] + b)))[: len(place)]
        last = np.append(opens[1:], len(place)) - 1
        if not len(opens):
            return
        # a comparison that is long enough holds this many whole blocks, some perhaps in portions before or to come
        q = distance[opens]
        need = (np.maximum(self.min_length - q, q) + 1 - b) // b
        enough = (last - opens + 1 >= need) | (place[opens] - b + q < start) | (place[last] + q + 2 * b > self._n)
        for first, q in zip(place[opens[enough]].tolist(), q[enough].tolist(), strict=True):
            self._compare(first, q, b)

    def _compare(self, at: int, q: int, block: int) -> None:
        known = self._open.get(q, [])
        if any(first <= at < end for first, end, _ in known):
            return
        run = self._cover[at]
        if run >= 0 and self._end[run] >= at + q + block and q % self._period[run] == 0:
            return
        first, end = self._left(at, q), self._right(at, q)
        run = self._paint(first, end, q)
        if end + q == self._n:
            self._open.setdefault(q, []).append([first, end, run])
        elif end - first >= self._need(q):
            self._closed.append((first, end, q))

    def _paint(self, first: int, end: int, q: int, run: int = -1) -> int:
        """Mark the words of a run (again, if it has grown), so that multiples of its period
        are left out."""
        if run < 0:
            if end - first < self._need(q) or self._shorter(first, end, q):
                return -1
            run, self._n_runs = self._n_runs, self._n_runs + 1
            if run == len(self._end):
                self._period, self._end = np.tile(self._period, 2), np.tile(self._end, 2)
            self._period[run], self._end[run] = q, first
        own = self._cover[max(first, self._end[run]) : end + q]
        own[(own < 0) | (self._end[own] < end + q)] = run
        self._end[run] = end + q
        return run

    def _shorter(self, first: int, end: int, q: int) -> bool:
        """Whether a smaller period holds; by the periodicity lemma it divides q."""
        w, stop = self._words, end + q
        return any(np.array_equal(w[first : stop - q // f], w[first + q // f : stop]) for f in _prime_factors(q))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs in the words so far, by start, then period."""
        found = self._closed + [(a, b, q) for q, own in self._open.items() for a, b, _ in own if b - a >= self._need(q)]
        return sorted({(a, b - a + q, q) for a, b, q in found if not self._shorter(a, b, q)}, key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text's words."""
    flat = [w for words in texts for w in words]
    code = dict(zip(set(flat), range(len(flat)), strict=False))
    codes = np.fromiter(map(code.__getitem__, flat), np.int64, len(flat))
    lengths = np.array([len(w) for w in texts], np.int64)
    # a mark of its own behind each text
    ends = np.cumsum(lengths + 1)
    stream = np.empty(int(lengths.sum()) + len(texts), np.int64)
    marks = ends - 1
    stream[marks] = -1 - np.arange(len(texts))
    stream[np.delete(np.arange(len(stream)), marks)] = codes
    catcher = SquareCatcher(min_length, int(lengths.max(initial=0)))
    for at in range(0, len(stream), PORTION):
        catcher.append(stream[at : at + PORTION])
    starts = (ends - lengths - 1).tolist()
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in catcher.runs():
        k = bisect_right(starts, start) - 1
        found[k].append((start - starts[k], length, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[k] for k in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period), collapsed (the text's kept
    words joined by one space)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            texts = [t.split() for t in utf8_of(batch.column(1))]  # bytes: the six ASCII white-space characters
            runs = runs_of_texts(texts, min_length)
            named = [[{"start": a, "length": n, "period": q} for a, n, q in own] for own in runs]
            left = pa.array([collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.array(named, _RUN_LIST), left],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(search, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
