"""Text quality by a generalised additive model with pairwise interactions.

A text becomes some twenty numbers (lengths, shares of character classes, repetition).
Each number is cut into bins. Boosting goes round the features in turn and fits a shallow
tree to each one's current errors; the trees of a feature add up to a table over its bins.
The pairs of features with the most left to explain get tables over both. A score is a sum
of table entries, so it can be read: every table shows what its feature does.

Learned from at most about ``FIT_ROWS`` labelled rows, chosen by a hash of their ids.
Texts are measured as a whole.

Defined results: a null text is empty and is scored like any other; rows with a null label
or without a document are not learned from; if only one class is labelled, every score is
the share of label 1 (0.5 without labels); rows that repeat a doc_id keep a row each;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import hash_share, pieces, utf8_of

FIT_ROWS = 20_000
BINS = 32
COARSE = 8
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1
DAMPING = 5.0

FEATURES = (
    "words", "characters", "word_length", "longest_word", "upper", "digit", "symbol", "exclamation", "bar", "marked_word",
    "stop_or_comma", "lines", "repeated_lines", "repeated_sentences", "distinct_words", "top_word", "short_words", "non_ascii",
    "first_upper", "at_or_plus",
)

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1  # upper
_CLASS[97:123] = 2  # lower
_CLASS[48:58] = 3  # digit
_CLASS[[9, 10, 11, 12, 13, 32]] = 4  # white space
_CLASS[128:] = 5
_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH = range(1, 6)
_MARKS = tuple(bytes([c]) for c in b"#$%&*")


def repeated(parts: list[bytes]) -> float:
    parts = [p for p in parts if p.strip()]
    return 1 - len(set(parts)) / len(parts) if parts else 0.0


def measure(text: bytes) -> list[float]:
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    of = np.bincount(_CLASS, count, minlength=6)
    letters = max(1.0, of[_UPPER] + of[_LOWER] + of[_HIGH])
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = text.split(b"\n")
    seen = Counter(words)
    return [
        np.log1p(len(words)),
        np.log1p(len(text)),
        lengths.mean() if words else 0.0,
        np.log1p(lengths.max(initial=0)),
        of[_UPPER] / letters,
        of[_DIGIT] / size,
        of[0] / size,
        count[33] / n,
        count[124] / n,
        sum(count[m[0]] for m in _MARKS) / n,
        (count[44] + count[46]) / n,
        np.log1p(len(lines)),
        repeated(lines),
        repeated(text.split(b".")),
        len(seen) / n,
        max(seen.values(), default=0) / n,
        (lengths <= 3).sum() / n,
        of[_HIGH] / size,
        sum(map(seen.__getitem__, filter(bytes.istitle, seen))) / n,
        (count[64] + count[43]) / n,
    ]


def features(batch: list[bytes]) -> np.ndarray:
    return np.array([measure(t) for t in batch], float).reshape(-1, len(FEATURES))


@dataclass
class AdditiveModel:
    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.bias)
        if self.tables:
            places = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]
            for table, place in zip(self.tables, places, strict=True):
                logit += table[place]
            for (i, j), table in self.pairs.items():
                logit += table[self.coarse[i][places[i]], self.coarse[j][places[j]]]
        return 1 / (1 + np.exp(-logit))


def _leaves(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A shallow tree over ordered bins: cut where the gain is largest, up to ``leaves``
    leaves; per bin the leaf's Newton step."""
    step = np.zeros(len(g))
    parts = [(0, len(g))]
    worth = lambda a, b: a * a / (b + DAMPING)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p, (lo, hi) in enumerate(parts):
            if hi - lo > 1:
                cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
                gain = worth(cg[:-1], ch[:-1]) + worth(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - worth(cg[-1], ch[-1])
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), p, lo + k + 1), key=lambda b: b[0])
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    for lo, hi in parts:
        step[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + DAMPING)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a two-way table: gain and the step in each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    worth = lambda a, b: a * a / (b + DAMPING)
    at = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    parts = list(zip(at(cg), at(ch), strict=True))
    gain = sum(worth(a, b) for a, b in parts)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    steps = [float(a[i, j] / (b[i, j] + DAMPING)) for a, b in parts]
    cell = np.empty(g.shape)
    cell[: i + 1, : j + 1], cell[: i + 1, j + 1 :], cell[i + 1 :, : j + 1], cell[i + 1 :, j + 1 :] = steps
    return float(gain[i, j] - worth(cg[-1, -1], ch[-1, -1])), cell


def train(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    share = float(y.mean()) if len(y) else 0.5
    p = min(max(share, 1e-6), 1 - 1e-6)
    model = AdditiveModel(float(np.log(p / (1 - p))))
    if len(y) == 0 or share in (0.0, 1.0):
        return model
    for k in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]))
        model.edges.append(edges)
        model.tables.append(np.zeros(len(edges) + 1))
        model.coarse.append(np.arange(len(edges) + 1) * COARSE // (len(edges) + 1))
    place = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    logit = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-logit))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            n = len(table)
            step = RATE * _leaves(np.bincount(place[k], g, n), np.bincount(place[k], h, n))
            table += step
            logit += step[place[k]]

    rough = [c[b] for c, b in zip(model.coarse, place, strict=True)]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = slopes()
        cell = rough[i] * COARSE + rough[j]
        shape = (COARSE, COARSE)
        return cell, np.bincount(cell, g, COARSE**2).reshape(shape), np.bincount(cell, h, COARSE**2).reshape(shape)

    gains = {pair: _quadrants(*cells(*pair)[1:])[0] for pair in combinations(range(x.shape[1]), 2)}
    for pair in sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]:
        model.pairs[pair] = np.zeros((COARSE, COARSE))
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            cell, g, h = cells(i, j)
            step = RATE * _quadrants(g, h)[1]
            table += step
            logit += step.ravel()[cell]
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = FIT_ROWS,
) -> AdditiveModel:
    """Learn from labelled rows where ``learnable`` (a condition on the id) holds."""
    known = labels.where(learnable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
    n = known.count()
    if not n:
        return train(np.empty((0, len(FEATURES))), np.zeros(0))
    chosen = known.where(hash_share("_id", min(1.0, rows / n)))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = features(utf8_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.tolist(), pa.list_(pa.float64()))], ["id", "y", "x"])

    # about ``rows`` ids at most: small enough to send to the documents
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    texts = own.join(F.broadcast(chosen), "_id").select("_id", "text", "y")
    taken = sorted((r["id"], r["y"], r["x"]) for r in texts.mapInArrow(take, "id long, y int, x array<double>").collect())
    x = np.array([r[2] for r in taken]).reshape(-1, len(FEATURES))
    return train(x, np.array([r[1] for r in taken], float))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = shared.value.score(features(utf8_of(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(mark, "doc_id long, score double")
