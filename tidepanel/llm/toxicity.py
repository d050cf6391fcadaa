"""Toxicity by a logistic model with a counterfactual penalty.

Features are the words of a text and the beginnings of its longer words, which stand for
stems (lower case, present or not), out of a vocabulary chosen on labelled rows. Labelled texts that mention a group are written once more with the
group's name swapped for others of its kind, and training adds a penalty on the squared
change of the logit between the two. Names of groups so cannot carry the score, and
neutral mentions stay neutral. Rare words are kept out by an L1 penalty; the words it
leaves are fitted again without it.

Learned from at most about ``FIT_ROWS`` labelled rows, chosen by a hash of their ids, and
a vocabulary of at most ``VOCABULARY`` words. Texts are scored as a whole.

Defined results: null, empty and wordless texts get the score of no words; rows with a
null label or without a document are not learned from; if only one class is labelled,
every score is the share of label 1 (0.5 without labels); rows that repeat a doc_id keep a
row each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import hash_share, pieces, texts_of
from tidepanel.session import stage

FIT_ROWS = 20_000
VOCABULARY = 4_096
LEAST_DOCUMENTS = 5
COUNTERFACTUAL = 1.0
# Times the square root of the rows: noise in a word's counts shrinks with more rows.
L1 = 0.06
L2 = 3e-5
# Letters of the beginnings of words.
STEMS = (4, 5, 6, 7)

# Names of groups, by kind; each may stand for another of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "ladies", "gentlemen"),
    ("woman", "man", "girl", "boy", "lady", "gentleman"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "heterosexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "paralyzed"),
    ("frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
)

_WORD = re.compile(r"[^\W\d_]+")


def with_stems(words: set[str]) -> set[str]:
    """Words, and the stems that longer ones may have, with a dash."""
    return words.union([f"{w[:k]}-" for k in STEMS for w in words if len(w) > k])


def features_of(text: str) -> set[str]:
    """The words of a text and their stems."""
    return with_stems(set(_WORD.findall(text.lower())))


@dataclass
class WordModel:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        logit = self.bias + sum(self.weights[w] for w in sorted(features_of(text) & self.weights.keys()))
        return float(1 / (1 + np.exp(-logit)))


@dataclass
class Rows:
    """A sparse 0/1 matrix: the features of row ``row[k]`` include ``col[k]``."""

    row: np.ndarray
    col: np.ndarray
    n_rows: int
    n_cols: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.n_rows)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row], minlength=self.n_cols)


@dataclass
class Changes:
    """What swaps do to the features of texts: ``sign[k]`` (1 or -1) is the change of the
    feature ``col[k]`` by the swap ``row[k]``, which is weighed by ``n``."""

    row: np.ndarray
    col: np.ndarray
    sign: np.ndarray
    n: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.sign * w[self.col], minlength=len(self.n))

    def back(self, r: np.ndarray, n_cols: int) -> np.ndarray:
        return np.bincount(self.col, self.sign * r[self.row], minlength=n_cols)

    def steepness(self, n_cols: int) -> float:
        """An upper bound of the curvature of the weighted squared changes."""
        width = np.bincount(self.row, minlength=len(self.n))
        return float(np.bincount(self.col, (self.n * width)[self.row], minlength=n_cols).max(initial=0))


def swaps(features: set[str], place: dict[str, int]) -> Iterator[tuple[tuple[int, ...], tuple[int, ...], float]]:
    """(features gained, features lost, weight) of a text when a group's name in it is
    written as each other of its kind, and when it is left out; stems change with it."""
    for kind in IDENTITY:
        for a in kind:
            if a not in features:
                continue
            rest = with_stems({w for w in features if not w.endswith("-") and w != a})
            for b in (*kind, None):
                if b != a:
                    new = rest | with_stems({b} if b else set())
                    gained = tuple(sorted(place[f] for f in new - features if f in place))
                    lost = tuple(sorted(place[f] for f in features - new if f in place))
                    if gained or lost:
                        yield gained, lost, 1 / (len(kind) - 1) if b else 1.0


def gathered(found: Iterable[tuple[tuple[int, ...], tuple[int, ...], float]]) -> Changes:
    """Swaps as a matrix, one row for those that change the same features."""
    total: dict[tuple, float] = {}
    for gained, lost, n in found:
        total[gained, lost] = total.get((gained, lost), 0.0) + n
    keys = sorted(total)
    cells = [(k, c, sign) for k, key in enumerate(keys) for part, sign in zip(key, (1.0, -1.0), strict=True) for c in part]
    row, col, sign = (np.array(c) for c in zip(*cells, strict=True)) if cells else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return Changes(row, col, sign, np.array([total[k] for k in keys]))


def train(x: Rows, y: np.ndarray, vocabulary: list[str], changes: Changes | None = None, rounds: int = 300) -> WordModel:
    """Proximal gradient descent with momentum on the weighted log loss, the counterfactual
    penalty and L1; then once more without L1 on the features it leaves. ``changes`` are
    those of the sample's whole texts; without them the rows' features stand for the texts."""
    positive = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or positive in (0.0, 1.0):
        p = min(max(positive, 1e-6), 1 - 1e-6)
        return WordModel(float(np.log(p / (1 - p))))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both classes weigh the same
    if changes is None:
        place = {w: k for k, w in enumerate(vocabulary)}
        held: list[set[str]] = [set() for _ in range(x.n_rows)]
        for r, c in zip(x.row.tolist(), x.col.tolist(), strict=True):
            held[r].add(vocabulary[c])
        changes = gathered(c for features in held for c in swaps(features, place))
    unlike = COUNTERFACTUAL / len(y)
    size = np.bincount(x.row, minlength=x.n_rows).max(initial=0) + 1

    def descend(active: np.ndarray, l1: float, l2: float) -> tuple[float, np.ndarray]:
        w, b = np.zeros(x.n_cols), 0.0
        old_w, old_b, t = w, b, 1.0
        step = 1 / (0.25 * min(size, 64) + max(COUNTERFACTUAL, unlike * changes.steepness(x.n_cols)))
        for _ in range(rounds):
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            at_w, at_b = w + (t - 1) / t_new * (w - old_w), b + (t - 1) / t_new * (b - old_b)
            error = weight * (1 / (1 + np.exp(-np.clip(at_b + x.times(at_w), -40, 40))) - y)
            grad = x.back(error) + l2 * at_w
            if len(changes.n):
                grad = grad + changes.back(changes.times(at_w) * changes.n * unlike, x.n_cols)
            old_w, old_b, t = w, b, t_new
            w = at_w - step * grad
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0) * active
            b = at_b - step * error.sum()
        return b, w

    _, sparse = descend(np.ones(x.n_cols), L1 / np.sqrt(len(y)), L2)
    bias, w = descend((sparse != 0).astype(float), 0.0, L2)
    return WordModel(float(bias), {vocabulary[k]: float(w[k]) for k in np.flatnonzero(w)})


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = FIT_ROWS,
) -> WordModel:
    """Learn from labelled rows where ``learnable`` (a condition on the id) holds."""
    known = labels.where(learnable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
    n = known.count()
    if not n:
        return train(Rows(np.zeros(0, int), np.zeros(0, int), 0, 0), np.zeros(0), [])
    chosen = known.where(hash_share("_id", min(1.0, rows / n)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = [sorted(features_of(t)) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.list_(pa.string()))], ["id", "y", "words"])

    # about ``rows`` ids at most: small enough to send to the documents
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    texts = own.join(F.broadcast(chosen), "_id").select("_id", "text", "y")
    sample = stage(texts.mapInArrow(split, "id long, y int, words array<string>"), "toxic-sample")
    shares = sample.groupBy("y").count().collect()
    size = {r[0]: r[1] for r in shares}
    word = sample.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("n1"))
    p1 = (F.col("n1") + 0.5) / (size.get(1, 0) + 1)
    p0 = (F.col("n") - F.col("n1") + 0.5) / (size.get(0, 0) + 1)
    gain = p1 * F.log(p1 / p0) + p0 * F.log(p0 / p1)
    terms = [t for kind in IDENTITY for t in kind]
    ranked = word.where(F.col("n") >= LEAST_DOCUMENTS).orderBy(gain.desc(), "word").limit(VOCABULARY).select("word")
    named = word.where(F.col("word").isin(terms)).select("word")
    vocabulary = sorted({r[0] for r in ranked.unionByName(named).collect()})
    place = {w: k for k, w in enumerate(vocabulary)}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[place[w] for w in words if w in place] for words in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["id", "y", "places"])

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [c for words in batch.column(0).to_pylist() for c in swaps(set(words), place)]
            if found:
                gained, lost, n = zip(*found, strict=True)
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(gained, ints), pa.array(lost, ints), pa.array(n, pa.float64())], ["gained", "lost", "n"])

    # some rows for each pair of names: texts differ in the words that share a stem alone
    changed = sample.select("words").mapInArrow(swap, "gained array<int>, lost array<int>, n double").groupBy("gained", "lost").agg(F.sum("n").alias("n"))
    changes = gathered((tuple(r["gained"]), tuple(r["lost"]), round(r["n"], 6)) for r in changed.collect())

    # about ``rows`` rows of at most VOCABULARY small numbers
    coded = sorted((r["id"], r["y"], r["places"]) for r in sample.mapInArrow(code, "id long, y int, places array<int>").collect())
    lengths = [len(p) for _, _, p in coded]
    x = Rows(np.repeat(np.arange(len(coded)), lengths), np.array([k for _, _, p in coded for k in p], int), len(coded), len(vocabulary))
    return train(x, np.array([y for _, y, _ in coded], float), vocabulary, changes)


def score(docs: DataFrame, model: WordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            found = [shared.value.score(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(mark, "doc_id long, score double")
