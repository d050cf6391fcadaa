"""Resampling documents towards a target distribution by hashed word and pair features.

A text's features are its runs of one and two consecutive words; a feature's bucket is the
crc32 of its bytes modulo the number of buckets. The log ratio of a bucket's share in the
target to its share in the documents is its gain, a document's weight the mean gain of its
features, and documents are drawn without replacement by weight plus Gumbel noise that a
hash of the id fixes.

Head and tail: the most frequent words of the documents are sent to all tasks with their
CRC states. The bucket of a pair of very frequent words is read from a table; that of two
head words follows from both states, since appending bytes to a CRC is linear; only
features with a word outside the head are hashed byte by byte. All ways give the same
bucket, so the head decides speed alone and the totals are exact.

Defined results: null and wordless texts have no features and weight 0; a null doc_id takes
the noise of the text "null" and comes last among ties; rows that repeat a doc_id are drawn
each for itself; an empty target has no counts, an empty table no rows; other columns are
not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import bounded, fresh_name, utf8_of
from tidepanel.llm.decontaminate import words_of
from tidepanel.session import stage

BUCKETS = 10_000
# Bounds of what goes to every task: words with their states, and a square table of
# 16-bit buckets for the pairs of the first of them (8 MB).
HEAD_WORDS = 1 << 16
PAIR_WORDS = 1 << 11
# Longer words are tail words.
HEAD_BYTES = 48
# Different words a counting task holds before it hands them on.
HELD_WORDS = 200_000
SCORE_BLOCK = 4


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1).astype(np.uint32)
    return x


def _shifts(longest: int) -> np.ndarray:
    """[n, k, v]: the CRC whose k-th byte is v (others zero) after n further zero bytes."""
    table = _crc_table()
    x = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    found = [x]
    for _ in range(longest):
        x = table[x & 255] ^ (x >> 8)
        found.append(x)
    return np.stack(found)


class Head:
    """Frequent words, most frequent first, with what gives the buckets of their features."""

    def __init__(self, words: list[bytes], buckets: int = BUCKETS, pair_words: int = PAIR_WORDS):
        self.buckets = buckets
        self.place = {w: k for k, w in enumerate(words)}
        self._crc = np.array([zlib.crc32(w) for w in words] or [0], np.uint32)
        self._state = np.array([zlib.crc32(w + b" ") for w in words] or [0], np.uint32)
        self._length = np.array([len(w) for w in words] or [0], np.int64)
        self._shift = _shifts(int(self._length.max()))
        self._single = (self._crc % buckets).astype(np.int32)
        self._square = min(len(words), pair_words)
        own = np.arange(self._square)
        kind = np.uint16 if buckets <= 1 << 16 else np.uint32
        self._pairs = np.empty((self._square, self._square), kind)
        for a in range(self._square):
            self._pairs[a] = self._joined(np.full(self._square, a), own)
        self._pairs = self._pairs.ravel()

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Buckets of pairs of head words by their states."""
        state, n = self._state[a], self._length[b]
        moved = self._shift[n, 0, state & 255]
        for k in range(1, 4):
            moved ^= self._shift[n, k, state >> np.uint32(8 * k) & 255]
        return (moved ^ self._crc[b]) % np.uint32(self.buckets)

    def features(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all single words and of all pairs, each with the place of its text."""
        flat = [w for words in docs for w in words]
        owner = np.repeat(np.arange(len(docs)), [len(words) for words in docs])
        ids = np.fromiter(map(self.place.get, flat, repeat(-1)), np.int64, len(flat))
        crc = zlib.crc32
        known = ids >= 0
        single = self._single[ids]
        tail = np.flatnonzero(~known)
        single[tail] = np.array([crc(flat[i]) for i in tail.tolist()], np.uint32) % np.uint32(self.buckets)

        first = np.flatnonzero(owner[1:] == owner[:-1])
        a, b = ids[first], ids[first + 1]
        pair = np.empty(len(first), np.int32)
        both = known[first] & known[first + 1]
        dense = both & (a < self._square) & (b < self._square)
        pair[dense] = self._pairs[a[dense] * self._square + b[dense]]
        head = both & ~dense
        pair[head] = self._joined(a[head], b[head])
        tail = np.flatnonzero(~both)
        at, states = first[tail].tolist(), self._state.tolist()
        hashed = [crc(flat[i + 1], states[k] if k >= 0 else crc(flat[i] + b" ")) for i, k in zip(at, a[tail].tolist(), strict=True)]
        pair[tail] = np.array(hashed, np.uint32) % np.uint32(self.buckets)
        return single, owner, pair, owner[first]


_HEADS: dict[str, Head] = {}


@dataclass
class Vocabulary:
    """The head as it goes to the tasks; each worker process builds its tables once."""

    key: str
    words: Broadcast
    buckets: int

    def head(self) -> Head:
        if self.key not in _HEADS:
            _HEADS.clear()
            _HEADS[self.key] = Head(self.words.value, self.buckets)
        return _HEADS[self.key]


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))


def frequent_words(docs: DataFrame, words: int = HEAD_WORDS, buckets: int = BUCKETS, text_col: str = "text") -> Vocabulary:
    """The most frequent words, counted over all documents; at most ``words`` of them."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in bounded(batches, 0):
            for text in utf8_of(batch.column(0)):
                counts.update(words_of(text))
            if len(counts) > HELD_WORDS:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    counted = _texts(docs, text_col).mapInArrow(count, "word binary, n long").where(F.octet_length("word") <= HEAD_BYTES)
    size = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    totals = stage(counted.groupBy("word").agg(F.sum("n").alias("n")).withColumn("size", size), "word-counts")
    # at most 8 * 63 sizes; those that fit as a whole make the head
    sizes = sorted(totals.groupBy("size").count().collect(), reverse=True)
    fits = [s for (s, _), n in zip(sizes, accumulate(n for _, n in sizes), strict=True) if n <= words]
    top = totals.where(F.col("size") >= fits[-1]).select("word", "n").collect() if fits else []
    found = [bytes(r[0]) for r in sorted(top, key=lambda r: (-r[1], bytes(r[0])))]
    return Vocabulary(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(found), buckets)


def bucket_totals(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> np.ndarray:
    """Features per bucket over all rows; each task hands on one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, total = vocabulary.head(), np.zeros(vocabulary.buckets, np.int64)
        for batch in bounded(batches, 0):
            single, _, pair, _ = head.features([words_of(t) for t in utf8_of(batch.column(0))])
            total += np.bincount(single, minlength=len(total)) + np.bincount(pair, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counted = _texts(docs, text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(vocabulary.buckets, np.int64)
    for bucket, n in counted.collect():  # one row a bucket
        found[bucket] = n
    return found


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1) * (all_source + n) / ((s + 1) * (all_target + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, vocabulary: Vocabulary, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight (the mean gain, rounded down)."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gain = vocabulary.head(), sent.value
        for batch in bounded(batches, 1):
            words = [words_of(t) for t in utf8_of(batch.column(1))]
            single, owner, pair, pair_owner = head.features(words)
            # whole numbers below 2**53 are exact in doubles
            total = np.bincount(owner, gain[single], len(words)) + np.bincount(pair_owner, gain[pair], len(words))
            n = np.array([len(w) for w in words], np.int64)
            features = n + np.maximum(n - 1, 0)
            weight = total.astype(np.int64) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, id_col: str = "doc_id") -> Column:
    """Gumbel noise in thousandths from the sha256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(weighed: DataFrame, percent: int, min_words: int, seed: int) -> DataFrame:
    """Adds score and rank; of the rows with ``min_words`` words the given percentage with the
    highest scores has a rank, in that order, ties by smaller doc_id.

    Ranks come without gathering the rows: the driver adds up row counts of score blocks
    (their number is bounded by the range of scores), and only rows of one block are sorted
    against each other. The noise spreads equal weights over thousands of scores.
    """
    scored = stage(weighed.withColumn("score", F.col("weight") + noise(seed)), "weighed")
    block = F.floor(F.col("score") / SCORE_BLOCK)
    fit = F.col("n_words") >= min_words
    counts = sorted(scored.where(fit).groupBy(block.alias("block")).count().collect(), reverse=True)
    wanted = sum(n for _, n in counts) * percent // 100
    before, offsets = 0, []
    for at, n in counts:
        if before >= wanted:
            break
        offsets.append((at, before))
        before += n
    columns = [*scored.columns, "rank"]
    none = F.lit(None).cast("long")
    if not offsets:
        return scored.withColumn("rank", none)
    in_reach = fit & (block >= offsets[-1][0])
    places = F.broadcast(scored.sparkSession.createDataFrame(offsets, "block long, before long"))
    order = Window.partitionBy("block").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "n_words")
    ranked = scored.where(in_reach).withColumn("block", block).join(places, "block")
    rank = F.row_number().over(order) + F.col("before")
    ranked = ranked.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.where(~in_reach).withColumn("rank", none)
    return ranked.select(columns).unionByName(rest.select(columns))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    min_words: int = 20,
    seed: int = 7,
    buckets: int = BUCKETS,
    head_words: int = HEAD_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight, score, rank (null if not drawn)."""
    vocabulary = frequent_words(docs, head_words, buckets, text_col)
    gains = gains_of(bucket_totals(docs, vocabulary, text_col), bucket_totals(target, vocabulary, target_col))
    return draw(weigh(docs, vocabulary, gains, id_col, text_col), percent, min_words, seed)


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The drawn rows of ``docs`` themselves; ids must tell rows apart."""
    drawn = fresh_name(docs.columns, "drawn")
    ranked = resample(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias(drawn))
    return docs.join(ranked, F.col(f"`{id_col}`").cast("long") == F.col(drawn), "left_semi")
