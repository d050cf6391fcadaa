"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is a vector over hashed letter n-grams (one to three characters, words padded by a
space), weighted by logarithmic counts and inverse document frequency and normalised.
Each language has several centroids, found by clustering (spherical k-means) all of its
documents. A text gets the language of the centroid with the largest cosine; it is
rejected if that cosine is below the language's limit for texts of its length. The limit
lies between what nearly all of the language's own documents reach and what nearly all
documents of other languages stay under, both cut to that length.

Document frequencies, centroids and limits are learned from all learnable documents. Their
n-gram counts are written once; each round of clustering is one pass over them that sends
back a sum for each centroid. Quantiles are read off counts in ``STEPS`` bins of cosines.

Defined results: a null text or one without a letter is "und" with score 0 and is
rejected; documents with a null lang are not learned from; a table without learnable
documents gives "und" everywhere; rows that repeat a doc_id keep a row each; other columns
are left as they are.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import bounded, crc_of_id, fresh_name, pieces, with_text
from tidepanel.llm.exact_dedup import among, route_bitmap
from tidepanel.session import stage

BINS = 1 << 13
CENTROIDS = 3
ROUNDS = 12
# Centroids that turn by less than this cosine distance have settled.
SETTLED = 1e-4
# Bins in which cosines are counted.
STEPS = 1 << 12
# Cosines that nearly all of a language's own documents reach, and that nearly all
# documents of other languages stay under.
REJECT_QUANTILE = 0.002
FOREIGN_QUANTILE = 0.99
# The least limit as a part of the first, and the limit where a single language is known.
REJECT_PART = 0.5
# Letters from which on a text has the limit of the next length.
LENGTHS = (16, 32, 64, 128, 256, 512, 1024, 2048)
# Cosine difference that counts as sure when scores are compared between languages.
SURE = 0.05

_GAP = re.compile(r"[\W\d_]+")
# Latin-1 in lower case, a space for what stands between words.
_LATIN = bytes(32 if _GAP.match(chr(i)) else ord(chr(i).lower()) for i in range(256))
_MIX = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


def code_points(words: str) -> np.ndarray:
    return np.frombuffer(words.encode("utf-32-le"), "<u4")


@cache
def gaps() -> np.ndarray:
    """Whether a character stands between words, by code point."""
    found = np.zeros(sys.maxunicode + 1, bool)
    for run in _GAP.finditer("".join(map(chr, range(len(found))))):
        found[slice(*run.span())] = True
    return found


def letters(text: str | None) -> str:
    """Lower-case words with single spaces around them; empty if there is no letter."""
    if not text:
        return ""
    try:
        words = b" ".join(text.encode("latin-1").translate(_LATIN).split()).decode("latin-1")
    except UnicodeEncodeError:
        c = code_points(text.lower())
        gap = gaps()[c]
        kept = ~gap
        kept[1:] |= ~gap[:-1]  # and what follows a letter
        words = np.where(gap, np.uint32(32), c)[kept].tobytes().decode("utf-32-le").strip()
    return f" {words} " if any(c.isalpha() for c in words) else ""


def level(words: str) -> int:
    """The place of a text's limit: 0 for the shortest, one more for each of LENGTHS reached."""
    return int(np.searchsorted(LENGTHS, len(words), side="right"))


def bins_of(hashes: list[np.ndarray]) -> np.ndarray:
    """The bins of grams with these hashes, one array's after another's."""
    h = np.concatenate(hashes)
    h ^= h >> np.uint32(15)
    h *= _MIX[1]
    h >>= np.uint32(32 - 13)
    return h.astype(np.int64)


def gram_hashes(c: np.ndarray) -> list[np.ndarray]:
    """Hashes of a text's one-, two- and three-letter grams, by where they start."""
    one = c * _MIX[0]
    two = one[:-1] + c[1:] * _MIX[1]
    return [one, two, two[:-1] + c[2:] * _MIX[2]]


def gram_counts(words: str) -> np.ndarray:
    return np.bincount(bins_of(gram_hashes(code_points(words))), minlength=BINS)


# Places from which on a character is past the beginnings cut for each level, and by place the
# first level that holds what ends there.
_ENDS = np.array((LENGTHS[0] // 2, *LENGTHS)) - 1
_LEVEL_AT = np.searchsorted(_ENDS, np.arange(LENGTHS[-1]), side="right")


def cut_counts(words: str) -> tuple[np.ndarray, np.ndarray]:
    """The bins in use, in order, and by level the counts in them of a text's beginnings, cut to
    the lengths at which levels start (texts under the first length have the limit of half of
    it) and closed by a space."""
    ends = _ENDS[_ENDS < len(words)]
    c = code_points(words)
    inside = gram_hashes(c)
    last, space = c[ends - 1], np.full(len(ends), 32, np.uint32)
    closing = space * _MIX[0], last * _MIX[0] + space * _MIX[1], c[ends - 2] * _MIX[0] + last * _MIX[1] + space * _MIX[2]
    bins = bins_of([*inside, *closing])
    there = np.zeros(BINS, bool)
    there[bins] = True
    used = np.flatnonzero(there)
    spot = np.empty(BINS, np.int64)
    spot[used] = np.arange(len(used))
    spots = spot[bins]
    at = np.concatenate([_LEVEL_AT[k : k + len(h)] for k, h in enumerate(inside)])
    n = len(ends) * len(used)
    counts = np.bincount(at * len(used) + spots[: len(at)], minlength=n)[:n].reshape(-1, len(used)).cumsum(axis=0)
    np.add.at(counts.reshape(-1), np.tile(np.arange(len(ends)) * len(used), 3) + spots[len(at) :], 1)
    return used, counts


_LOGS = np.log1p(np.arange(1 << 13))
_LOGS_32 = np.log1p(np.arange(1 << 13), dtype=np.float32)


def logs_of(counts: np.ndarray, table: np.ndarray = _LOGS) -> np.ndarray:
    """Logarithms of one more than the counts; all but large ones are read off a table."""
    return table.take(counts) if counts.max(initial=0) < len(table) else np.log1p(counts, dtype=table.dtype)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The vector of a text with these counts."""
    v = (logs_of(counts) * idf).astype(np.float32)
    return v / np.maximum(np.sqrt((v * v).sum()), np.float32(1e-12))


def weigh(counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    return np.stack([vector(c, idf) for c in counts])


@dataclass
class Centroids:
    idf: np.ndarray
    languages: list[str]
    vectors: np.ndarray  # one row per centroid
    owner: np.ndarray  # its language's place
    least: np.ndarray  # by length and language, the cosine under which a text is rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected."""
        words = [letters(t) for t in texts]
        some = [i for i, w in enumerate(words) if w]
        found, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if some and self.languages:
            cosines = np.stack([vector(gram_counts(words[i]), self.idf) for i in some]) @ self.vectors.T
            nearest = cosines.argmax(axis=1)
            best = np.stack([cosines[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
            likely = np.exp((best - best.max(axis=1, keepdims=True)) / SURE)
            score[some] = 1 / likely.sum(axis=1)
            rejected[some] = cosines[np.arange(len(some)), nearest] < self.least[[level(words[i]) for i in some], self.owner[nearest]]
            for i, k in zip(some, self.owner[nearest].tolist(), strict=True):
                found[i] = self.languages[k]
        return found, score, rejected


@dataclass
class Distinct:
    """Counted documents without copies: of those whose hash repeats, one of each; the others
    are left where they are written, told apart by a bitmap of bounded size."""

    rows: DataFrame  # lang, bits, counts, same (null: stays in any case)
    repeated: Broadcast

    def each(self, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        repeated = self.repeated

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, bitmap = repeated.value
            for batch in batches:
                same = batch.column(3)
                slots = (same.fill_null(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                hit = (bitmap[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)
                yield batch.filter(pa.array(~hit | same.is_null().to_numpy(zero_copy_only=False)))

        return self.rows.mapInArrow(lambda batches: work(pieces(kept(batches), 256)), schema)


def distinct_of(counted: DataFrame) -> Distinct:
    """``counted`` has lang, bits, counts and same, a hash of them."""
    hashes = stage(counted.groupBy("same").count().where("count > 1").select(F.col("same").alias("fp")), "repeated-grams")
    bits, bitmap = route_bitmap(hashes, hashes.count())
    rows = counted.select("lang", "bits", "counts", "same")
    copies = among(rows, "same", hashes, hashed=True).select("lang", "bits", "counts").dropDuplicates()
    copies = stage(copies, "copied-grams").withColumn("same", F.lit(None).cast("long"))
    return Distinct(rows.unionByName(copies), counted.sparkSession.sparkContext.broadcast((bits, bitmap)))


def places_of_bits(packed: np.ndarray) -> np.ndarray:
    """Places of the bits that are set, from the bytes that have any."""
    some = np.flatnonzero(packed != 0)
    at = np.flatnonzero(np.unpackbits(packed[some]).view(bool))
    return 8 * some[at >> 3] + (at & 7)


# Least wide numbers come first.
_COUNTS = "u1", "<u2", "<u4"


def packed_counts(counts: np.ndarray) -> bytes:
    return counts.astype(_COUNTS[np.searchsorted([1 << 8, 1 << 16], counts.max(), side="right")]).tobytes()


def unpacked_counts(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n}")


def vectors_of(batch: pa.RecordBatch, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of what is not 0 in the vectors of the documents counted in a
    batch (columns ``bits`` and ``counts``)."""
    bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    place = places_of_bits(bits.ravel()) & (BINS - 1)
    sizes = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    counts = np.concatenate([unpacked_counts(c, n) for c, n in zip(batch.column("counts").to_pylist(), sizes.tolist(), strict=True)])
    v = logs_of(counts, _LOGS_32) * idf.astype(np.float32)[place]
    lengths = np.sqrt(np.add.reduceat(v * v, np.cumsum(sizes) - sizes, dtype=np.float64))
    return row, place, v / np.repeat(lengths.astype(np.float32), sizes)


def turned_centres(centres: np.ndarray) -> np.ndarray:
    """Rows of the centres' values, by language and bin."""
    return np.ascontiguousarray(centres.transpose(0, 2, 1), np.float32).reshape(-1, centres.shape[1])


def own_cosines(batch: pa.RecordBatch, idf: np.ndarray, languages: list[str], turned: np.ndarray) -> tuple:
    """The batch's vectors, the place of each document's language, and its cosine to each
    of that language's centres (``turned_centres``)."""
    row, place, v = vectors_of(batch, idf)
    own = np.array([languages.index(x) for x in batch.column("lang").to_pylist()])
    first = np.searchsorted(row, np.arange(len(own)))  # every document has letters
    return (row, place, v), own, np.add.reduceat(v[:, None] * turned.take(own[row] * BINS + place, axis=0), first)


def centre_sums(counted: Distinct, idf: np.ndarray, languages: list[str], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of all documents' vectors by language and nearest centre."""
    slots = centres.shape[1]
    shared = counted.rows.sparkSession.sparkContext.broadcast(turned_centres(centres))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(languages) * slots * BINS), np.zeros(len(languages) * slots, np.int64)
        for batch in batches:
            (row, place, v), own, cosines = own_cosines(batch, idf, languages, shared.value)
            slot = own * slots + cosines.argmax(axis=1)
            sums += np.bincount(slot[row] * BINS + place, v, minlength=len(sums))
            n += np.bincount(slot, minlength=len(n))
        used = np.flatnonzero(n)
        values = [sums[k * BINS : (k + 1) * BINS].astype("<f4").tobytes() for k in used.tolist()]
        yield pa.RecordBatch.from_pydict({"slot": used, "n": n[used], "sum": pa.array(values, pa.binary())})

    def total(group: pd.DataFrame) -> pd.DataFrame:
        """Of one row a task."""
        parts = np.stack(sorted((np.frombuffer(x, "<f4") for x in group["sum"]), key=lambda x: x.tobytes()))
        return pd.DataFrame({"slot": group["slot"].iloc[:1], "n": [int(group["n"].sum())], "sum": [parts.sum(axis=0, dtype=np.float64).tobytes()]})

    sums, n = np.zeros((len(languages), slots, BINS)), np.zeros((len(languages), slots), np.int64)
    tasks = counted.each(add_up, "slot long, n long, sum binary")
    for slot, count, values in tasks.groupBy("slot").applyInPandas(total, "slot long, n long, sum binary").collect():  # a row per centre
        sums[divmod(slot, slots)], n[divmod(slot, slots)] = np.frombuffer(values), count
    return sums, n


def quantiles(counts: DataFrame, keys: list[str], shares: list[float]) -> list:
    """Per key, the quantiles (between two values where a rank lies between them) of cosines
    counted in bins; ``counts`` has the keys, bin and n."""
    upto = Window.partitionBy(*keys).orderBy("bin")  # at most STEPS rows
    summed = counts.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    x = summed.select(*keys, "bin", F.sum("n").over(upto).alias("upto"), (F.sum("n").over(Window.partitionBy(*keys)) - 1).alias("last"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("bin")))
    found = []
    for q in shares:
        rank = F.col("last") * q
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        found.append((low + F.max(rank - F.floor(rank)) * (high - low) + 0.5) / STEPS)
    return x.groupBy(*keys).agg(F.array(*found).alias("values")).collect()


def step(cosines: np.ndarray) -> np.ndarray:
    return np.clip((cosines * STEPS).astype(np.int64), 0, STEPS - 1)


def starts_of(counted: Distinct, idf: np.ndarray, languages: list[str], means: np.ndarray, k: int) -> np.ndarray:
    """Per language the vectors of the documents at ``k`` evenly spaced ranks of nearness to
    its mean, or next to them."""
    shared = counted.rows.sparkSession.sparkContext.broadcast(turned_centres(means))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(languages) * STEPS, np.int64)
        for batch in batches:
            _, own, cosines = own_cosines(batch, idf, languages, shared.value)
            n += np.bincount(own * STEPS + step(cosines[:, 0]), minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"k": used // STEPS, "bin": used % STEPS, "n": n[used]})

    ranks = np.zeros((len(languages), k))
    for own, values in quantiles(counted.each(near, "k long, bin long, n long"), ["k"], [(2 * c + 1) / (2 * k) for c in range(k)]):
        ranks[own] = values

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            _, own, cosines = own_cosines(batch, idf, languages, shared.value)
            gap = np.abs(cosines[:, :1] - ranks[own])
            for lang in np.unique(own).tolist():
                mine = np.flatnonzero(own == lang)
                for c in range(k):
                    at = int(mine[gap[mine, c].argmin()])
                    one = float(gap[at, c]), batch["bits"][at].as_py(), batch["counts"][at].as_py()
                    best[lang, c] = min(one, best.get((lang, c), one))
        if best:
            (at, one) = zip(*best.items(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*zip(*at, strict=True), *zip(*one, strict=True))], ["own", "c", "gap", "bits", "counts"])

    found = counted.each(nearest, "own long, c long, gap double, bits binary, counts binary")
    starts = np.zeros((len(languages), k, BINS))
    for own, c, one in found.groupBy("own", "c").agg(F.min(F.struct("gap", "bits", "counts"))).collect():  # a row per centre
        _, place, v = vectors_of(pa.RecordBatch.from_pydict({"bits": [bytes(one["bits"])], "counts": [bytes(one["counts"])]}), idf)
        starts[own, c, place] = v
    return starts


def unit(sums: np.ndarray) -> np.ndarray:
    return sums / np.maximum(np.linalg.norm(sums, axis=-1, keepdims=True), 1e-12)


def cluster(counted: Distinct, idf: np.ndarray, languages: list[str], k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of every language's documents: centres (languages x k x bins) and
    whether any document is theirs. Starts from documents at evenly spaced ranks of nearness to
    the language's mean, so that odd ones found no cluster."""
    nothing = np.zeros((len(languages), 1, BINS))
    means = unit(centre_sums(counted, idf, languages, nothing)[0])
    centres = starts_of(counted, idf, languages, means, k)
    there = np.ones(centres.shape[:2], bool)
    for _ in range(rounds):
        sums, n = centre_sums(counted, idf, languages, centres)
        there &= n > 0  # cosines to a centre of no documents are 0 and win none
        new = unit(sums)
        turned = (1 - (new * centres).sum(axis=-1))[there].max()
        centres = new
        if turned < SETTLED:
            break
    return centres, there


def fit(
    docs: DataFrame,
    learnable: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    centroids: int = CENTROIDS,
) -> Centroids:
    """Learn from the rows where ``learnable`` holds and the language is known."""
    rows = docs.where(learnable & F.col(lang_col).isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents' counts, then the task's document frequencies."""
        df, n = np.zeros(BINS, np.int64), 0
        for batch in bounded(batches, 0, rows=512):
            out = []
            for text, lang in zip(*[batch.column(c).to_pylist() for c in range(2)], strict=True):
                if words := letters(text):
                    counts = gram_counts(words)
                    there = counts > 0
                    df += there
                    n += 1
                    out.append((lang, np.packbits(there).tobytes(), packed_counts(counts[there]), words[: LENGTHS[-1]]))
            if out:
                lang, bits, counts, start = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": lang, "bits": bits, "counts": counts, "start": start, "bin": pa.nulls(len(out), pa.int32()), "df": pa.nulls(len(out), pa.int64())}
                )
        used = np.append(np.flatnonzero(df), BINS)  # the last bin holds the number of documents
        none = [pa.nulls(len(used), t) for t in (pa.string(), pa.binary(), pa.binary(), pa.string())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int32()), pa.array(np.append(df[df > 0], n))], ["lang", "bits", "counts", "start", "bin", "df"])

    counted = rows.select(text_col, lang_col).mapInArrow(count, "lang string, bits binary, counts binary, start string, bin int, df long")
    counted = stage(counted.withColumn("same", F.xxhash64("lang", "bits", "counts")), "grams")
    df = np.zeros(BINS + 1)
    for row in counted.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("df")).collect():  # at most BINS + 1 rows
        df[row[0]] = row[1]
    idf = np.log((1 + df[BINS]) / (1 + df[:BINS])) + 1
    counted = counted.where("bin IS NULL")
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())  # one row per language
    if not languages:
        return Centroids(np.ones(BINS), [], np.empty((0, BINS), np.float32), np.empty(0, int), np.empty((len(LENGTHS) + 1, 0)))
    centres, there = cluster(distinct_of(counted), idf, languages, centroids)  # copies found no cluster of their own
    model = Centroids(idf, languages, centres[there].astype(np.float32), np.nonzero(there)[0], np.zeros((len(LENGTHS) + 1, len(languages))))
    model.least = limits(counted.select("lang", "start"), model)
    return model


def limits(starts: DataFrame, model: Centroids) -> np.ndarray:
    """By length and language, the cosine under which a text is rejected."""
    shared = starts.sparkSession.sparkContext.broadcast(model)
    size = len(model.languages), len(LENGTHS) + 1, 2, STEPS

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the nearest cosines of every language to the beginnings of every document."""
        m, n = shared.value, np.zeros(size, np.int64)
        turned = np.ascontiguousarray(m.vectors.T, np.float64)
        starts = np.searchsorted(m.owner, np.arange(len(m.languages)))  # every language has centroids
        for batch in pieces(batches, 64):
            owners, nearest = [], []
            for lang, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if len(start) < LENGTHS[0] // 2:
                    continue
                used, counts = cut_counts(start)
                v = logs_of(counts) * m.idf[used]
                cosines = v @ turned[used] / np.sqrt((v * v).sum(axis=1))[:, None]
                nearest.append(np.maximum.reduceat(cosines, starts, axis=1))
                owners.append(m.languages.index(lang))
            if nearest:
                held = [len(x) for x in nearest]
                levels = np.concatenate([np.arange(k) for k in held])[:, None]
                own = np.repeat(owners, held)[:, None] == np.arange(size[0])
                at = step(np.concatenate(nearest)) + STEPS * (own + 2 * (levels + size[1] * np.arange(size[0])))
                np.add.at(n.reshape(-1), at.ravel(), 1)
        k, level, own, at = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"k": k, "level": level, "own": own.astype(bool), "bin": at, "n": n[n > 0]})

    counts = starts.mapInArrow(compare, "k long, level long, own boolean, bin long, n long")
    low, foreign = np.full((2, len(LENGTHS) + 1, len(model.languages)), np.nan)
    for k, at, own, values in quantiles(counts, ["k", "level", "own"], [REJECT_QUANTILE, FOREIGN_QUANTILE]):
        if own:
            low[at, k] = values[0]
        else:
            foreign[at, k] = values[1]
    between = np.minimum(low, np.maximum(REJECT_PART * low, (low + foreign) / 2))
    least = np.where(np.isnan(foreign), REJECT_PART * low, between)
    for at in range(1, len(least)):  # longer than any learned from: the longest's limit
        least[at] = np.where(np.isnan(least[at]), least[at - 1], least[at])
    return np.nan_to_num(least)


PREDICTED = ("_lang", "_score", "_rejected")


def identify(docs: DataFrame, model: Centroids, keep: list[str], text_col: str = "text", names: tuple[str, str, str] = PREDICTED) -> DataFrame:
    """The columns of ``keep`` with language, score and whether it is rejected, so named."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    rows, spot = with_text(docs, keep, text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, spot, rows=256):
            lang, score, rejected = shared.value.predict(batch.column(spot).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                [*keep, *names],
            )

    own = zip(names, ("string", "double", "boolean"), strict=True)
    schema = [*[(f.name, f.dataType.simpleString()) for f in kept.schema], *own]
    return rows.mapInArrow(predict, ", ".join(f"`{c}` {t}" for c, t in schema))


def learnable(id_col: str = "doc_id") -> Column:
    """Rows whose language may be learned from; the others are held out."""
    return F.pmod(crc_of_id(id_col), F.lit(5)) != 0


def keep_identified(docs: DataFrame, **how: int) -> DataFrame:
    """Documents near enough to a language they could be learned from."""
    model = fit(docs, learnable(), **how)
    names = tuple(fresh_name(docs.columns, c) for c in PREDICTED)
    found = identify(docs, model, docs.columns, names=names)
    return found.where(~F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])
