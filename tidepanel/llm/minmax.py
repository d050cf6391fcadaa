"""Near-duplicates of word shingle sets by min-max hashing.

A text's set holds its distinct runs of ``shingle`` words. Under each permutation (a
product with an odd number) both the smallest and the largest value are kept, so a
signature of n values takes n / 2 evaluations a shingle; both agree between two sets with
the probability of their Jaccard similarity. The signature is cut into bands; sets that
agree in a whole band share a bucket. With the default 48 bands of 8 values a pair of
similarity 0.85 shares none with a probability of 2e-7, and less above it.

Only links of full sets count. Equal sets are one node. In each bucket of several nodes
the one with most neighbours is its centre; every other member is compared with it, which
ties a group of near copies together by as many comparisons as it has members. What a
bucket then holds of several components, but for its centre, goes on to the next round,
and after the last one all members of such a bucket are compared in tasks that skip what is
tied already; buckets above ``PART_ROWS`` nodes are cut into chunks and each pair of chunks
is a part. No pair that shares a bucket is lost, and none is compared once its components
are one.

Sets are held as 64-bit hashes of their shingles; that two shingles of a pair of texts fall
together has a probability below 1e-10 for sets of 20,000.

Defined results: texts with fewer words than a shingle are one shingle; null and wordless
texts have an empty set, are linked with nothing and stay; a null doc_id takes the name of
its component (null if no row of it has an id) and is not kept unless it has no words; rows
that repeat a doc_id keep a row each; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import bounded, utf8_of
from tidepanel.llm.components import components
from tidepanel.llm.exact_dedup import among
from tidepanel.session import stage

SHINGLE = 5
THRESHOLD = 85
BANDS = 48
ROWS = 8
# Rounds of comparing the members of a bucket with its centre.
ROUNDS = 2
PART_ROWS = 256
# Shingles hashed at a time.
BLOCK = 512


def multipliers(n: int, odd_seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Odd numbers by a fixed rule: mixed multiples of the golden ratio."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(odd_seed)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def shingle_hashes(words: list[bytes], known: dict[bytes, int], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``shingle`` words; ``known`` has those of words."""
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - shingle + 1
    x = np.zeros(n, np.uint64)
    for k, a in enumerate(multipliers(shingle, 0xD1B54A32D192ED03)):
        x += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(31))) * a
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(x ^ (x >> np.uint64(32)))


def signature(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Smallest values under all permutations, then largest ones."""
    least = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    most = np.zeros(len(by), np.uint64)
    for at in range(0, len(hashes), BLOCK):
        values = hashes[at : at + BLOCK, None] * by[None, :]
        np.minimum(least, values.min(axis=0), out=least)
        np.maximum(most, values.max(axis=0), out=most)
    return np.concatenate([least, most])


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, with the band's number mixed in."""
    key = np.arange(bands, dtype=np.uint64)
    for column in values.reshape(bands, rows).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _sets(batch: pa.RecordBatch, text: int, shingle: int) -> list[np.ndarray]:
    texts = [t.lower().split() for t in utf8_of(batch.column(text))]  # bytes: A-Z alone, and the six ASCII white-space characters
    known = {w: xxhash.xxh64_intdigest(w) for w in {w for words in texts for w in words}}
    return [shingle_hashes(words, known, shingle) for words in texts]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    x = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8")
    return int(x[0]), int(x[1])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def marked_rows(docs: DataFrame, shingle: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, row (a number), n (size of its set), hi and lo (its digest), bands."""
    if bands * rows % 2:
        raise ValueError("a signature has as many smallest as largest values")
    by = multipliers(bands * rows // 2)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        for batch in bounded(batches, 1):
            sets = _sets(batch, 1, shingle)
            digests = [_digest(s) for s in sets]
            keys = [band_keys(signature(s, by), bands, rows) if len(s) else none for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array([d[k] for d in digests], pa.int64()) for k in range(2)),
                    _lists(keys),
                ],
                ["doc_id", "row", "n", "hi", "lo", "bands"],
            )

    numbered = _rows(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(mark, "doc_id long, row long, n long, hi long, lo long, bands array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(node, n, hashes) of the given nodes, from the texts of the documents that stand for
    them (``least``), known by the digest of their set. Texts stay where they are read."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            sets = _sets(batch, 1, shingle)
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*(pa.array([d[k] for d in digests], pa.int64()) for k in range(2)), _lists(sets)], ["hi", "lo", "hashes"])

    own = among(_rows(docs, id_col, text_col), "doc_id", nodes.select("least"))
    found = own.mapInArrow(gather, "hi long, lo long, hashes array<long>").dropDuplicates(["hi", "lo"])
    return found.join(nodes.select("node", "hi", "lo"), ["hi", "lo"]).select("node", F.size("hashes").alias("n"), "hashes")


def _alike(n_a: Column, n_b: Column, both: Column, threshold: int) -> Column:
    return 100 * both >= threshold * (n_a + n_b - both)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    a = among(sets, "node", pairs.select("a")).select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("in_a"))
    b = among(sets, "node", pairs.select("b")).select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("in_b"))
    both = F.size(F.array_intersect("in_a", "in_b"))
    return pairs.join(b, "b").join(a, "a").where(_alike(F.col("n_a"), F.col("n_b"), both, threshold)).select("a", "b")


def _part_links(part: list[tuple[int, int, np.ndarray]], threshold: int) -> list[tuple[int, int]]:
    """Links in a part of (node, component, set) that tie its components together."""
    found, group = [], [c for _, c, _ in part]
    for i, (a, _, own) in enumerate(part):
        for j in range(i + 1, len(part)):
            b, _, other = part[j]
            small, large = sorted((len(own), len(other)))
            if group[i] == group[j] or 100 * small < threshold * large:
                continue
            both = small + large - len(np.union1d(own, other))
            if 100 * both >= threshold * (small + large - both):
                found.append((a, b))
                group = [group[i] if g == group[j] else g for g in group]
    return found


def rest_links(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links inside buckets; ``members`` has key, node and component."""
    large = members.groupBy("key").count().where(F.col("count") > PART_ROWS)
    large = stage(large.select("key", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("chunks")), "large-buckets")
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("chunks")).cast("int")
    dealt = (
        members.join(large, "key", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("node", "component", F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("part"))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        now = None

        def links() -> pa.RecordBatch:
            found = _part_links(held, threshold)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], ["a", "b"])

        for batch in batches:
            part, node, component = (batch.column(k).to_pylist() for k in range(3))
            sets = batch.column(3)
            for k in range(batch.num_rows):
                if part[k] != now:
                    yield links()
                    held, now = [], part[k]
                held.append((node[k], component[k], sets[k].values.to_numpy().copy()))
        yield links()

    return (
        dealt.join(among(sets, "node", members.select("node")).select("node", "hashes"), "node")
        .select("part", "node", "component", "hashes")
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(search, "a long, b long")
    )


def near_components(
    dealt: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, threshold: int, id_col: str, text_col: str
) -> DataFrame:
    """(node, component) of the nodes with links. ``dealt`` has key, node and n (the set's
    size); ``nodes`` what is known of each node."""
    # counted next to the rows: keys are moved once
    in_bucket = F.count("*").over(Window.partitionBy("key"))
    members = stage(dealt.withColumn("count", in_bucket).where("count > 1"), "shared-buckets")
    near = members.groupBy("node").agg(F.sum("count").alias("near"))
    members = stage(members.join(near, "node").select("key", "node", "n", "near"), "bucket-members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    sets = stage(sets_of(docs, wanted, shingle, id_col, text_col), "shingle-sets")
    links = sets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    left = members.withColumn("component", F.col("node"))
    for _ in range(ROUNDS):
        best = F.max(F.struct("near", F.col("node").alias("centre"), F.col("n").alias("n_centre"), F.col("component").alias("c_centre")))
        centres = stage(left.groupBy("key").agg(best.alias("best")).select("key", "best.centre", "best.n_centre", "best.c_centre"), "centres")
        with_centre = left.join(centres, "key").where("node <> centre")
        fits = 100 * F.least("n", "n_centre") >= threshold * F.greatest("n", "n_centre")
        pairs = stage(with_centre.where(fits & (F.col("component") != F.col("c_centre"))).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
        links = stage(links.unionByName(confirmed(pairs, sets, threshold)), "links")
        named = stage(components(links), "components")
        rest = with_centre.select("key", "node", "n", "near").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rest = stage(rest, "bucket-rest")
        open_keys = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        left = stage(rest.join(open_keys, "key"), "bucket-open")
        if left.isEmpty():
            return named
    return components(stage(links.unionByName(rest_links(left, sets, threshold)), "links"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links of at
    least ``threshold`` per cent), kept."""
    marked = stage(marked_rows(docs, shingle, bands, rows, id_col, text_col), "minmax-rows")
    full = marked.where("n > 0")
    nodes = stage(full.groupBy("hi", "lo").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "minmax-nodes")
    firsts = full.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    dealt = firsts.select(F.col("row").alias("node"), "n", F.explode("bands").alias("key"))
    named = near_components(dealt, docs, nodes, shingle, threshold, id_col, text_col)
    tied = stage(nodes.join(named, "node", "left").withColumn("component", F.coalesce("component", "node")), "minmax-tied")
    least = tied.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(tied.join(least, "component").select("hi", "lo", "component_id"), "minmax-named")
    joined = full.select("doc_id", "n", "hi", "lo").join(named, ["hi", "lo"]).select("doc_id", "n", "component_id")
    alone = marked.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    every = joined.unionByName(alone)
    kept = F.when(F.col("n") == 0, True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
