"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has 64 bits, each the majority of the hashes of its word shingles.
Fingerprints that differ in at most ``reach`` bits are linked.

Finding links: the Hamming distances of every fingerprint to a set of reference
fingerprints (pivots) are kept in a table. By the triangle inequality two fingerprints in
reach differ by at most ``reach`` in every coordinate, so pairs are discarded by their
largest coordinate difference and only survivors are compared bit by bit. So that no task
holds all fingerprints, the table is dealt out first: the 64 bits are cut into
``reach + shared`` segments; two fingerprints in reach agree in at least ``shared`` whole
segments, so every pair meets where some choice of ``shared`` segments is equal. This
loses no pair. More segments make finer parts for more data.

Copies are no burden: equal fingerprints are one node. Within a part, a node already tied
to a cluster is not compared again, and only the links of a spanning forest are returned,
so a group of n near copies yields at most n - 1 links per part. Parts above
``PART_ROWS`` are cut into chunks, and each pair of chunks is a part of its own.

Defined results: texts without words have fingerprint zero; a null doc_id shares the
component of its fingerprint (null if no row with it has an id); rows that repeat a doc_id
keep a row each; an empty table gives no rows; other columns are not read.
``drop_near_duplicates`` decides by row: exactly one of each component stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import bounded, numbered, utf8_of
from tidepanel.llm.components import components
from tidepanel.llm.exact_dedup import without
from tidepanel.session import stage

SHINGLE = 4
REACH = 4
# Segments that must agree; 2 suits up to some hundred million distinct fingerprints.
SHARED = 2
PIVOTS = 16
PART_ROWS = 2048
# Up to this size the members of a part are compared in one sweep over all parts.
SWEEP = 48

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints by a fixed rule: multiples of the golden ratio, mixed."""
    x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def distance_table(fps: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ to[None, :]).astype(np.int8)


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z alone, and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)[: len(words) - shingle + 1].tolist()
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    if len(lanes) < 64:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BIT_OF_BYTE for k in range(8)])
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row, fp (the 64 bits as a signed long)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            found = np.array([simhash(t, shingle) for t in utf8_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "row", "fp"])

    row = (F.col(f"`{row_col}`") if row_col else F.lit(None)).cast("long").alias("row")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row)
    return rows.mapInArrow(mark, "doc_id long, row long, fp long")


def segments(count: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of ``count`` nearly equal segments of 64 bits."""
    cuts = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _close(table: np.ndarray, fps: np.ndarray, i: np.ndarray, j: np.ndarray, reach: int) -> np.ndarray:
    """Which of the pairs (i, j) are in reach: first by the pivot table, then by bits."""
    near = np.flatnonzero((np.abs(table[i] - table[j]) <= reach).all(axis=1))
    return near[np.bitwise_count(fps[i[near]] ^ fps[j[near]]) <= reach]


def _sweep(part: np.ndarray, fps: np.ndarray, ids: np.ndarray, table: np.ndarray, reach: int) -> list[np.ndarray]:
    """Links in many small parts at once: rows sorted by part and first coordinate are
    compared with their first, second, ... follower while both are close enough."""
    found, at, step = [], np.arange(len(fps)), 1
    while len(at := at[at + step < len(fps)]):
        to = at + step
        at = at[(part[at] == part[to]) & (table[to, 0] - table[at, 0] <= reach)]
        hit = at[_close(table, fps, at, at + step, reach)]
        if len(hit):
            found.append(np.stack([ids[hit], ids[hit + step]], axis=1))
        step += 1
    return found


def _forest(fps: np.ndarray, ids: np.ndarray, table: np.ndarray, reach: int) -> list[np.ndarray]:
    """Links of a spanning forest of one part."""
    found, left = [], np.arange(len(fps))
    waiting: list[int] = []
    while len(left):
        if not waiting:
            waiting, left = [int(left[0])], left[1:]
        x = waiting.pop()
        near = left[np.abs(table[left, 0] - table[x, 0]) <= reach]
        if len(near):
            hit = near[_close(table, fps, near, np.full(len(near), x), reach)]
            if len(hit):
                found.append(np.stack([np.full(len(hit), ids[x]), ids[hit]], axis=1))
                waiting.extend(hit.tolist())
                left = left[~np.isin(left, hit, assume_unique=True)]
    return found


def near_links(nodes: DataFrame, reach: int = REACH, shared: int = SHARED, n_pivots: int = PIVOTS) -> DataFrame:
    """(a, b): links between distinct fingerprints in reach, as many as tie each cluster
    together. ``nodes`` has distinct ``fp`` and an ``id`` for each."""
    parts = segments(reach + shared)
    choices = list(combinations(range(len(parts)), shared))
    to = pivots(n_pivots)

    def key(choice: tuple[int, ...]):
        """The chosen segments' bits; the choice itself is mixed in as the second field."""
        return F.xxhash64(*[F.shiftrightunsigned("fp", parts[k][0]).bitwiseAND((1 << parts[k][1]) - 1) for k in choice])

    dealt = nodes.select(
        "fp", "id", F.explode(F.array(*[F.struct(F.lit(c).alias("choice"), key(k).alias("key")) for c, k in enumerate(choices)])).alias("s")
    ).select("fp", "id", "s.choice", "s.key")
    large = dealt.groupBy("choice", "key").count().where(F.col("count") > PART_ROWS)
    large = stage(large.select("choice", "key", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("chunks")), "large-parts")
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("chunks")).cast("int")
    cut = (
        dealt.join(large, ["choice", "key"], "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("fp", "id", F.xxhash64("choice", "key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("part"))
    )

    def pair(held: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links in whole parts; ``held`` has part, fp and id in its columns."""
        if not len(held):
            return
        part, fps, ids = held[:, 0], held[:, 1].view(np.uint64), held[:, 2]
        table = distance_table(fps, to)
        order = np.lexsort((table[:, 0], part))
        part, fps, ids, table = part[order], fps[order], ids[order], table[order]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sizes = np.diff(np.append(starts, len(part)))
        small = np.repeat(sizes <= SWEEP, sizes) & np.repeat(sizes > 1, sizes)
        found = _sweep(part[small], fps[small], ids[small], table[small], reach)
        for k in np.flatnonzero(sizes > SWEEP).tolist():
            own = slice(starts[k], starts[k] + sizes[k])
            found += _forest(fps[own], ids[own], table[own], reach)
        if found:
            links = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            held = np.concatenate([held, new])
            last = np.searchsorted(held[:, 0], held[-1, 0]) if len(held) else 0  # its part may go on
            yield from pair(np.ascontiguousarray(held[:last]))
            held = held[last:]
        yield from pair(np.ascontiguousarray(held))

    return cut.select("part", "fp", "id").repartition("part").sortWithinPartitions("part").mapInArrow(search, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    reach: int = REACH,
    shared: int = SHARED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id
    reachable over links."""
    marked = stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    named = _named(marked, reach, shared)
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id")
    )


def _named(marked: DataFrame, reach: int, shared: int) -> DataFrame:
    """fp, least: every fingerprint with the first row of its component, by doc_id (null
    last), then row. Fingerprints are the nodes: an id may stand for several texts."""
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    nodes = stage(marked.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    tied = components(near_links(nodes.select("fp", F.col("fp").alias("id")), reach, shared))
    tied = stage(nodes.join(tied.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "tied")
    least = stage(tied.groupBy("component").agg(F.min("first").alias("least")), "least-rows")
    return stage(tied.join(least, "component").select("fp", "least"), "named")


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    reach: int = REACH,
    shared: int = SHARED,
) -> DataFrame:
    """One row of each component stays: the one with the smallest id."""
    rows, row = numbered(docs, "near-rows")
    marked = stage(fingerprints(rows, shingle, id_col, text_col, row), "fingerprints")
    named = _named(marked, reach, shared)
    gone = marked.join(named, "fp").where(F.col("row") != F.col("least.row")).select(F.col("row").alias(row))
    return without(rows, row, stage(gone, "gone-rows")).select(docs.columns)
