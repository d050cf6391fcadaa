"""Exact deduplication: counting quotient filters route, bytes decide.

1. Each task fingerprints its texts (64 bits of the text without white space) and builds a
   counting quotient filter, cut into blocks by the fingerprints' upper bits.
2. The blocks of all tasks are merged by sorted remainders. A text with a thousand copies
   is one entry per task, so common texts weigh no more than rare ones.
3. Only texts whose fingerprint counts above one are compared byte by byte: they are
   grouped by the normalised bytes themselves, with partial aggregation in the map tasks.
   All other texts never leave the scan.

Which fingerprints repeat is sent to the tasks as a bitmap over quotients of at most
``ROUTE_BITS`` bits (16 MB); a full bitmap routes more texts and changes no result.

Defined results: a null text is empty, and empty texts are equal to each other; of equal
texts the row with the most code points stays, then the smallest doc_id; rows repeating
the doc_id that stays are all marked as kept; a null doc_id only stays when its group has
no other; an empty table gives no rows; other columns are not read. ``drop_duplicates``
decides by row: exactly one of each group stays, whatever ids its rows have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import bounded, fresh_name, numbered, pieces, texts_of
from tidepanel.llm.quotient import CountingQuotientFilter
from tidepanel.session import stage

WHITE_SPACE = b" \t\n\x0b\x0c\r"
# Fingerprints a block should hold on average.
BLOCK_ENTRIES = 1 << 18
ROUTE_BITS = 27


def normalise(text: str) -> bytes:
    return text.encode("utf-8").translate(None, WHITE_SPACE)


def fingerprint(normalised: bytes) -> int:
    return xxhash.xxh64_intdigest(normalised)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _row(row_col: str | None) -> Column:
    return (F.col(f"`{row_col}`") if row_col else F.lit(None)).cast("long").alias("row")


def digests(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """doc_id, row, fp, text_sha256 of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            texts = [normalise(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), _signed([fingerprint(t) for t in texts]), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                ["doc_id", "row", "fp", "text_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _row(row_col))
    return rows.mapInArrow(digest, "doc_id long, row long, fp long, text_sha256 string")


def repeated_fingerprints(digested: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints with a count above one."""
    block_bits = max(4, int(np.ceil(np.log2(max(1, rows / BLOCK_ENTRIES)))))
    below = 64 - block_bits
    quotient_bits = max(6, int(np.log2(max(64, min(rows >> block_bits, BLOCK_ENTRIES)))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy().view(np.uint64) for b in batches]
        values = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
        blocks = (values >> np.uint64(below)).astype(np.int64)
        for block in np.unique(blocks).tolist():
            lo, hi = np.searchsorted(blocks, [block, block + 1])
            own = values[lo:hi] & np.uint64((1 << below) - 1)
            data = CountingQuotientFilter.build(own, below, quotient_bits).to_bytes()
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "filter": pa.array([data], pa.binary())})

    def finish(block: int, merged: CountingQuotientFilter) -> pa.RecordBatch:
        values, counts = merged.entries()
        more = counts > 1
        found = (values[more] | np.uint64(block << below)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[more])], ["fp", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, merged = -1, None
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = CountingQuotientFilter.from_bytes(data)
                if block == current:
                    merged = merged.merge(part)
                    continue
                if merged is not None:
                    yield finish(current, merged)
                current, merged = block, part
        if merged is not None:
            yield finish(current, merged)

    built = digested.select("fp").mapInArrow(build, "block long, filter binary")
    # blocks are ranges of a hash: equally large, however many copies a text has
    return built.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "fp long, n long")


def route_bitmap(repeated: DataFrame, n_repeated: int) -> tuple[int, np.ndarray]:
    """One bit for each leading part of a fingerprint that some repeated one shares."""
    bits = int(np.clip(np.ceil(np.log2(32 * max(1, n_repeated))), 16, ROUTE_BITS))
    page = 1 << 16

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for places in batch.column(1).to_pylist():
                bitmap = np.zeros(page, bool)
                bitmap[places] = True
                rows.append(np.packbits(bitmap).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["page", "bits"])

    slot = F.shiftrightunsigned("fp", 64 - bits)
    pages = (
        repeated.select((slot / page).cast("int").alias("page"), (slot % page).cast("int").alias("place"))
        .groupBy("page")
        .agg(F.collect_set("place").alias("places"))  # at most 65,536 of a page
        .mapInArrow(fold, "page int, bits binary")
    )
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for row in pages.collect():  # at most 2,048 pages of 8 kB
        whole[row["page"] * page // 8 : (row["page"] + 1) * page // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits, whole


def among(rows: DataFrame, column: str, wanted: DataFrame, hashed: bool = False) -> DataFrame:
    """The rows whose ``column`` is among the values of ``wanted`` (one column of the same
    type), and few others: a bitmap of bounded size tells, so that what a join with the
    values would drop is not moved. ``hashed`` values are distinct hashes (named fp) already."""
    keys = wanted if hashed else stage(wanted.select(F.xxhash64(wanted.columns[0]).alias("fp")).distinct(), "wanted")
    bits, bitmap = route_bitmap(keys, keys.count())
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)
    names = rows.columns

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = (batch.column(len(names)).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            hit = shared.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1
            yield batch.select(names).filter(pa.array(hit.astype(bool)))

    return rows.withColumn("_fp", F.col(column) if hashed else F.xxhash64(column)).mapInArrow(choose, rows.schema)


def without(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The rows whose ``column`` is not among the values of ``gone`` (one column, distinct and
    not null). A bitmap of bounded size tells which rows may be among them: those alone are
    moved, the others stay where they are read."""
    hashes = stage(gone.select(F.xxhash64(column).alias("fp")).distinct(), "gone")
    bits, bitmap = route_bitmap(hashes, hashes.count())
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)
    names = rows.columns

    def split(hit: bool) -> DataFrame:
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slots = (batch.column(len(names)).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                found = (shared.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)
                yield batch.select(names).filter(pa.array(found == hit))

        return rows.withColumn(fresh_name(names, "_fp"), F.xxhash64(column)).mapInArrow(choose, rows.schema)

    return split(False).unionByName(split(True).join(gone, column, "left_anti"))


def verified_groups(docs: DataFrame, bits: int, bitmap: np.ndarray, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """Groups of at least two rows with the same bytes: fp, text_sha256, keep_id, keep_row, group_size."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            normal = [normalise(t) for t in texts]
            fps = np.array([fingerprint(t) for t in normal], np.uint64)
            slots = (fps >> np.uint64(64 - bits)).astype(np.int64)
            hit = np.flatnonzero(shared.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in hit], pa.int64()),
                    batch.column(2).take(pa.array(hit, pa.int64())),
                    pa.array(fps[hit].view(np.int64)),
                    pa.array([len(texts[i]) for i in hit], pa.int64()),
                    pa.array([normal[i] for i in hit], pa.binary()),
                ],
                ["doc_id", "row", "fp", "chars", "bytes"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _row(row_col))
    return (
        rows.mapInArrow(route, "doc_id long, row long, fp long, chars long, bytes binary")
        .groupBy("fp", "bytes")
        .agg(F.max(F.struct("chars", (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row"))).alias("best"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("fp", F.sha2("bytes", 256).alias("text_sha256"), (-F.col("best.minus_id")).alias("keep_id"), (-F.col("best.minus_row")).alias("keep_row"), "group_size")
    )


def _marked(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """Every row's digests with its group, if there is one."""
    digested = stage(digests(docs, id_col, text_col, row_col), "digests")
    repeated = stage(repeated_fingerprints(digested, digested.count()), "repeated")
    bits, bitmap = route_bitmap(repeated, repeated.count())
    groups = stage(verified_groups(docs, bits, bitmap, id_col, text_col, row_col), "equal-texts")
    return digested.join(groups, ["fp", "text_sha256"], "left")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _marked(docs, id_col, text_col).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    rows, row = numbered(docs, "exact-rows")
    gone = _marked(rows, id_col, text_col, row).where(F.col("row") != F.col("keep_row")).select(F.col("row").alias(row))
    return without(rows, row, stage(gone, "gone-rows")).select(docs.columns)
