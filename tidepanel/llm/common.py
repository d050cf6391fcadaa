"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def utf8_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow text column, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut batches to a number of rows that keeps a task's working memory small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


# Bytes of text that a task works on at a time, unless a single text is longer.
PIECE_BYTES = 2 << 20


def bounded(batches: Iterator[pa.RecordBatch], text: int, most: int = PIECE_BYTES, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cut batches to a number of bytes in the text column (its place is ``text``) and of
    rows; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, before + most, side="right"))
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def fresh_name(taken: list[str], wish: str) -> str:
    """A column name that none of the given columns has, whatever its case."""
    used = {c.lower() for c in taken}
    while wish.lower() in used:
        wish += "_"
    return wish


def with_text(docs: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, int]:
    """The columns of ``keep`` and the text, with the text's place. A text that is kept is
    not sent a second time: texts are nearly all of what a batch takes in memory."""
    columns = [F.col(f"`{c}`") for c in keep]
    if text_col in keep:
        return docs.select(*columns), keep.index(text_col)
    return docs.select(*columns, F.col(f"`{text_col}`").alias(fresh_name(keep, "_text"))), len(keep)


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows with a number each, as a written table, and the number's column: rows can
    be told apart although their ids are null or repeat. Numbers keep no order."""
    row = fresh_name(docs.columns, "_row")
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def crc_of_id(id_col: str) -> Column:
    """crc32 of an id written as text, the split between learning and held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def hash_share(id_col: str, share: float) -> Column:
    """True for a fixed, seeded share of the ids; the same ids in every run."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30))
