"""Token-id output: Arrow files whose batches hold fixed-size lists.

A file is a sequence of record batches with two columns, ``ids`` and ``mask``, both
fixed-size lists: of ``sequence`` ids, and of a bit an id (bytes, lowest bit first). The ids
of the file's documents follow one another without gaps; the last sequence is filled up with
zeros and masked out. All rows have the same width, so sequence ``i`` sits at a computable
place: a memory-mapped file gives its ids and its mask's bytes as numpy views without
copying. Beside each file lies an index (document id,
first id, number of ids).

Defined results: a null text is an empty document (its end id only); rows that repeat a
doc_id stay, in the order of their texts; a null doc_id sorts first; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import texts_of
from tidepanel.llm.tokens import encodable, encoder
from tidepanel.session import fresh_path, stage

SEQUENCE = 2048
BATCH_SEQUENCES = 256
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_schema(sequence: int, vocabulary: int) -> pa.Schema:
    """16-bit ids where the vocabulary fits, 32-bit ones otherwise."""
    if sequence % 8:
        raise ValueError("a sequence's mask fills whole bytes: its length is a multiple of 8")
    ids = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, sequence)), ("mask", pa.list_(pa.uint8(), sequence // 8))])


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class TokenWriter:
    """Writes one file and its index; visible under its name only once complete."""

    def __init__(self, path: str, vocabulary: int, sequence: int, attempt: int):
        self._fs, self._path = _filesystem(path)
        self._fs.create_dir(self._path.rsplit("/", 1)[0], recursive=True)
        self._schema = file_schema(sequence, vocabulary)
        self._sequence, self._suffix = sequence, f".attempt-{attempt}"
        self._out = self._fs.open_output_stream(self._path + self._suffix)
        self._arrow = pa.ipc.new_file(self._out, self._schema)
        self._index_out = self._fs.open_output_stream(self._index_path() + self._suffix)
        self._index = pa.ipc.new_file(self._index_out, INDEX)
        self._waiting: list[np.ndarray] = []
        self._n_waiting = 0
        self._rows: list[tuple[int | None, int, int]] = []
        self.n_tokens = self.n_docs = 0

    def _index_path(self) -> str:
        return self._path.removesuffix(".arrow") + ".index.arrow"

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._rows.append((doc_id, self.n_tokens, len(ids)))
        self.n_tokens += len(ids)
        self.n_docs += 1
        self._waiting.append(ids)
        self._n_waiting += len(ids)
        if self._n_waiting >= self._sequence * BATCH_SEQUENCES:
            self._flush(last=False)
        if len(self._rows) >= 10_000:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self._waiting) if self._waiting else np.empty(0, "<u4")
        width = self._sequence * BATCH_SEQUENCES
        ends = list(range(width, len(ids) + 1, width))
        for end in ends:
            self._batch(ids[end - width : end], width)
        rest = ids[ends[-1] if ends else 0 :]
        if last and len(rest):
            self._batch(rest, -(-len(rest) // self._sequence) * self._sequence)
            rest = rest[:0]
        self._waiting, self._n_waiting = [rest], len(rest)

    def _batch(self, ids: np.ndarray, width: int) -> None:
        values = np.zeros(width, self._schema.field("ids").type.value_type.to_pandas_dtype())
        values[: len(ids)] = ids
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(values), self._sequence),
            pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(np.arange(width) < len(ids), bitorder="little")), self._sequence // 8),
        ]
        self._arrow.write_batch(pa.record_batch(columns, schema=self._schema))

    def _flush_index(self) -> None:
        columns = [pa.array(c, pa.int64()) for c in zip(*self._rows, strict=True)]
        if columns:
            self._index.write_batch(pa.record_batch(columns, schema=INDEX))
        self._rows = []

    def close(self) -> None:
        self._flush(last=True)
        self._flush_index()
        for arrow, out in ((self._arrow, self._out), (self._index, self._index_out)):
            arrow.close()
            out.close()
        self._fs.move(self._index_path() + self._suffix, self._index_path())
        self._fs.move(self._path + self._suffix, self._path)


class TokenFile:
    """Random access to a written file."""

    def __init__(self, path: str):
        fs, inner = _filesystem(path)
        opened = (lambda p: pa.memory_map(p)) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        self._file = pa.ipc.open_file(opened(inner))
        self._index = pa.ipc.open_file(opened(inner.removesuffix(".arrow") + ".index.arrow"))
        self._sequence = self._file.schema.field("ids").type.list_size
        self._at, self._columns = -1, (np.empty(0), np.empty(0))

    def _batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and masks of batch ``k``, as they lie in the file."""
        if self._at != k:
            columns = self._file.get_batch(k).columns
            self._at, self._columns = k, tuple(c.flatten().to_numpy(zero_copy_only=True) for c in columns)
        return self._columns

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view into the file) and mask (a truth value an id) of sequence ``i``."""
        k, row = divmod(i, BATCH_SEQUENCES)
        ids = self._batch(k)[0][row * self._sequence : (row + 1) * self._sequence]
        return ids, np.unpackbits(self.mask_bits(i), bitorder="little").astype(bool)

    def mask_bits(self, i: int) -> np.ndarray:
        """The bytes of the mask of sequence ``i``, a view into the file."""
        k, row = divmod(i, BATCH_SEQUENCES)
        width = self._sequence // 8
        return self._batch(k)[1][row * width : (row + 1) * width]

    def span(self, start: int, length: int) -> Iterator[np.ndarray]:
        """Views that together hold ``length`` ids from place ``start``."""
        width = self._sequence * BATCH_SEQUENCES
        while length > 0:
            k, at = divmod(start, width)
            part = self._batch(k)[0][at : at + length]
            yield part
            start, length = start + len(part), length - len(part)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for k in range(self._index.num_record_batches):
            yield self._index.get_batch(k)


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    sequence: int = SEQUENCE,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode all documents in ascending id order, one file per range of ids.

    One range shuffle of the texts, then each task writes its file as it encodes. A task
    that is run again writes the same file again and puts it in place by a rename.
    Returns the manifest (file, path, n_docs, n_tokens, start), start being the number of
    ids in all files before.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        file, out, enc = task.partitionId(), None, encoder(tokenizer)
        path = f"{folder}/part-{file:06d}.arrow"
        end = np.array([end_id], "<u4")
        for batch in encodable(batches, 1):
            if out is None:
                out = TokenWriter(path, enc.vocabulary, sequence, task.taskAttemptId())
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(texts_of(batch.column(1))), strict=True):
                out.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "path": [path], "n_docs": [out.n_docs], "n_tokens": [out.n_tokens]})

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    manifest = stage(ordered.mapInArrow(write, "file int, path string, n_docs long, n_tokens long"), "token-manifest")
    # one row per file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            file = TokenFile(row["path"])
            for index in file.documents():
                starts, lengths = (index.column(i).to_numpy() for i in (1, 2))
                crcs = []
                for start, length in zip(starts.tolist(), lengths.tolist(), strict=True):
                    crc = 0
                    for part in file.span(start, length):
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    crcs.append(crc)
                yield pa.RecordBatch.from_arrays(
                    [index.column(0), pa.array(starts + row["start"]), index.column(2), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # a given number of partitions is not coalesced, so files are read side by side
    spread = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
