"""Token ids as Arrow files of fixed-size lists.

``write_token_files`` lays the ids of all documents, in ascending doc_id order
and each with an end id, into one continuous stream and cuts it into rows of
``row_length`` ids. A file holds record batches of two columns,

* ``ids``  fixed_size_list<uint16 or uint32>[row_length]
* ``mask`` fixed_size_list<bool>[row_length], false on the padding of a file's last row,

and its footer lists the batches, so that any row is reached without reading
what stands before it; a memory map gives it without a copy (``TokenFile``).
Beside each stands an index file: doc_id, begin (place in the file), n_tokens.

Files are written by the executors into the shared folder, under names no other
attempt of a task uses; a written manifest names those that count, so a lost
executor or a repeated task leaves only files that nobody reads.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .common import exact, materialize, new_path, pieces

END_ID = 2
ROW_LENGTH = 2048
BATCH_ROWS = 256

MANIFEST = "part int, path string, index_path string, n_ids long, n_docs long"
INDEX = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64())])


def _layout(row_length: int, wide: bool) -> pa.Schema:
    item = pa.uint32() if wide else pa.uint16()
    return pa.schema([("ids", pa.list_(item, row_length)), ("mask", pa.list_(pa.bool_(), row_length))], metadata={"row_length": str(row_length)})


class _Writer:
    """One token file and its index; holds a batch of rows at most."""

    def __init__(self, folder: str, name: str, row_length: int, wide: bool):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.index_path = f"{folder}/{name}.arrow", f"{folder}/{name}.index.arrow"
        self.schema, self.row_length, self.dtype = _layout(row_length, wide), row_length, np.dtype("<u4" if wide else "<u2")
        self.sink = self.fs.open_output_stream(f"{base}/{name}.arrow")
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.index_sink = self.fs.open_output_stream(f"{base}/{name}.index.arrow")
        self.index = pa.ipc.new_file(self.index_sink, INDEX)
        self.buffer = np.empty(row_length * BATCH_ROWS, self.dtype)
        self.filled = self.n_ids = self.n_docs = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.n_ids, len(ids)))
        self.n_ids += len(ids)
        self.n_docs += 1
        at = 0
        while at < len(ids):
            k = min(len(ids) - at, len(self.buffer) - self.filled)
            self.buffer[self.filled : self.filled + k] = ids[at : at + k]
            self.filled += k
            at += k
            if self.filled == len(self.buffer):
                self._flush()
        if len(self.rows) >= 65536:
            self._flush_index()

    def _flush(self) -> None:
        if not self.filled:
            return
        rows = -(-self.filled // self.row_length)
        ids = np.zeros(rows * self.row_length, self.dtype)
        ids[: self.filled] = self.buffer[: self.filled]
        mask = pa.array(np.arange(len(ids)) < self.filled)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.row_length), pa.FixedSizeListArray.from_arrays(mask, self.row_length)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.filled = 0

    def _flush_index(self) -> None:
        if self.rows:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=INDEX))
            self.rows = []

    def close(self) -> None:
        self._flush()
        self._flush_index()
        for x in (self.file, self.sink, self.index, self.index_sink):
            x.close()


class TokenFile:
    """Random access to one token file; on a local disk its buffers are the mapped pages themselves."""

    def __init__(self, uri: str):
        filesystem, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(filesystem, pafs.LocalFileSystem) else filesystem.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.row_length = int(self.file.schema.metadata[b"row_length"])
        self._batch: tuple[int, np.ndarray] | None = None

    def flat(self, batch: int) -> np.ndarray:
        """All ids of a record batch, as a view."""
        if self._batch is None or self._batch[0] != batch:
            column = self.file.get_batch(batch).column(0)
            self._batch = (batch, column.values.to_numpy(zero_copy_only=True))
        return self._batch[1]

    def sequence(self, row: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of a row: views of the file."""
        batch, at = divmod(row, BATCH_ROWS)
        b = self.file.get_batch(batch)
        part = slice(at * self.row_length, (at + 1) * self.row_length)
        return b.column(0).values.to_numpy(zero_copy_only=True)[part], b.column(1).values.slice(part.start, self.row_length)

    def span(self, begin: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``begin`` on, as views of one batch after the other."""
        size = BATCH_ROWS * self.row_length
        while n > 0:
            batch, at = divmod(begin, size)
            view = self.flat(batch)[at : at + n]
            yield view
            begin, n = begin + len(view), n - len(view)

    def close(self) -> None:
        self._batch = None
        self.source.close()


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID, row_length: int = ROW_LENGTH, folder: str | None = None) -> DataFrame:
    """Writes the files of all documents (doc_id, text) and returns the manifest, one row per file.

    Documents are dealt to files by ranges of doc_id, so the files in order of
    ``part`` hold them in ascending order (nulls first; rows that share a
    doc_id by a hash of their text). Null or empty text: the end id alone.
    Empty table: no files.
    """
    folder = folder or new_path(docs.sparkSession, "tokens")
    wide = max(vocab.vocabulary(path).bytes_of) > 0xFFFF or end_id > 0xFFFF

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), None
        end = np.array([end_id], "<u4")
        for b in pieces(batches):
            if out is None and b.num_rows:
                out = _Writer(folder, f"part-{part:06d}-{uuid.uuid4().hex}", row_length, wide)
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.add(doc, np.concatenate([vocab.encode_fast(path, text or ""), end]))
        if out is not None:
            out.close()
            row = (part, out.path, out.index_path, out.n_ids, out.n_docs)
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["part", "path", "index_path", "n_ids", "n_docs"])

    rows = exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    # Texts are sorted, not ids: compressed, a shuffle of either is as large, and no table of ids has to be written beside it.
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return materialize(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Reads the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of unsigned 32-bit ids)."""
    files = manifest.select("part", "path", "index_path", "n_ids").orderBy("part").collect()  # one row per file
    base, rows = 0, []
    for f in files:
        rows.append((f["path"], f["index_path"], base))
        base += f["n_ids"]
    listed = spark.createDataFrame(rows, "path string, index_path string, base long").repartition(max(1, len(rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index_path, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens = TokenFile(path)
                filesystem, at = pafs.FileSystem.from_uri(index_path)
                with filesystem.open_input_file(at) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        x = index.get_batch(k)
                        crcs = []
                        for begin, n in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True):
                            crc = 0
                            for view in tokens.span(begin, n):
                                crc = zlib.crc32(view.astype("<u4"), crc)
                            crcs.append(crc)
                        start = pa.array(np.asarray(x.column(1)) + base, pa.int64())
                        yield pa.RecordBatch.from_arrays([x.column(0), start, x.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                tokens.close()

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, path: str | None = None, end_id: int = END_ID, row_length: int = ROW_LENGTH) -> DataFrame:
    """Writes the token files of all documents and reads them back, one row per document."""
    return read_token_files(docs.sparkSession, write_token_files(docs, path, end_id, row_length))
