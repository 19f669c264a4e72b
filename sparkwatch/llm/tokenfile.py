"""Token ids of a corpus in Arrow files of equal-length sequences, for random access without copies.

A folder holds a manifest (a Parquet table, one row a shard) and two files in Arrow's file format for each shard:

* ids: `ids`, fixed_size_list<uint16>[length] (uint32 for vocabularies that need it), and `mask`, fixed_size_list<bool>[length],
  a sequence a row and `rows` sequences a batch (the last batch may hold fewer). The documents' ids follow each other
  without gaps, so a document may begin anywhere in a sequence and run over several. mask is true where an id belongs to a
  document and false in the room after the shard's last one.
* docs: `doc_id`, `start` (its first id, counted from the shard's beginning) and `n_tokens`, in the order of the ids.

As every sequence but those of the last batch has a known place, Sequences(path)[i] is a view into the mapped file.

Shards are ranges of doc_id in ascending order. A task writes its shard in batches, so its memory doesn't grow with the
shard, under a name that its attempt has for itself; the manifest names the files of the attempts that succeeded, so a
lost executor leaves at most files that nothing reads.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stored import before
from .tokens import Encoder

_encoders: dict[str, Encoder] = {}
_MANIFEST = "shard int, ids string, docs string, n_docs long, n_ids long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _sequences(length: int, kind: type) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"file:/+", path) or "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def _open(path: str) -> pa.NativeFile:
    where, name = _place(path)
    return pa.memory_map(name) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(name)


class _Writer:
    """Ids of a shard's documents, one after the other, to both of its files."""

    def __init__(self, folder: str, stem: str, length: int, rows: int, kind: type) -> None:
        where, name = _place(folder)
        where.create_dir(name, recursive=True)
        self.names = [f"{stem}-ids.arrow", f"{stem}-docs.arrow"]
        self._length, self._rows, self._kind, self._schema = length, rows, kind, _sequences(length, kind)
        self._files = [where.open_output_stream(f"{name}/{x}") for x in self.names]
        self._ids, self._docs = (pa.ipc.new_file(f, s) for f, s in zip(self._files, (self._schema, _DOCS), strict=True))
        self._waiting: list[np.ndarray] = []
        self._held, self.n_ids, self.n_docs = 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: list[np.ndarray]) -> None:
        n = np.array([len(x) for x in ids], np.int64)
        starts = self.n_ids + np.cumsum(n) - n
        self._docs.write_batch(pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(starts), pa.array(n)], schema=_DOCS))
        for x in ids:
            self._waiting.append(x)
            self._held += len(x)
            if self._held >= self._length * self._rows:
                self._flush()
        self.n_docs += len(ids)
        self.n_ids += int(n.sum())

    def _flush(self, all_of_it: bool = False) -> None:
        size = self._length * self._rows
        held = np.concatenate(self._waiting) if self._waiting else np.zeros(0, self._kind)
        whole = len(held) if all_of_it else len(held) - len(held) % size
        for i in range(0, whole, size):
            part = held[i : min(i + size, whole)]
            mask = np.arange(-(-len(part) // self._length) * self._length) < len(part)
            part = np.concatenate([part, np.zeros(len(mask) - len(part), self._kind)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self._length) for x in (part, mask)]
            self._ids.write_batch(pa.RecordBatch.from_arrays(lists, schema=self._schema))
        self._waiting = [held[whole:]]
        self._held = len(held) - whole

    def close(self) -> None:
        self._flush(all_of_it=True)
        for x in (self._ids, self._docs, *self._files):
            x.close()


def write(docs: DataFrame, folder: str, tokenizer: str, length: int = 2048, rows: int = 64, end_id: int = 0, shard_bytes: int = 32 << 20) -> DataFrame:
    """Writes docs (doc_id, text) to a new folder and returns its manifest: shard, ids and docs (file names), n_docs, n_ids.

    Each text's ids and the end id; a null or empty text is the end id alone. Documents stand in ascending doc_id, null ids
    first; rows that repeat a doc_id follow each other in the table's order, and may be in two shards. There is a shard for
    about `shard_bytes` of text, at least as many as the cluster works on at once. An empty table gives a manifest without
    rows. Other columns play no part. A very long text is encoded whole, by one task.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-size // shard_bytes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder, out = _encoders[tokenizer], None
        kind = np.uint16 if max(encoder.largest, end_id) < 1 << 16 else np.uint32
        end = np.array([end_id], kind)
        task = TaskContext.get()
        for b in batches:
            if not b.num_rows:
                continue
            out = out or _Writer(folder, f"{task.partitionId():08d}-{task.taskAttemptId()}", length, rows, kind)
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out.add(part.column(0), [np.concatenate([encoder.encode(t.as_py() or "").astype(kind), end]) for t in part.column(1)])
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "ids": out.names[0], "docs": out.names[1], "n_docs": out.n_docs, "n_ids": out.n_ids}], pa.schema([("shard", pa.int32()), ("ids", pa.string()), ("docs", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    tied = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("tie"))
    dealt = tied.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "text").mapInArrow(work, _MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


class Sequences:
    """The sequences of one ids file: len, and [i] as (ids, mask), a numpy view and an Arrow one of the file where it is mapped."""

    def __init__(self, path: str) -> None:
        self._reader = pa.ipc.open_file(_open(path))
        n = self._reader.num_record_batches
        self._rows = self._reader.get_batch(0).num_rows if n else 0
        self._len = (n - 1) * self._rows + self._reader.get_batch(n - 1).num_rows if n else 0
        self.length = self._reader.schema.field("ids").type.list_size

    def __len__(self) -> int:
        return self._len

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < self._len:
            raise IndexError(i)
        ids, mask = self.batch(i // self._rows)
        at = i % self._rows * self.length
        return ids[at : at + self.length], mask.slice(at, self.length)

    def batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """All ids, and all of the mask, of the k-th batch."""
        b = self._reader.get_batch(k)
        return b.column(0).values.to_numpy(zero_copy_only=True), b.column(1).values

    def spans(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from `start` on, batch by batch."""
        size = self._rows * self.length
        while n:
            k, at = divmod(start, size)
            ids, mask = self._cached(k)
            part = ids[at : min(at + n, mask)]
            if not len(part):
                raise ValueError("ids of a document are missing")
            yield part
            start, n = start + len(part), n - len(part)

    def _cached(self, k: int) -> tuple[np.ndarray, int]:
        """A batch's ids and how many of them are documents'; the last batch asked for is kept open."""
        if getattr(self, "_last", (None,))[0] != k:
            ids, mask = self.batch(k)
            self._last = (k, ids, mask.true_count)
        return self._last[1:]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) of each document, read from a folder's files."""
    shards = manifest(spark, folder)
    n = shards.count()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = Sequences(f"{folder}/{row['ids']}")
                with pa.ipc.open_file(_open(f"{folder}/{row['docs']}")) as docs:
                    for k in range(docs.num_record_batches):
                        part = docs.get_batch(k)
                        crcs = []
                        for start, many in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                            crc = 0
                            for x in ids.spans(start, many):
                                crc = zlib.crc32(x.astype("<u4"), crc)
                            crcs.append(crc)
                        first = pa.array(np.full(len(crcs), row["first"]))
                        start = pa.array(part.column(1).to_numpy() + first.to_numpy())
                        yield pa.RecordBatch.from_arrays([part.column(0), start, part.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    first = before(shards, "shard", "n_ids").withColumnRenamed("n_ids", "first")
    located = shards.join(F.broadcast(first), "shard").select("ids", "docs", "first")  # broadcast: a row for each shard
    return located.repartition(max(1, n)).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
