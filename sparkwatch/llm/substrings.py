"""Exact removal of repeated passages, with count-min sketches as a prefilter.

Documents are dealt to blocks of some megabytes. Each block sketches its windows of twenty words: `depth` rows of cells,
each counting what falls into it up to two. Sketches of all blocks are merged cell by cell, in chunks that Spark deals to
tasks; sums never fall below the true counts. Each block gets back one bit for each of its cells: repeated or not. In the
second pass a block passes on only the windows that every row calls repeated, the first of each kind with its place, and
those are grouped exactly by 128-bit hashes. A window is repeated where an equal one starts earlier; the words that such
windows cover go. Sketches are sparse (sorted cells as byte differences), so each window costs a byte or two a row,
and their width follows the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)
_ZSTD = pa.Codec("zstd", compression_level=1)


def _pack(a: np.ndarray) -> bytes:
    """An array's bytes, all first bytes, then all second ones and so on, compressed."""
    return len(a).to_bytes(8, "little") + _ZSTD.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), asbytes=True)


def _unpack(b: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    flat = np.frombuffer(_ZSTD.decompress(b[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


class _Block:
    """The windows of a block of documents, in the order of doc_id and place."""

    def __init__(self, table: pa.Table, width: int) -> None:
        ids = table.column("doc_id").combine_chunks()
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        self.ids = ids.to_numpy(zero_copy_only=False)[order]
        self.text = table.column("text").combine_chunks().cast(pa.large_string()).take(pa.array(order))
        hashes, doc, place, more, n = [], [], [], [], []
        for i, j, data, offsets in tx.blocks(self.text):
            starts, ends, first = tx.words(data, offsets, tx.NON_SPACE)
            h = tx.word_hashes(data, starts, ends)
            s, at, _ = tx.doc_runs(h, first, width)
            d = np.searchsorted(first, at, "right") - 1
            hashes.append(s)
            doc.append((d + i).astype(np.int32))
            place.append((at - first[d]).astype(np.int64))
            more.append(tx.doc_runs(tx.mix(h ^ _SALTS[3]), first, width)[0])
            n.append(np.diff(first))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.doc, self.place, self.n_words, self.second = join(doc, np.int32), join(place, np.int64), join(n, np.int64), join(more, np.uint64)
        self.hash, self.first, self.of, self.count = np.unique(join(hashes, np.uint64), return_index=True, return_inverse=True, return_counts=True)

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted cells of the distinct windows in a sketch row of 2^bits cells, and their order."""
        c = tx.mix(self.hash ^ _SALTS[row]) >> np.uint64(64 - bits)
        order = np.argsort(c, kind="stable")
        return c[order], order

    def later(self) -> np.ndarray:
        """Windows with an equal one that starts earlier in the block (repeated rows of one doc_id start together)."""
        lead = self.first[self.of]
        return (self.ids[self.doc] != self.ids[self.doc[lead]]) | (self.place != self.place[lead])


def _sliced(cells: np.ndarray, bits: int, chunks: int) -> np.ndarray:
    """Where each of `chunks` (a power of two) equal ranges of `bits`-bit numbers starts in sorted ones, and their end."""
    starts = np.arange(chunks, dtype=np.uint64) << np.uint64((bits - chunks.bit_length() + 1) % 64)
    return np.append(np.searchsorted(cells, starts), len(cells))


def remove_repeats(docs: DataFrame, width: int = 20, depth: int = 2, load: int = 8, block_bytes: int = 8 << 20, chunk_windows: int = 1 << 21) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the words kept, joined by one space).

    Words are runs of anything but ASCII white space, unchanged. A word goes if a window that covers it starts earlier
    too (smaller doc_id, or earlier in the document). A null, empty or short text loses nothing; rows that repeat a doc_id
    are one document, of which no row is earlier. Other columns play no part; an empty table gives an empty result.
    `load` is the least number of cells for each word; `block_bytes` and `chunk_windows` bound what a task holds.
    """
    return _clean(docs, width, depth, load, block_bytes, chunk_windows, False)


def kept_texts(docs: DataFrame, width: int = 20, depth: int = 2, load: int = 8, block_bytes: int = 8 << 20, chunk_windows: int = 1 << 21) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words kept, joined by one space) of each row; see remove_repeats."""
    return _clean(docs, width, depth, load, block_bytes, chunk_windows, True)


def _clean(docs: DataFrame, width: int, depth: int, load: int, block_bytes: int, chunk_windows: int, texts: bool) -> DataFrame:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    windows = max(1, total // 6)  # an estimate; it sets sizes only
    bits = min(60, max(20, (load * windows - 1).bit_length()))
    chunks = 1 << max(0, (windows // chunk_windows).bit_length())
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    parts = max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col("doc_id").cast("long"), "text", block).repartition(parts, "block")

    def sketch(table: pa.Table) -> pa.Table:
        b, out = _Block(table, width), []
        for row in range(depth):
            cells, order = b.cells(row, bits)
            many = b.count[order] > 1
            cut = _sliced(cells, bits, chunks)
            for c in range(chunks):
                s = slice(cut[c], cut[c + 1])
                if s.stop > s.start:
                    out.append((row, c, _pack(np.diff(cells[s], prepend=np.uint64(0))), _pack(np.packbits(many[s]))))
        rows, at, cells, many = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(rows, pa.int32()), pa.array(at, pa.int32()), pa.array([table.column("block")[0].as_py()] * len(out), pa.int32()), pa.array(cells, pa.binary()), pa.array(many, pa.binary())], ["row", "chunk", "block", "cells", "many"])

    def merge(table: pa.Table) -> pa.Table:
        cells = [np.cumsum(_unpack(x.as_py(), np.uint64)) for x in table.column("cells")]
        many = [np.unpackbits(_unpack(x.as_py(), np.uint8), count=len(c)) for x, c in zip(table.column("many"), cells, strict=True)]
        _, of = np.unique(np.concatenate(cells), return_inverse=True)
        repeated = (np.bincount(of, 1 + np.concatenate(many).astype(np.float64)) >= 2)[of]
        cut = np.cumsum([0, *map(len, cells)])
        data = [_pack(np.packbits(repeated[cut[k] : cut[k + 1]])) for k in range(len(cells))]
        return pa.table([table.column("block"), table.column("row"), table.column("chunk"), pa.array(data, pa.binary())], ["block", "row", "chunk", "repeated"])

    def candidates(table: pa.Table, marks: pa.Table) -> pa.Table:
        b, names = _Block(table, width), ["shard", "block", "hash", "second", "doc_id", "place"]
        maybe = np.ones(len(b.hash), bool)
        at = {(r, c): x for r, c, x in zip(*(marks.column(n).to_pylist() for n in ("row", "chunk", "repeated")), strict=True)}
        for row in range(depth):
            cells, order = b.cells(row, bits)
            cut = _sliced(cells, bits, chunks)
            for c in range(chunks):
                if cut[c + 1] > cut[c]:
                    got = np.unpackbits(_unpack(at[row, c], np.uint8), count=cut[c + 1] - cut[c]).astype(bool)
                    maybe[order[cut[c] : cut[c + 1]]] &= got
        use = np.flatnonzero(maybe)
        cut = _sliced(b.hash[use], 64, chunks)
        out = []
        for c in range(chunks):
            k = use[cut[c] : cut[c + 1]]
            if len(k):
                first = b.first[k]
                out.append((c, _pack(np.diff(b.hash[k], prepend=np.uint64(0))), b.second[first].tobytes(), _pack(b.ids[b.doc[first]]), _pack(b.place[first].astype(np.int32))))
        cols = list(zip(*out, strict=True)) or [()] * 5
        number = pa.array([table.column("block")[0].as_py() if table.num_rows else 0] * len(out), pa.int32())
        return pa.table([pa.array(cols[0], pa.int32()), number, *(pa.array(x, pa.binary()) for x in cols[1:])], names)

    def group(table: pa.Table) -> pa.Table:
        get = lambda name, read: [read(x.as_py()) for x in table.column(name)]
        hashes = get("hash", lambda x: np.cumsum(_unpack(x, np.uint64), dtype=np.uint64))
        cut = np.cumsum([0, *map(len, hashes)])
        h, second = np.concatenate(hashes), np.concatenate(get("second", lambda x: np.frombuffer(x, np.uint64)))
        doc, place = np.concatenate(get("doc_id", lambda x: _unpack(x, np.int64))), np.concatenate(get("place", lambda x: _unpack(x, np.int32)))
        order = np.lexsort([place, doc, second, h])
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (second[order][1:] != second[order][:-1])
        lead = np.empty(len(h), np.int64)
        lead[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        later = (doc != doc[lead]) | (place != place[lead])
        data = [_pack(np.diff(x[later[cut[k] : cut[k + 1]]], prepend=np.uint64(0))) for k, x in enumerate(hashes)]
        return pa.table([table.column("block"), pa.array(data, pa.binary())], ["block", "later"])

    def clean(table: pa.Table, marks: pa.Table) -> pa.Table:
        b = _Block(table, width)
        known = [np.cumsum(_unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in marks.column("later")]
        gone = b.later() | np.isin(b.hash, np.concatenate(known) if known else np.zeros(0, np.uint64))[b.of]
        cut = np.searchsorted(b.doc, np.arange(len(b.ids) + 1))
        removed, kept = np.zeros(len(b.ids), np.int64), []
        for i, j, data, offsets in tx.blocks(b.text):
            starts, ends, first = tx.words(data, offsets, tx.NON_SPACE)
            step = np.zeros(len(starts) + 1, np.int64)
            w = slice(cut[i], cut[j])
            at = b.place[w][gone[w]] + first[b.doc[w][gone[w]] - i]
            np.add.at(step, at, 1)
            np.add.at(step, at + width, -1)
            stay = np.cumsum(step)[:-1] == 0
            removed[i:j] = np.diff(first) - np.diff(np.concatenate([[0], np.cumsum(stay)])[first])
            left = np.flatnonzero(stay)
            doc = np.searchsorted(first, left, "right") - 1
            inner = left[:-1][doc[1:] == doc[:-1]] if len(left) else left
            edge = np.zeros(len(data) + 1, np.int8)
            edge[starts[left]] += 1
            np.add.at(edge, ends[left], -1)
            mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
            mask[ends[inner]] = True
            data = data.copy()
            data[ends[inner]] = 0x20
            kept += [data[offsets[k] : offsets[k + 1]][mask[offsets[k] : offsets[k + 1]]].tobytes() for k in range(j - i)]
        last = pa.array([x.decode() for x in kept], pa.string()) if texts else pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
        return pa.table([pa.array(b.ids, pa.int64()), pa.array(b.n_words, pa.int64()), pa.array(removed), last], ["doc_id", "n_words", "n_removed", name])

    name = "kept" if texts else "kept_sha256"
    marks = own.groupBy("block").applyInArrow(sketch, "row int, chunk int, block int, cells binary, many binary").groupBy("row", "chunk").applyInArrow(merge, "block int, row int, chunk int, repeated binary")
    found = own.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(candidates, "shard int, block int, hash binary, second binary, doc_id binary, place binary")
    later = found.groupBy("shard").applyInArrow(group, "block int, later binary")
    return own.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(clean, f"doc_id long, n_words long, n_removed long, {name} string")
