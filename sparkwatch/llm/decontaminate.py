"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ten words (or the whole item, if shorter), and each is a set of shingles of three words
with their places. A document that holds a window holds all its shingles, so the rarest one in the documents is a prefix
that suffices to find it: documents are joined with windows on that shingle alone. The place of the shingle in both says
where the window would start; bounds of position and length drop starts before the document or ends beyond it; the words
from there on are then compared one by one.

While the windows are few (a checked number of words) they go to every task, and documents are read twice without being
shuffled: once to count shingles, once to match. Beyond it the join shuffles shingles of both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import materialize

_BITS = 22


def _word_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from and to, hashes of their words, and each row's first word."""
    for i, j, data, offsets in tx.blocks(column):
        data = tx.LOWER[data]
        starts, ends, first = tx.words(data, offsets, tx.ALNUM)
        yield i, j, tx.word_hashes(data, starts, ends), first


def windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, words: the word hashes of each window of each item, as bytes. Items without words have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, found = [], []
            for i, j, h, first in _word_blocks(b.column(1)):
                for d in range(j - i):
                    w = h[first[d] : first[d + 1]]
                    for s in range(max(1, len(w) - width + 1) if len(w) else 0):
                        of.append(i + d)
                        found.append(w[s : s + width].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(found, pa.binary())], ["item_id", "words"])

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(work, "item_id string, words binary")


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of a window's shingles of k words; one of all of them if it is shorter."""
    return tx.runs(words, min(k, len(words)))


@dataclass
class Windows:
    """Distinct windows, their items, and the shingle that each is found by."""

    words: list[np.ndarray]
    items: list[list[str]]
    size: int  # words in a shingle

    def all_shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of all windows, the windows they are of, and their places."""
        s = [_shingles(w, self.size) for w in self.words]
        n = [len(x) for x in s]
        return np.concatenate(s) if s else np.zeros(0, np.uint64), np.repeat(np.arange(len(s)), n), np.concatenate([np.arange(x) for x in n]) if n else np.zeros(0, np.int64)

    def lengths(self) -> list[int]:
        return sorted({min(self.size, len(w)) for w in self.words})

    def order(self, counts: dict[int, int]) -> None:
        """Keeps for each window its rarest shingle; windows with one that no document holds can't occur."""
        flat, of, place = self.all_shingles()
        n = np.array([counts.get(int(x), 0) for x in flat], np.int64)
        order = np.lexsort([place, flat, n, of])
        firsts = order[np.flatnonzero(np.diff(of[order], prepend=-1))] if len(order) else order
        firsts = firsts[n[firsts] > 0]
        at = firsts[np.argsort(flat[firsts], kind="stable")]
        self.token, self.window, self.place = flat[at], of[at], place[at]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.matrix = np.zeros((len(self.words), max([1, *self.length])), np.uint64)
        for k, w in enumerate(self.words):
            self.matrix[k, : len(w)] = w
        self.maybe = _bitmap(self.token)

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur in a block of documents, and the words they start at."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in self.lengths():
            s, at, _ = tx.doc_runs(hashes, first, k)
            if not len(s):
                continue
            use = _likely(self.maybe, s)
            s, at = s[use], at[use]
            lo, hi = np.searchsorted(self.token, s, "left"), np.searchsorted(self.token, s, "right")
            n = hi - lo
            pair = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            start, w = np.repeat(at, n) - self.place[pair], self.window[pair]
            size = self.length[w]
            doc = np.searchsorted(first, np.repeat(at, n), "right") - 1
            ok = (np.minimum(size, self.size) == k) & (start >= first[doc]) & (start + size <= first[doc + 1])
            start, w, size = start[ok], w[ok], size[ok]
            for a in range(0, len(w), 1 << 16):
                st, ww, sz = start[a : a + (1 << 16)], w[a : a + (1 << 16)], size[a : a + (1 << 16)]
                same = np.ones(len(ww), bool)
                for p in range(self.matrix.shape[1]):
                    inside = p < sz
                    same &= ~inside | (hashes[np.minimum(st + p, len(hashes) - 1)] == self.matrix[ww, p])
                found.append((ww[same], st[same]))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _bitmap(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _BITS, bool)
    out[(keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    return out


def _likely(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bitmap[(keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)])


def _summary(words: int, start: np.ndarray, length: np.ndarray, items: list[str]) -> tuple[int, int, int, str, bool]:
    """n_words, n_hit, n_items, items_sha256, contaminated of a document."""
    step = np.zeros(words + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    hit = int((np.cumsum(step)[:words] > 0).sum())
    return words, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0


_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _counted(docs: DataFrame, known: Windows) -> dict[int, int]:
    """How often the windows' shingles stand in the documents."""
    keys = np.unique(known.all_shingles()[0])
    shared = docs.sparkSession.sparkContext.broadcast((keys, known.lengths()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths = shared.value
        maybe, total = _bitmap(keys), np.zeros(len(keys), np.int64)
        for b in batches:
            for _, _, h, first in _word_blocks(b.column(0)):
                for k in lengths:
                    s, _, _ = tx.doc_runs(h, first, k)
                    s = s[_likely(maybe, s)]
                    at = np.minimum(np.searchsorted(keys, s), max(0, len(keys) - 1))
                    if len(at):
                        total += np.bincount(at[keys[at] == s], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some])], ["shingle", "n"])

    rows = docs.select("text").mapInArrow(work, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {r["shingle"] & (2**64 - 1): r["n"] for r in rows.toLocalIterator()}


def _clean_shared(docs: DataFrame, known: Windows) -> DataFrame:
    """Rows of docs that hold no window, as they are read."""
    known.order(_counted(docs, known))
    shared = docs.sparkSession.sparkContext.broadcast(known)  # of a checked size
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for i, _, h, first in _word_blocks(b.column(at)):
                _, start = shared.value.matches(h, first)
                clean[i + np.searchsorted(first, start, "right") - 1] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(work, docs.schema)


def _match_shared(docs: DataFrame, known: Windows) -> DataFrame:
    known.order(_counted(docs, known))
    shared = docs.sparkSession.sparkContext.broadcast(known)  # of a checked size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            rows = []
            for i, j, h, first in _word_blocks(b.column(1)):
                w, start = known.matches(h, first)
                order = np.argsort(start, kind="stable")
                w, start = w[order], start[order]
                cut = np.searchsorted(start, first)
                for d in range(j - i):
                    ww = w[cut[d] : cut[d + 1]]
                    items = sorted({x for k in np.unique(ww) for x in known.items[k]})
                    rows.append(_summary(int(first[d + 1] - first[d]), start[cut[d] : cut[d + 1]] - first[d], known.length[ww], items))
            yield _batch(b.column(0), rows)

    return docs.select("doc_id", "text").mapInArrow(work, _SCHEMA)


def _match_shuffled(docs: DataFrame, found: DataFrame, width: int, size: int, block_rows: int) -> DataFrame:
    """The same join where both sides are large: shingles of documents meet prefix tokens of windows in a shuffle."""
    found = found.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("length", (F.octet_length("words") / 8).cast("int"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [_shingles(np.frombuffer(x.as_buffer(), np.uint64), size) for x in b.column(0)]
            n = [len(x) for x in s]
            row = np.repeat(np.arange(len(s)), n)
            flat = np.concatenate(s) if s else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(flat.view(np.int64)), pa.array(np.concatenate([np.arange(x) for x in n]) if n else np.zeros(0, np.int64))], ["words", "shingle", "place"])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, h, first in _word_blocks(b.column(1)):
                for k in range(1, min(size, width) + 1):
                    s, at, _ = tx.doc_runs(h, first, k)
                    d = np.searchsorted(first, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d + i)), pa.array(s.view(np.int64)), pa.array(at - first[d]), pa.array(np.diff(first)[d])], ["doc_id", "shingle", "at", "n_words"])

    tokens = materialize(found.select("words").mapInArrow(parts, "words binary, shingle long, place long"), "tokens")
    spots = docs.select("doc_id", "text").mapInArrow(postings, "doc_id long, shingle long, at long, n_words long")
    counts = spots.join(tokens.select("shingle").distinct(), "shingle", "left_semi").groupBy("shingle").agg(F.count("*").alias("n"))
    kinds = tokens.groupBy("words").agg(F.count("*").alias("kinds"))
    rare = tokens.join(counts, "shingle").groupBy("words").agg(F.min(F.struct("n", "shingle", "place")).alias("m"), F.count("*").alias("met"))
    prefix = materialize(rare.join(kinds, "words").filter("met = kinds").join(found, "words").select("m.shingle", "m.place", "words", "length", "items"), "prefix")
    starts = spots.join(prefix, "shingle").withColumn("start", F.col("at") - F.col("place")).filter("start >= 0 and start + length <= n_words")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-docs.count() // block_rows)))).alias("block")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        at: dict[int, list[int]] = {}
        for r, d in enumerate(right.column("doc_id").to_pylist()):
            at.setdefault(d, []).append(r)
        start, want, items = (right.column(c).to_pylist() for c in ("start", "words", "items"))
        ids, text, rows = left.column("doc_id").combine_chunks(), left.column("text").combine_chunks(), []
        for i, j, h, first in _word_blocks(text):
            for d in range(j - i):
                w = h[first[d] : first[d + 1]]
                ok = [r for r in at.get(ids[i + d].as_py(), ()) if w[start[r] : start[r] + len(want[r]) // 8].tobytes() == want[r]]
                rows.append(_summary(len(w), np.array([start[r] for r in ok], np.int64), np.array([len(want[r]) // 8 for r in ok], np.int64), sorted({x for r in ok for x in items[r]})))
        return pa.Table.from_batches([_batch(ids, rows)])

    left = docs.select("doc_id", "text", block).groupBy("block")
    right = starts.select("doc_id", "start", "words", "items", block).groupBy("block")
    return left.cogroup(right).applyInArrow(verify, _SCHEMA)


def _known(items: DataFrame, width: int, size: int, most_words: int) -> tuple[DataFrame, Windows | None]:
    """The items' windows as a table, and as they go to tasks if they have at most `most_words` words."""
    found = materialize(windows(items.filter("item_id is not null"), width), "windows")
    if (found.agg(F.sum(F.octet_length("words"))).first()[0] or 0) / 8 > most_words:
        return found, None
    grouped = found.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")).orderBy("words").collect()
    return found, Windows([np.frombuffer(bytes(r["words"]), np.uint64) for r in grouped], [list(r["items"]) for r in grouped], size)


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, size: int = 3, most_words: int = 4_000_000, block_rows: int = 2000) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are ASCII-lower-cased runs of digits, letters and non-ASCII characters. A null or empty text has no words and
    is clean; so is every document if there are no items. Items that repeat count by their distinct ids; an item without
    words matches nothing. Up to `most_words` words in all windows are sent to every task, more are joined by shuffles.
    """
    found, known = _known(items, width, size, most_words)
    return _match_shared(docs, known) if known else _match_shuffled(docs, found, width, size, block_rows)


def clean(docs: DataFrame, items: DataFrame, width: int = 10, size: int = 3, most_words: int = 4_000_000, block_rows: int = 2000) -> DataFrame:
    """Rows of docs, all columns, that `contamination` calls clean. While the items are few no document is shuffled."""
    found, known = _known(items, width, size, most_words)
    if known:
        return _clean_shared(docs, known)
    dirty = _match_shuffled(docs, found, width, size, block_rows).filter("contaminated").select("doc_id").distinct()
    return docs.join(dirty, "doc_id", "left_anti").select(*docs.columns)
