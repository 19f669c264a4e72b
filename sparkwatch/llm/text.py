"""Words and word hashes of Arrow string columns, as numpy vectors.

Everything works on the UTF-8 bytes of a block of whole documents, so no Python string is made per word.
A word hash is a polynomial of the word's bytes modulo 2^64, mixed with the word's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 20  # bytes of text worked on at once; a longer document is a block of its own

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words: anything but ASCII white space.
NON_SPACE = ~_SPACE
#: Bytes of words: digits, lower-case letters and everything that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_power = np.ones(1, U64)
_unpower = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _unpower
    if len(_power) < n:
        size = max(n, BLOCK + 1)
        p, q = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
        p[0] = q[0] = 1
        _power, _unpower = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _power, _unpower


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of up to `limit` bytes: first row, last row (excluded), bytes, offsets from 0."""
    if not len(column):
        return
    data, offsets = raw(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and for each document the number of its first word (one more at the end)."""
    word = kept[data]
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    cut = offsets[1:] - 1
    after[cut[cut >= 0]] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        a, b = starts[i], ends[j - 1]
        up, down = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum((data[a:b].astype(U64) + U64(1 + salt)) * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64)
        i = j
    return mix(out)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0xD6E8FEB86659FD93) + b)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries, by doubling; len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    part, size, out, have = hashes, 1, None, 0
    while True:
        if k & size:
            out = part if out is None else _join(out[: len(part) - have], part[have:])
            have += size
        if have == k:
            return mix(out[:n] + U64(k))
        part = _join(part[:-size], part[size:])
        size *= 2


def doc_runs(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of k words inside one document, the words they start at, and each document's first run."""
    n = np.diff(first)
    inside = np.maximum(n - k + 1, 0)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(inside, out=at[1:])
    starts = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], inside)
    return runs(hashes, k)[starts] if len(starts) else np.zeros(0, U64), starts, at
