"""CRC-32 of many spans of a byte vector at once, by position tables.

But for a constant that the length alone sets, a CRC is linear: it is the XOR of what each byte contributes, and that
depends on the byte and on its distance from the span's end. TABLE holds these contributions for the last 64 distances, so
a span's CRC is one look-up for each byte and one bitwise_xor.reduceat over all spans. A longer span is folded blockwise:
the blocks of 64 bytes are counted from its end, each block's XOR is moved on by its distance (a linear map, kept as four
tables for each power of two), and these are XORed in turn.
"""

from __future__ import annotations

import numpy as np

U32 = np.uint32
BLOCK = 64
_POLY = 0xEDB88320  # CRC-32 of zlib, bits reversed (a fixed value)


def _bytewise() -> np.ndarray:
    out = np.arange(256, dtype=U32)
    for _ in range(8):
        out = (out >> U32(1)) ^ np.where(out & U32(1), U32(_POLY), U32(0))
    return out


_STEP = _bytewise()


def _position_table() -> np.ndarray:
    """TABLE[d, b]: what byte b contributes when d bytes follow it."""
    out = np.empty((BLOCK, 256), U32)
    out[0] = _STEP
    for d in range(1, BLOCK):
        out[d] = (out[d - 1] >> U32(8)) ^ _STEP[out[d - 1] & U32(255)]
    return out


TABLE = _position_table()
_FLAT = TABLE.ravel()


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & U32(255)] ^ tables[1][(x >> U32(8)) & U32(255)] ^ tables[2][(x >> U32(16)) & U32(255)] ^ tables[3][x >> U32(24)]


def _powers() -> np.ndarray:
    """_ON[k]: four tables that move a state on by 2 ** k zero bytes."""
    out = np.empty((40, 4, 256), U32)
    units = np.stack([np.arange(256, dtype=U32) << U32(8 * i) for i in range(4)])
    out[0] = (units >> U32(8)) ^ _STEP[units & U32(255)]
    for k in range(1, 40):
        out[k] = _apply(out[k - 1], out[k - 1])
    return out


_ON = _powers()


def moved(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """States after n more zero bytes each."""
    state, n = state.copy(), np.asarray(n, np.int64)
    for k in range(int(n.max(initial=0)).bit_length()):
        on = np.flatnonzero((n >> k) & 1)
        state[on] = _apply(_ON[k], state[on])
    return state


#: The constants of lengths up to a block.
_OF_LENGTH = moved(np.full(BLOCK + 1, 0xFFFFFFFF, U32), np.arange(BLOCK + 1)) ^ U32(0xFFFFFFFF)


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions of all spans, one span after the other."""
    total = int(n.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(n) - n), n)


def _linear(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """The XOR of the contributions of spans of 1 to 64 bytes."""
    out = np.empty(len(starts), U32)
    for i in range(0, len(starts), chunk):
        s, n = starts[i : i + chunk], ends[i : i + chunk] - starts[i : i + chunk]
        at = spread(s, n)
        left = np.repeat(ends[i : i + chunk] - 1, n) - at
        out[i : i + chunk] = np.bitwise_xor.reduceat(_FLAT[left * 256 + data[at]], np.cumsum(n) - n)
    return out


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of data[start:end] for each span, as zlib.crc32 gives it. Spans may overlap and may be empty (0)."""
    n = ends - starts
    out = np.zeros(len(n), U32)
    short = np.flatnonzero((n > 0) & (n <= BLOCK))
    out[short] = _linear(data, starts[short], ends[short]) ^ _OF_LENGTH[n[short]]
    long = np.flatnonzero(n > BLOCK)
    if len(long):
        count = -(-n[long] // BLOCK)
        back = spread(np.zeros(len(long), np.int64), count)  # a block's number from the end of its span
        e = np.repeat(ends[long], count) - back * BLOCK
        s = np.maximum(e - BLOCK, np.repeat(starts[long], count))
        folded = np.bitwise_xor.reduceat(moved(_linear(data, s, e), back * BLOCK), np.cumsum(count) - count)
        out[long] = folded ^ moved(np.full(len(long), 0xFFFFFFFF, U32), n[long]) ^ U32(0xFFFFFFFF)
    return out
