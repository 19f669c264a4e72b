"""Packing documents into sequences: bin completion with branch and bound, in groups that Spark deals out.

A group holds some thousand pieces, and only their lengths matter. Sequences are filled one by one around the largest
piece left. Its completions are sets of pieces that fit beside it; one that another dominates (the same number of pieces
or fewer, each at least as long) is left out, so those that leave no room and use the longest pieces come first. Best-fit
decreasing gives the incumbent. The search follows each sequence's best completion and later takes the next ones, and
drops a branch once the room wasted so far says it can't need fewer sequences than the incumbent. It ends at the bound
that the total length sets, or after a number of nodes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder

_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id, whole or (only if longer) cut.

    Cuts leave full pieces behind a first one that may be shorter. A null or empty text is the end id alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        end = np.array([end_id], np.uint32)
        for b in batches:
            rows: list[tuple[int, int, int, int]] = []
            of = []
            for r, text in enumerate(b.column(1)):
                ids = np.concatenate([encoder.encode(text.as_py() or ""), end]).astype("<u4")
                n = len(ids)
                first = n % capacity or capacity
                for k, e in enumerate(range(first, n + 1, capacity)):
                    s = 0 if not k else e - capacity
                    rows.append((k, s, e - s, zlib.crc32(ids[s:e].tobytes())))
                    of.append(r)
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(of, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Each piece, longest first, goes where it leaves the least room."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        i = bisect_left(rooms, (x, -1))
        if i == len(rooms):
            bins.append([x])
            room = (capacity - x, len(bins) - 1)
        else:
            left, b = rooms.pop(i)
            bins[b].append(x)
            room = (left - x, b)
        if room[0]:
            insort(rooms, room)
    return bins


def completions(left: list[int], room: int, width: int = 8, budget: int = 200) -> list[tuple[int, ...]]:
    """Undominated sets of the ascending lengths `left` that fit in `room`, however many pieces they hold: the least waste first, then the fewest and longest pieces.

    Sets are extended by the longest pieces that fit until none does. `budget` bounds the extensions tried, beyond the
    first set (which takes the longest piece that fits each time); up to `width` sets are given.
    """
    found: dict[tuple[int, ...], int] = {}

    def extend(chosen: tuple[int, ...], room: int, hi: int) -> None:
        nonlocal budget
        i = bisect_right(left, room, 0, hi)
        if not i:
            if chosen:
                found[chosen] = room
            return
        before = 0
        tried = 0
        j = i
        while j and tried < width and (budget > 0 or not tried):
            x = left[j - 1]
            j -= 1
            if x == before:
                continue
            before, tried, budget = x, tried + 1, budget - 1
            if x == room:
                found[(*chosen, x)] = 0
                return  # anything else here is dominated
            extend((*chosen, x), room - x, j)

    extend((), room, len(left))
    order = sorted(found.items(), key=lambda f: (f[1], len(f[0]), [-x for x in f[0]]))
    return [f for k, (f, w) in enumerate(order) if not any(w2 <= w and len(g) <= len(f) and all(p >= q for p, q in zip(g, f, strict=False)) for g, w2 in order[:k])][:width]


def _exact(left: list[int], room: int) -> tuple[int, ...] | None:
    """One piece, or two, that fill the room exactly, the longest first."""
    i = bisect_left(left, room)
    if i < len(left) and left[i] == room:
        return (room,)
    hi, lo = i - 1, 0
    while lo < hi:
        s = left[lo] + left[hi]
        if s == room:
            return (left[hi], left[lo])
        if s < room:
            lo += 1
        else:
            hi -= 1
    return None


def complete(lengths: list[int], capacity: int, nodes: int = 4000) -> list[list[int]]:
    """Bins of lengths, none over capacity. `nodes` bounds the search; any answer is valid and no worse than best fit decreasing."""
    best = best_fit_decreasing(lengths, capacity)
    bound = -(-sum(lengths) // capacity)
    if len(best) <= bound:
        return best
    full = [[x] for x in lengths if x == capacity]
    left = sorted(x for x in lengths if x < capacity)
    spare = len(best) - 1  # a solution must need no more than this
    bins: list[list[int]] = []
    waste, seen = 0, 0
    total = sum(left)
    # the largest piece of each open bin, its completions not tried (None: not enumerated yet), and the one tried without
    stack: list[list] = []
    while True:
        slack = (spare - len(full)) * capacity - total  # room that a better solution may waste
        if left and waste <= slack and seen < nodes:
            seen += 1
            x = left.pop()
            chosen = _exact(left, capacity - x)
            if chosen:  # one piece that fills the room dominates all else; to a pair there may be alternatives
                stack.append([x, [] if len(chosen) == 1 else None, chosen])
            else:
                options = completions(left, capacity - x) or [()]
                stack.append([x, options[1:], None])
                chosen = options[0]
        else:
            if not left and waste <= slack and len(full) + len(bins) < len(best):
                best = full + [list(b) for b in bins]
                spare = len(best) - 1
                if len(best) <= bound:
                    return best
            while True:  # back to the last bin that has another completion
                if not stack or seen >= nodes:
                    return best
                x, options, tried = stack[-1]
                b = bins.pop()
                waste -= capacity - sum(b)
                for y in b[1:]:
                    insort(left, y)
                if options is None:
                    options = stack[-1][1] = [c for c in completions(left, capacity - x) if c != tried]
                if options:
                    break
                insort(left, x)
                stack.pop()
            seen += 1
            chosen = options.pop(0)
        for y in chosen:
            left.pop(bisect_left(left, y))
        bins.append([x, *chosen])
        waste += capacity - x - sum(chosen)


def pack(rows: DataFrame, capacity: int = 2048, group: int = 4096, count: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...; no length over capacity).

    Groups of about `group` pieces, dealt by a hash of doc_id and start, are packed apart, each by one task. `count` is
    about how many pieces there are; they are counted where it isn't given.
    """
    groups = max(1, -(-(rows.count() if count is None else count) // group))

    def work(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        waiting: dict[int, list[int]] = {}
        for r in np.lexsort([table.column(c).to_numpy() for c in ("start", "doc_id")])[::-1].tolist():
            waiting.setdefault(lengths[r], []).append(r)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = (table.column("grp")[0].as_py() if lengths else 0) << 32
        for k, b in enumerate(complete(lengths, capacity)):
            at = 0
            for x in b:
                r = waiting[x].pop()
                sequence[r], offset[r] = base + k, at
                at += x
        return table.drop_columns(["grp"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sequence_id long, offset long"
    grp = F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)).alias("grp")
    return rows.select("*", grp).groupBy("grp").applyInArrow(work, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: of each piece of each row of docs.

    A null or empty text is a piece of length 1 (its end id); rows that repeat each have pieces. Other columns play no
    part, and an empty table gives an empty result. Very long texts are encoded and cut whole, by one task each. About how
    many pieces there are, which sets the groups, is told from the rows and their bytes, four to a token.
    """
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()
    return pack(pieces(docs, tokenizer, capacity), capacity, count=rows + (size or 0) // (4 * capacity))
