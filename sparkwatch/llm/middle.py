"""Fill-in-the-middle: a text's units are cut in three at two places, and the parts put in another order between marks.

Each batch goes through pyarrow.compute as a whole. A separator byte that no UTF-8 text holds is put behind every unit and
split on, which gives a list of units for each text; the lists are flattened beside their parents' numbers, a unit's ordinal
and its parent's cuts say which part it belongs to, each part's units are filtered and rebuilt as lists, and binary_join
makes one piece of each list and one output of the pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: The marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: A unit: a word with the blanks before it, or the blanks at the end of the text.
UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_END = b"\xff"
_NONE = pa.scalar(b"", pa.large_binary())


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some megabytes of that column each, whole rows."""
    for i, j, *_ in tx.blocks(batch.column(column), 4 << 20):
        yield batch.slice(i, j - i)


def _bytes(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.large_binary()).fill_null(b"")


def _mod(x: pa.Array, m: pa.Array | int) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, m), m))


def units(texts: pa.Array) -> pa.Array:
    """The list of each text's units, and an empty one behind them: binary lists of one entry more than units."""
    return pc.split_pattern(pc.replace_substring_regex(texts, pattern=UNIT, replacement=b"\\0" + _END), pattern=_END)


def parts(lists: pa.Array, a: pa.Array, b: pa.Array) -> list[pa.Array]:
    """Each list's entries up to its a, from there to its b, and from there on, joined to one piece each."""
    parent, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    first = lists.offsets.cast(pa.int64()).slice(0, len(lists))
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), first.take(parent))
    before_a, before_b = pc.less(ordinal, a.take(parent)), pc.less(ordinal, b.take(parent))
    length = pc.list_value_length(lists).cast(pa.int64())
    out = []
    for role, counts in ((before_a, a), (pc.and_not(before_b, before_a), pc.subtract(b, a)), (pc.invert(before_b), pc.subtract(length, b))):
        ends = pc.cumulative_sum(counts)
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends])
        out.append(pc.binary_join(pa.LargeListArray.from_arrays(offsets, flat.filter(role)), _NONE))
    return out


def _check(marks: tuple[str, str, str]) -> None:
    """Marks that can't arise, or hide, where a mark and a text or another mark meet: no end of one is a beginning of one."""
    if not all(marks) or len(set(marks)) < 3 or any(x in y for x in marks for y in marks if x != y):
        raise ValueError("the three marks must differ and not hold each other")
    if any(x[i:] == y[: len(x) - i] for x in marks for y in marks for i in range(1, len(x))):
        raise ValueError("no mark may end as one begins")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits from a document's id: the first 8-digit groups of the sha256 of `seed:doc_id` (a null id: `seed:`)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output of each row of docs.

    The prefix ends after the smaller of two numbers of units, drawn from 0 to n by the id, the middle after the larger;
    either may be empty. `rate` percent of the texts are cut, `spm` percent of those with the suffix first. A text that is
    empty or null (which counts as empty, so its output is empty), or holds a mark, stays plain. Rows that repeat a doc_id
    are cut by the same draws. Other columns play no part, an empty table gives an empty result, and a very long text is one
    row of a batch of its own.
    """
    _check(marks)
    p, s, m = (pa.scalar(x.encode(), pa.large_binary()) for x in marks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch, 1):
                text = _bytes(b.column(1))
                h1, h2, h3, h4 = b.columns[2:]
                lists = units(text)
                ends = pc.list_value_length(lists).cast(pa.int64())  # one more than units: as many places for a cut
                x, y = _mod(h1, ends), _mod(h2, ends)
                prefix, middle, suffix = parts(lists, pc.min_element_wise(x, y), pc.max_element_wise(x, y))
                plain = pc.or_(pc.equal(text, _NONE), pc.greater_equal(_mod(h3, 100), rate))
                for mark in marks:
                    plain = pc.or_(plain, pc.match_substring(text, mark.encode()))
                first = pc.less(_mod(h4, 100), spm)
                whole = pc.if_else(
                    first,
                    pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, _NONE),
                    pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, _NONE),
                )
                chars = lambda piece: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(piece.cast(pa.large_string())))
                form = pc.if_else(plain, "plain", pc.if_else(first, "spm", "psm"))
                output = pc.if_else(plain, text, whole).cast(pa.large_string())
                yield pa.RecordBatch.from_arrays([b.column(0), pc.subtract(ends, 1), form, chars(prefix), chars(middle), output.cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *draws(F.col("doc_id"), seed)).mapInArrow(work, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """made (output, form and any other columns) with `restored`, the text before the transformation: from output and form alone.

    A null output gives null, and so does one that doesn't hold its form's three marks. A column named restored is replaced.
    """
    _check(marks)
    any_mark = "|".join(re.escape(x) for x in marks).encode()
    kept = [c for c in made.columns if c != "restored"]
    at, of_form = kept.index("output"), kept.index("form")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch, at):
                out, form = b.column(at).cast(pa.large_binary()), b.column(of_form)
                cut = pc.and_(pc.is_valid(out), pc.fill_null(pc.not_equal(form, "plain"), False))
                pieces = pc.split_pattern_regex(out.filter(cut), any_mark)  # nothing, two parts in the form's order, the middle
                lengths = pc.equal(pc.list_value_length(pieces), 4)
                x, y, middle = (_element(pieces, lengths, i) for i in (1, 2, 3))
                first = pc.equal(form.filter(cut), "spm")
                text = pc.binary_join_element_wise(pc.if_else(first, y, x), middle, pc.if_else(first, x, y), _NONE)
                restored = pc.replace_with_mask(out, cut, text).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, restored], [*kept, "restored"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.select(*kept).schema.fields)
    return made.select(*kept).mapInArrow(work, f"{schema}, restored string")


def _element(lists: pa.Array, there: pa.Array, i: int) -> pa.Array:
    """The i-th entry of the lists that have all four, null elsewhere."""
    blank = pa.array([[None] * 4], lists.type).take(pa.array([0] * len(lists), pa.int64()))
    return pc.list_element(pc.if_else(there, lists, blank), i)
