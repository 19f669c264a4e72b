"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to four bytes, counted on labelled text and then frozen. A byte that was
seen after a context costs what its count says; one that was not costs the escape (as many as there are distinct bytes
after the context) and is coded in the next shorter context, down to equal odds of all 256 bytes. A context of three bytes
or more counts once it was seen twice. A text's code length is the exact sum over all its bytes; the language that codes
it shortest is the prediction. The trees are held as hashed tables of the runs of bytes that occur, with a cost for each
language, so they grow with the sample and neither drop nor merge anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import fold

UNDETERMINED = "und"
_START = 0x0A  # what stands before a text's first byte
ORDER = 4


def _bytes(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def _grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte a number made of the `order` bytes before it (in its own text) and itself; and how many bytes each text has."""
    n = np.diff(offsets)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], n)
    out = data.astype(np.int64)
    for back in range(1, order + 1):
        before = np.full(len(data), _START, np.int64)
        before[back:] = np.where(at[back:] >= back, data[:-back], _START)
        out |= before << (8 * back)
    return out, n


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram (order + 1 bytes as a number), n over texts and their languages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in tx.blocks(_bytes(b.column(0)), 1 << 18):
                code, n = _grams(data, offsets, order)
                of = np.repeat(langs[i:j], n)
                for lang in dict.fromkeys(langs[i:j]):
                    codes, count = np.unique(code[of == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(count.astype(np.int64))], ["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table:
    """Rows of costs by key. Keys are dealt to buckets by a hash; a bucket's keys stand together, so a search reads one or two."""

    _MULTIPLY = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        self._shift = np.uint64(64 - max(4, int(len(keys) * 2 - 1).bit_length()))
        h = self._hash(keys)
        order = np.argsort(h, kind="stable")
        self.keys, self.rows = keys[order], rows[order]
        self._starts = np.searchsorted(h[order], np.arange((1 << int(64 - self._shift)) + 1)).astype(np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self._MULTIPLY) >> self._shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        h = self._hash(keys).astype(np.int64)
        at, end = self._starts[h], self._starts[h + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = at[left[hit]]
            at[left] += 1
            left = left[~hit & (at[left] < end[left])]
        return out


@dataclass
class Model:
    langs: list[str]
    order: int
    bits: np.ndarray  # of each byte without a context, by language
    runs: list[Table]  # of each order: what a byte costs after a context of so many bytes
    escapes: list[Table]  # of each order: what it costs to leave a context

    def costs(self, code: np.ndarray) -> np.ndarray:
        """What each byte costs in each language, from the numbers that _grams makes."""
        out = np.zeros((len(code), len(self.langs)), np.float32)
        left = np.arange(len(code))
        for k in range(self.order, 0, -1):
            key = code[left] & ((1 << 8 * (k + 1)) - 1)
            at = self.runs[k - 1].find(key)
            hit = at >= 0
            out[left[hit]] += self.runs[k - 1].rows[at[hit]]
            left, key = left[~hit], key[~hit] >> 8
            if not len(left):
                return out
            at = self.escapes[k - 1].find(key)
            known = at >= 0
            out[left[known]] += self.escapes[k - 1].rows[at[known]]
        out[left] += self.bits[code[left] & 255]
        return out

    def lengths(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Code lengths in bits, a row for each text, block by block."""
        for i, j, data, offsets in tx.blocks(_bytes(column), 1 << 18):
            out = np.zeros((j - i, len(self.langs)))
            for a in range(0, len(data), 1 << 18):  # a long text in parts, each with the bytes before it
                lo = max(0, a - self.order)
                cut = np.minimum(np.clip(offsets - lo, 0, None), min(len(data), a + (1 << 18)) - lo)
                code, n = _grams(data[lo : a + (1 << 18)], cut, self.order)
                of = np.repeat(np.arange(j - i), n)[a - lo :]
                cost = self.costs(code[a - lo :])
                for k in range(len(self.langs)):
                    out[:, k] += np.bincount(of, cost[:, k], j - i)
            yield out


def _after(grams: dict[str, tuple[np.ndarray, np.ndarray]], k: int, least: int) -> dict[str, tuple[np.ndarray, ...]]:
    """Of each language the runs of k + 1 bytes, their counts, and of their contexts the count and the number of distinct bytes; contexts seen less than `least` times are left out."""
    out = {}
    for lang, (code, n) in grams.items():
        keys, of = np.unique(code & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        count = np.bincount(of, n, len(keys))
        contexts, c = np.unique(keys >> 8, return_inverse=True)
        total, kinds = np.bincount(c, count, len(contexts)), np.bincount(c, minlength=len(contexts))
        use = total >= least
        out[lang] = (keys[use[c]], count[use[c]], total[c][use[c]], kinds[c][use[c]], contexts[use], total[use], kinds[use])
    return out


def fit(grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, least: int = 2) -> Model:
    """Freezes the trees of each language from its counted runs of order + 1 bytes."""
    langs = sorted(grams)
    bits = np.full((256, len(langs)), 8.0)
    for x, lang in enumerate(langs):
        code, n = grams[lang]
        count = np.bincount(code & 255, n, 256)
        total, kinds = count.sum(), (count > 0).sum()
        if total:
            bits[:, x] = np.where(count > 0, -np.log2(np.maximum(count, 1e-9) / (total + kinds)), 8 - np.log2(kinds / (total + kinds)))
    runs, escapes = [], []
    for k in range(1, order + 1):
        of = _after(grams, k, least if k >= 3 else 1)
        keys = np.unique(np.concatenate([of[x][0] for x in langs])) if langs else np.zeros(0, np.int64)
        contexts = np.unique(keys >> 8)
        leave = np.zeros((len(contexts), len(langs)), np.float32)
        for x, lang in enumerate(langs):
            *_, own, total, kinds = of[lang]
            leave[np.searchsorted(contexts, own), x] = -np.log2(kinds / (total + kinds))
        shorter = keys & ((1 << 8 * k) - 1)
        below = bits[shorter] if k == 1 else runs[-1].rows[runs[-1].find(shorter)]
        cost = (leave[np.searchsorted(contexts, keys >> 8)] + below).astype(np.float32)
        for x, lang in enumerate(langs):
            own, count, total, kinds, *_ = of[lang]
            cost[np.searchsorted(keys, own), x] = -np.log2(count / (total + kinds))
        runs.append(Table(keys, cost))
        escapes.append(Table(contexts, leave))
    return Model(langs, order, bits.astype(np.float32), runs, escapes)


def train(docs: DataFrame, per_language: int = 1500) -> Model:
    """Fits on about `per_language` texts of each language (the bound of the sample), dealt by a hash of doc_id; rows of fold 1 are left out.

    Null texts and languages are left out, empty texts and repeated rows are fine. Very long texts are counted whole.
    """
    known = docs.filter("text is not null and lang is not null").filter(fold(F.col("doc_id")) != 1).select("doc_id", "text", "lang")
    share = {r["lang"]: min(1.0, per_language / r["count"]) for r in known.groupBy("lang").count().collect()}
    if not share:
        return fit({})
    limit = F.create_map(*[x for lang, p in share.items() for x in (F.lit(lang), F.lit(int(p * 2**30)))])
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**30)) <= limit[F.col("lang")])
    counts = count_grams(sample).toPandas()
    return fit({lang: (g.gram.to_numpy(np.int64), g.n.to_numpy(np.float64)) for lang, g in counts.groupby("lang")})


def _predictions(model: Model, text: pa.Array, letter: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    n = len(text)
    if not model.langs or not n:
        return pa.array([UNDETERMINED] * n, pa.string()), np.zeros(n)
    length = np.concatenate(list(model.lengths(text)))
    score = 1 / np.exp2(np.clip(length.min(axis=1, keepdims=True) - length, -1000, 0)).sum(axis=1)
    names = [model.langs[k] if ok else UNDETERMINED for k, ok in zip(length.argmin(axis=1), letter, strict=True)]
    return pa.array(names, pa.string()), np.where(letter, score, 0.0)


def _letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: of each row. A null text, or one without a letter, is `und` with score 0; so is any text if nothing was learned.

    The score is the predicted language's share of the odds that the code lengths give. Other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a cost for each language of each run of bytes in the bounded sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = _predictions(shared.value, b.column(1), b.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), names, pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text", _letter()).mapInArrow(work, "doc_id long, lang_pred string, score double")


def relabel(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs whose language can be told, all columns, with the prediction as lang (a string column of docs)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, names = docs.schema, docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letter = b.column(len(names)).to_numpy(zero_copy_only=False)
            found, _ = _predictions(shared.value, b.column(names.index("text")), letter)
            rows = pa.RecordBatch.from_arrays([found if n == "lang" else b.column(i) for i, n in enumerate(names)], names)
            yield rows.filter(pc.not_equal(found, UNDETERMINED))

    return docs.select("*", _letter().alias("__letter")).mapInArrow(work, schema)
