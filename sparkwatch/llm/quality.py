"""Quality by co-training: a content view and a metadata view of each document teach each other.

The content view measures the text (how many words, how varied, which words and how much of which characters); the metadata
view has what is stored beside it (language, source, length on record). Words weigh less than measures at the start, as
there are many of them. Two logistic models start from the labelled rows. In each round each
model scores a sample of unlabelled rows, and those of which it is surest, in the proportion of the labels, join the
other's training rows with the label it gave. Both are then calibrated on labelled rows kept out of training, and their
calibrated odds, each weighed by how much it tells there, make the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import fold

_MARKS = [bytes([b]) for b in b"!|#$%*&=<>{}_/"]
_MEASURES = 9 + len(_MARKS)
_BUCKETS = 64
_WORD_BITS = 8  # words are told apart by so many bits of their hashes


def content(column: pa.Array) -> np.ndarray:
    """A row of measures for each text: how many words and how varied, then its shares of characters and of hashed words (lower-cased)."""
    out = []
    upper = np.zeros(256, bool)
    upper[0x41:0x5B] = True
    digit = np.zeros(256, bool)
    digit[0x30:0x3A] = True
    for i, j, data, offsets in tx.blocks(column):
        starts, ends, first = tx.words(data, offsets, tx.NON_SPACE)
        h = tx.word_hashes(data, starts, ends)
        n = np.diff(first)
        size = np.maximum(np.diff(offsets), 1)
        total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        cols = [np.log1p(n), np.log1p(np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[first]) / np.maximum(n, 1)), total(upper[data]) / size, total(digit[data]) / size, total(data >= 0x80) / size, np.sqrt(total(data == 0x0A) / size)]
        cols += [np.sqrt(total(data == m[0]) / size) for m in _MARKS]
        vary, top = np.ones(j - i), np.zeros(j - i)
        for d in range(j - i):
            if n[d]:
                _, c = np.unique(h[first[d] : first[d + 1]], return_counts=True)
                vary[d], top[d] = len(c) / n[d], c.max() / n[d]
        lower = tx.LOWER[data]
        a, z, begin = tx.words(lower, offsets, tx.ALNUM)
        bucket = (tx.word_hashes(lower, a, z) >> np.uint64(64 - _WORD_BITS)).astype(np.int64)
        of = np.repeat(np.arange(j - i), np.diff(begin))
        held = np.bincount((of << _WORD_BITS) + bucket, minlength=(j - i) << _WORD_BITS).reshape(j - i, -1)
        lexical = np.sqrt(held / np.maximum(np.diff(begin), 1)[:, None])
        out.append(np.concatenate([np.stack([*cols, vary, top, vary * np.log1p(n)], axis=1), lexical], axis=1).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, _MEASURES + (1 << _WORD_BITS)), np.float32)


def metadata(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Hashed language and source, and powers of the length on record (each with a mark where it is missing)."""
    import zlib

    n = np.array([-1.0 if x is None else float(x) for x in n_chars.to_pylist()])
    out = np.zeros((len(n), _BUCKETS + 3))
    for col, values in ((0, lang.to_pylist()), (1, source.to_pylist())):
        for r, v in enumerate(values):
            out[r, zlib.crc32(f"{col}|{v}".encode()) % _BUCKETS] = 1
    length = np.log1p(np.maximum(n, 0))
    out[:, -3], out[:, -2], out[:, -1] = length, length * length / 10, n < 0
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    theta: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = _standard(x, self.mean, self.scale)
        return z @ self.theta[:-1] + self.theta[-1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.curve[0] * self.margin(x) + self.curve[1]


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Columns in standard deviations, at most 8; of the content view, words (its last columns) at a quarter of their size, which the ridge holds closer to none."""
    z = np.clip((x - mean) / scale, -8, 8)
    if z.shape[1] == _MEASURES + (1 << _WORD_BITS):
        z[:, _MEASURES:] *= 0.25
    return z


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _newton(z: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
    theta = np.zeros(z.shape[1])
    hold = ridge * np.eye(len(theta))
    hold[-1, -1] = 1e-6
    for _ in range(30):
        p = _sigmoid(z @ theta)
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + hold, z.T @ (w * (y - p)) - hold @ theta)
        theta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return theta


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 3.0) -> Logistic:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return Logistic(mean, scale, _newton(_standard(x, mean, scale), y, w, ridge))


@dataclass
class Pair:
    content: Logistic
    metadata: Logistic
    share: tuple[float, float]
    base: float

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        odds = self.base + self.share[0] * (self.content.odds(a) - self.base) + self.share[1] * (self.metadata.odds(b) - self.base)
        return _sigmoid(odds)


def co_train(xa: np.ndarray, xb: np.ndarray, y: np.ndarray, kept: np.ndarray, ua: np.ndarray, ub: np.ndarray, rounds: int = 5, take: float = 0.04, sure: float = 0.9) -> Pair:
    """Views a and b of labelled rows and of unlabelled ones; labelled rows that are `kept` out of training calibrate."""
    if kept.all() or not kept.any() or y[~kept].min() == y[~kept].max():  # too few labels to keep some out
        kept = np.zeros(len(y), bool)
    base = float(y.mean())
    base = min(max(base, 1e-3), 1 - 1e-3)
    sets = {v: (x[~kept], y[~kept], np.ones((~kept).sum())) for v, x in (("a", xa), ("b", xb))}
    free = {"a": np.ones(len(ua), bool), "b": np.ones(len(ub), bool)}
    models = {v: fit(*s) for v, s in sets.items()}
    each = max(1, int(take * len(ua)))
    for _ in range(rounds if len(ua) else 0):
        for view, other, x, to in (("a", "b", ua, ub), ("b", "a", ub, ua)):
            p = _sigmoid(models[view].margin(x))
            order = np.argsort(p, kind="stable")
            low = [r for r in order if free[other][r] and p[r] <= 1 - sure][: max(1, round(each * (1 - base)))]
            high = [r for r in order[::-1] if free[other][r] and p[r] >= sure][: max(1, round(each * base))]
            new = np.array(low + high, np.int64)
            free[other][new] = False
            s = sets[other]
            sets[other] = (np.concatenate([s[0], to[new]]), np.concatenate([s[1], np.repeat([0.0, 1.0], [len(low), len(high)])]), np.concatenate([s[2], np.full(len(new), 0.5)]))
        models = {v: fit(*s) for v, s in sets.items()}
    gain = {}
    prior = np.log(base / (1 - base))
    flat = -(base * np.log(base) + (1 - base) * np.log(1 - base))
    for v, x in (("a", xa[kept]), ("b", xb[kept])):
        m, t = models[v].margin(x), y[kept]
        slope, offset = _newton(m[:, None], t, np.ones(len(t)), 0.5) if len(t) and t.min() < t.max() else (1.0, 0.0)
        models[v].curve = (float(max(slope, 0.0)), float(offset) if slope > 0 else float(prior))
        p = np.clip(_sigmoid(models[v].odds(x)), 1e-6, 1 - 1e-6)
        gain[v] = max(0.0, flat + float((t * np.log(p) + (1 - t) * np.log(1 - p)).mean())) if len(t) else 0.5
    top = max(gain.values()) or 1.0
    return Pair(models["a"], models["b"], (gain["a"] / top, gain["b"] / top), float(prior))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return content(batch.column(1)), metadata(batch.column(2), batch.column(3), batch.column(4))


_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sample(rows: DataFrame, most: int, salt: int) -> DataFrame:
    n = rows.count()
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(2**30)) <= int(min(1.0, most / n if n else 1.0) * 2**30))


def train(docs: DataFrame, labels: DataFrame, labelled: int = 4000, unlabelled: int = 6000) -> Pair | None:
    """Fits on bounded samples of the rows whose fold is not 1 (about so many of each kind); None without two kinds of labels.

    About a fifth of the labelled rows, told by a hash of doc_id, calibrates. Rows are put in the order of their ids, so
    neither partitions nor tasks change the model. Null labels are left out and the highest of repeated ones counts; empty
    and null texts are texts without words; other columns play no part.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, m = _views(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary()), b.column(5), b.column(6)], ["doc_id", "a", "b", "y", "kept"])

    own = docs.select(*_COLUMNS).filter(fold(F.col("doc_id")) != 1)
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y")).filter(fold(F.col("doc_id")) != 1)
    kept = (F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(5)) == 0).alias("kept")
    some = own.join(_sample(marks, labelled, 11), "doc_id").select(*_COLUMNS, "y").unionByName(_sample(own, unlabelled, 12).withColumn("y", F.lit(-1)))
    rows = some.select("*", kept).mapInArrow(work, "doc_id long, a binary, b binary, y int, kept boolean").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["doc_id", "y", "a", "b"], kind="stable", ignore_index=True)
    a, b, y = np.stack([np.frombuffer(x, np.float32) for x in rows.a]).astype(float), np.stack([np.frombuffer(x) for x in rows.b]), rows.y.to_numpy()
    known = y >= 0
    if not known.any() or y[known].min() == y[known].max():
        return None
    return co_train(a[known], b[known], y[known].astype(float), rows.kept.to_numpy()[known], a[~known], b[~known])


def score(docs: DataFrame, model: Pair | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier good) of each row; 0.5 if nothing could be learned. Nulls in any column are values of their own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of under a hundred numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5) if shared.value is None else shared.value.score(*_views(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return docs.select(*_COLUMNS).mapInArrow(work, "doc_id long, score double")
