"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts, whatever their labels, is the unlabelled side. With the
prior p of the toxic class the risk is p E_P[l(+)] + max(0, E_U[l(-)] - p E_P[l(-)]): what the unlabelled side costs as
clean, less what its toxic share costs, never below zero. Words are the features: those that stand out among positives,
held by their 64-bit hashes. A logistic model is trained by gradient descent in numpy; two numbers fitted on positives and
unlabelled rows kept out of the training, under the same prior, turn its margin into a probability.
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

_BITS = 20


def _doc_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of rows: how many, their word hashes, and each row's first word."""
    for i, j, data, offsets in tx.blocks(column):
        data = tx.LOWER[data]
        starts, ends, first = tx.words(data, offsets, tx.ALNUM)
        yield j - i, tx.word_hashes(data, starts, ends), first


def _size(first: np.ndarray) -> np.ndarray:
    """A long text holds more known words by chance; its size is a feature of its own."""
    return np.log2(1.0 + np.diff(first)) / 8


def _word_sets(rows: DataFrame, extra: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, length = [], []
            for n, h, f in _doc_words(b.column(0)):
                sets += [np.unique(h[f[d] : f[d + 1]]).tobytes() for d in range(n)]
                length += _size(f).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(length, pa.float64()), b.column(1)], ["words", "size", "mark"])

    return rows.select("text", F.col(extra).cast("int").alias("mark")).mapInArrow(work, "words binary, size double, mark int")


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    per_size: float
    bias: float
    scale: tuple[float, float]

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.words & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def margins(self, n: int, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The bias, the size's share and the weights of each row's distinct known words."""
        out = self.bias + self.per_size * _size(first)
        at = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        if len(at) and len(self.words):
            k = np.minimum(np.searchsorted(self.words, hashes[at]), len(self.words) - 1)
            use = self.words[k] == hashes[at]
            doc = np.searchsorted(first, at[use], "right") - 1
            once = np.unique(doc * len(self.words) + k[use])
            out += np.bincount(once // len(self.words), self.weights[once % len(self.words)], n)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * margin + self.scale[1], -60, 60)))


def _rows(sets: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and word numbers of the known words in the sets."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    k = np.minimum(np.searchsorted(words, flat), max(0, len(words) - 1))
    use = words[k] == flat if len(words) else np.zeros(0, bool)
    return row[use], k[use]


def _select(positive: list[np.ndarray], unlabelled: list[np.ndarray], most: int, least: int, z: float) -> np.ndarray:
    """Words in at least `least` positives, and there oftener than among unlabelled texts by z standard errors; the clearest `most`."""
    words, n = np.unique(np.concatenate(positive), return_counts=True)
    words, n = words[n >= least], n[n >= least]
    if not len(words):
        return words
    _, k = _rows(unlabelled, words)
    m = np.bincount(k, minlength=len(words))
    p, u = n / len(positive), m / max(1, len(unlabelled))
    pooled = (n + m) / (len(positive) + len(unlabelled))
    score = (p - u) / np.sqrt(pooled * (1 - pooled) * (1 / len(positive) + 1 / max(1, len(unlabelled))) + 1e-9)
    keep = np.argsort(-score, kind="stable")[:most]
    return np.sort(words[keep[score[keep] >= z]])


def learn(positive: list[np.ndarray], unlabelled: list[np.ndarray], size_p: np.ndarray, size_u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4, most: int = 2000, least: int = 5, z: float = 5.0) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Words, their weights, the size's and the bias that minimise the non-negative risk with logistic loss (Adam over the whole sample)."""
    words = _select(positive, unlabelled, most, least, z)
    pr, pk = _rows(positive, words)
    ur, uk = _rows(unlabelled, words)
    w, b = np.zeros(len(words)), np.log(prior / (1 - prior))
    theta = np.concatenate([w, [0.0, b]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    np_, nu = len(positive), len(unlabelled)

    def grad(slope: np.ndarray, r: np.ndarray, k: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(k, slope[r], len(words)), [slope @ size, slope.sum()]])

    for t in range(1, steps + 1):
        fp = np.bincount(pr, theta[pk], np_) + theta[-2] * size_p + theta[-1]
        fu = np.bincount(ur, theta[uk], nu) + theta[-2] * size_u + theta[-1]
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        down = grad(su / nu, ur, uk, size_u) - prior * grad(sp / np_, pr, pk, size_p)
        g = prior * grad((sp - 1) / np_, pr, pk, size_p) + down if clean >= 0 else -down  # below zero: only undo the overfit part
        g[:-2] += decay * theta[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return words, theta[:-2], float(theta[-2]), float(theta[-1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from margins of rows that weren't trained on.

    Above a margin where only positives are, the share of unlabelled rows over that of positives is the prior; elsewhere it is
    larger. So the least ratio is taken, of margins at which enough positives are left for its upper bound to be close.
    """
    if not len(positive) or not len(unlabelled):
        return 0.1
    at = np.sort(positive)
    above = 1 - np.arange(len(at)) / len(at)
    of_all = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    bound = np.sqrt(np.log(4 / delta) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / delta) / (2 * len(positive)))
    best = int(np.argmin(of_all / above + bound / above))
    return float(of_all[best] / above[best])


def _calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, from positives and unlabelled rows that weren't trained on.

    With f = a * margin + b the unbiased risk of the logistic loss is E_U[log(1 + e^f)] - p E_P[f], which is convex; Newton's
    method finds its least with a small ridge towards a = 1, b = 0. At the least the mean probability of unlabelled rows is the prior.
    """
    a, b = 1.0, 0.0
    if not len(positive) or not len(unlabelled):
        return a, b
    x = np.stack([unlabelled, np.ones_like(unlabelled)], axis=1)
    goal = prior * np.array([positive.mean(), 1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + 1e-4 * np.eye(2)
        da, db = np.linalg.solve(h, goal - x.T @ p / len(x) - 1e-4 * np.array([a - 1.0, b]))
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def _sample(rows: DataFrame, most: int, salt: int) -> DataFrame:
    n = rows.count()
    share = min(1.0, most / n) if n else 1.0
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(2**30)) <= int(share * 2**30))


def train(docs: DataFrame, labels: DataFrame, positives: int = 1500, unlabelled: int = 6000, prior: float | None = None) -> Model:
    """Fits on bounded samples (about so many rows of each kind) of the rows whose fold is not 1: confirmed positives, and any texts.

    A quarter of each sample is kept out of the training and turns margins into probabilities. No text is used as a
    confirmed negative: the class prior, where it isn't given, is estimated from the rows kept out, after a first fit at
    0.1. Labels of unknown documents, nulls and repeated labels (the highest counts) are fine; without positives every text
    scores low.
    """
    own = docs.select("doc_id", "text").filter(fold(F.col("doc_id")) != 1)
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold(F.col("doc_id")) != 1)
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, -4.0, (1.0, 0.0))
    held = lambda salt: F.when(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(4)) == 0, F.lit(2)).otherwise(F.lit(0))  # noqa: E731  by a hash, so that no order of rows matters
    seen = own.join(_sample(marks.filter("toxic = 1"), positives, 1).select("doc_id"), "doc_id").select("text", (F.lit(1) + held(4)).alias("kind"))
    free = _sample(own, unlabelled, 3).select("text", (F.lit(2) + held(5)).alias("kind"))
    rows = _word_sets(seen.unionByName(free), "kind").toPandas()
    of = {k: [np.frombuffer(x, np.uint64) for x in rows.words[rows.mark == k]] for k in (1, 2, 3, 4)}
    if not of[1] or not of[2]:
        return nothing
    size = {k: rows["size"][rows.mark == k].to_numpy() for k in (1, 2, 3, 4)}

    def fitted(prior: float) -> tuple[tuple, dict[int, np.ndarray]]:
        words, weights, per_size, bias = found = learn(of[1], of[2], size[1], size[2], prior)
        margin = {}
        for k in (3, 4):
            r, w = _rows(of[k], words)
            margin[k] = np.bincount(r, weights[w], len(of[k])) + per_size * size[k] + bias
        return found, margin

    if prior is None:
        _, margin = fitted(0.1)
        prior = class_prior(margin[3], margin[4])
    prior = min(max(prior, 1e-3), 0.9)
    (words, weights, per_size, bias), margin = fitted(prior)
    return Model(words, weights, per_size, bias, _calibrate(margin[3], margin[4], prior))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic) of each row, rows that repeat too; a null or empty text has the score of no known word.

    A very long text is scored whole, in parts of some megabytes. Columns other than doc_id and text play no part; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `most` words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            found = [model.probability(model.margins(*x)) for x in _doc_words(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")
