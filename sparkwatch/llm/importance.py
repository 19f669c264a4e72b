"""Importance resampling: documents drawn so that their words look like those of a target.

Features are runs of consecutive words, hashed into buckets by CRC-32 (position tables, see crc.py). How much more often the
target has a bucket than the source sets its gain, a document's weight is the sum of its features' gains, and its score adds
noise that only its id decides. The highest scores are a draw without replacement, with chances in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import Scratch, numbered
from .crc import crc32_spans, spread


def _features(column: pa.Array, runs: tuple[int, int], buckets: int) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each block of rows the number of words of each row and, for each length of run, the features' buckets and each row's first (one more at the end)."""
    for _, _, data, offsets in tx.blocks(column):
        data = tx.LOWER[data]
        starts, ends, first = tx.words(data, offsets, tx.ALNUM)
        if runs[1] > 1:  # runs hold one space between words, however far apart these were
            n = ends - starts
            new = np.cumsum(n + 1) - n - 1
            plain = np.full(int((n + 1).sum()), 0x20, np.uint8)
            plain[spread(new, n)] = data[spread(starts, n)]
            data, starts, ends = plain, new, new + n
        found = []
        for k in range(runs[0], runs[1] + 1):
            inside = np.maximum(np.diff(first) - k + 1, 0)
            a = spread(first[:-1], inside)
            crc = crc32_spans(data, starts[a], ends[a + k - 1])
            found.append(((crc % np.uint32(buckets)).astype(np.int64), np.concatenate([[0], np.cumsum(inside)])))
        yield np.diff(first), found


def bucket_counts(texts: DataFrame, runs: tuple[int, int] = (1, 1), buckets: int = 10000) -> DataFrame:
    """bucket, n: how many features of all rows' `text` fall in each bucket that has any. Each task adds its own up first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in _features(batch.column(0), runs, buckets):
                for bucket, _ in found:
                    counts += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    return texts.select("text").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10000) -> np.ndarray:
    """Each bucket's gain: floor(1000 ln of (t + 1) (S + buckets) / ((s + 1) (T + buckets))), from at most `buckets` counts of each side."""

    def dense(counts: DataFrame) -> np.ndarray:
        out, found = np.zeros(buckets, np.int64), counts.toArrow()  # at most `buckets` rows
        out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        return out

    s, t = dense(source), dense(target)
    every_s, every_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (every_s + buckets) / ((a + 1) * (every_t + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, runs: tuple[int, int] = (1, 1)) -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of its features' gains) of each row."""
    gain_of = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n_words, found in _features(batch.column(1), runs, len(gain_of.value)):
                words.append(n_words)
                n.append(sum(np.diff(at) for _, at in found))
                sums = [(np.concatenate([[0], np.cumsum(gain_of.value[bucket])]), at) for bucket, at in found]
                weight.append(sum(c[at[1:]] - c[at[:-1]] for c, at in sums))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, seed: int = 2024, runs: tuple[int, int] = (1, 1), buckets: int = 10000) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (1, 2, 3, ... in the order drawn; null if not drawn) of each row of docs.

    Words are runs of digits, letters A-Z in lower case and anything beyond ASCII. Of the rows with at least `least` words,
    `percent` percent (rounded down) are drawn: the highest scores, ties to the smaller doc_id, then to the smaller weight.
    A null or empty text has no features and weight 0; an empty target gives each bucket no counts; a null doc_id draws its
    noise as an empty one. Rows that repeat a doc_id are ranked one by one. Other columns play no part, and an empty table
    gives an empty result. Very long texts and words are taken whole.
    """
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets), buckets)
    scratch = Scratch(docs.sparkSession)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")
    scored = scratch.write(weights(docs, gain, runs).withColumn("score", F.col("weight") + noise), "scored")
    drawn = scored.filter(F.col("n_words") >= least).count() * percent // 100
    fits = F.col("n_words") >= least
    out = numbered(scored, F.desc(fits), F.desc("score"), F.asc("doc_id"), F.asc("weight"), name="__at", scratch=scratch)
    scratch.drop()
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("__at") < drawn, F.col("__at") + 1).alias("rank"))
