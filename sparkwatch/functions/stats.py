"""Intervals and paired statistics as Columns."""

from __future__ import annotations

from math import ceil, comb, gamma, pi, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import numbered


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share's Wilson interval; 0 and 0 for none of none."""
    p, zz = k / n, z * z
    mid, wide = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - wide)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + wide)).otherwise(0.0)


def discordant(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often only a, and only b, holds."""
    return df.agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))


def mcnemar(only_a: int, only_b: int) -> float:
    """Exact two-sided p of a paired comparison."""
    n, k = only_a + only_b, min(only_a, only_b)
    return 1.0 if not n else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two yes-or-no ratings; 1 if chance alone would agree."""
    both, neither, n = F.count_if(F.col(a) & F.col(b)), F.count_if(~F.col(a) & ~F.col(b)), F.count("*")
    out = df.agg(both.alias("both"), neither.alias("neither"), F.count_if(a).alias("a"), F.count_if(b).alias("b"), n.alias("n"))
    agree = (F.col("both") + F.col("neither")) / F.col("n")
    chance = (F.col("a") * F.col("b") + (F.col("n") - F.col("a")) * (F.col("n") - F.col("b"))) / (F.col("n") * F.col("n"))
    return out.withColumn("kappa", F.when(chance == 1, 1.0).otherwise((agree - chance) / (1 - chance)))


def _running(df: DataFrame, score: str, label: str) -> DataFrame:
    """Groups of equal scores with their rows, positives and how many rows have higher scores: running sums over ranges of scores, null scores last."""
    groups = df.groupBy(score).agg(F.count("*").alias("size"), F.count_if(F.col(label) == 1).alias("hits"))
    return numbered(groups, F.desc_nulls_last(score), sums={"size": "before"})


def _expected(top: int | Column) -> Column:
    """Expected positives among the top rows: of a group that only part of fits, each row is as likely as any other."""
    taken = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(top) - F.col("before")))
    return F.sum(F.col("hits") * taken / F.col("size"))


def expected_top_k(df: DataFrame, score: str, label: str, k: int) -> DataFrame:
    """Expected positives among the top k where ties are broken at random."""
    return _running(df, score, label).agg(_expected(k).alias("expected_hits"))


def rank_metrics(df: DataFrame, score: str, label: str, k: int, share: float = 0.1) -> DataFrame:
    """precision_at_k and recall_at_share: expected positives among the top k, and among the top share of all rows, ties broken at random."""
    groups = _running(df, score, label)
    n = groups.agg(F.sum("size")).first()[0] or 0
    return groups.agg((_expected(k) / k).alias("precision_at_k"), F.try_divide(_expected(ceil(share * n)), F.sum("hits")).alias("recall_at_share"))


def t_quantile(p: float, df: int) -> float:
    """The quantile of Student's t, by halving an interval on its distribution function (Simpson's rule)."""
    scale = gamma((df + 1) / 2) / (sqrt(df * pi) * gamma(df / 2))
    density = lambda x: scale * (1 + x * x / df) ** (-(df + 1) / 2)

    def below(x: float, steps: int = 400) -> float:
        h = x / steps
        return 0.5 + h / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * density(i * h) for i in range(steps + 1))

    lo, hi = 0.0, 1000.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return lo


def mean_interval(df: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """mean, sd, n of a column's values and the bounds lo and hi of the mean's t interval (null for fewer than two values)."""
    out = df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.count(column).alias("n"))
    n = out.first()["n"]
    half = F.lit(t_quantile(0.5 + level / 2, n - 1) if n > 1 else None).cast("double") * F.col("sd") / F.sqrt("n")
    return out.withColumns({"lo": F.col("mean") - half, "hi": F.col("mean") + half})


def bootstrap_kappa(df: DataFrame, a: str, b: str, rounds: int = 2000, seed: int = 7) -> tuple[float, float]:
    """The 95 % interval of kappa: the four counts are drawn again from their own shares."""
    row = df.agg(*[F.count_if(x).alias(n) for n, x in (("tt", F.col(a) & F.col(b)), ("tf", F.col(a) & ~F.col(b)), ("ft", ~F.col(a) & F.col(b)), ("ff", ~F.col(a) & ~F.col(b)))]).first()
    counts = np.array(row, float)
    n = counts.sum()
    if not n:
        return 0.0, 0.0
    tt, tf, ft, ff = np.random.default_rng(seed).multinomial(int(n), counts / n, rounds).T
    chance = ((tt + tf) * (tt + ft) + (ft + ff) * (tf + ff)) / n**2
    found = np.where(chance == 1, 1.0, ((tt + ff) / n - chance) / np.where(chance == 1, 1.0, 1 - chance))
    lo, hi = np.percentile(found, [2.5, 97.5])
    return float(lo), float(hi)
