"""Numbers and running sums over ordered rows, against the plain way."""

import random

from pyspark.sql import functions as F

from sparkwatch.functions.stats import expected_top_k, rank_metrics
from sparkwatch.functions.stored import numbered


def test_numbers_and_sums_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 5, 9, None]), rng.choice([1, 2, None]), f"r{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int, position string").withColumnRenamed("position", "name").repartition(7)
    out = numbered(df, F.desc_nulls_last("k"), sums={"v": "before"}, parts=5)
    assert out.columns == ["k", "v", "name", "position", "before"]
    got = sorted(out.collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(3000))
    keys = [r.k if r.k is not None else -1 for r in got]
    assert keys == sorted(keys, reverse=True) and sorted(r.name for r in got) == sorted(r[2] for r in rows)
    total = 0
    for r in got:
        assert r.before == total
        total += r.v or 0
    assert numbered(df.limit(0), "k", sums={"v": "before"}).count() == 0


def test_rank_metrics_use_no_window_over_all_rows(spark):
    rows = [(s, l) for s, l in zip([9, 9, 7, 7, 7, 3, 1, None], [1, 0, 1, 1, 0, 0, 1, 1])]
    df = spark.createDataFrame(rows, "score int, label int")
    assert expected_top_k(df, "score", "label", 4).first()[0] == 1 + 2 * 2 / 3
    m = rank_metrics(df, "score", "label", 4, 0.5)
    assert abs(m.first().precision_at_k - (1 + 4 / 3) / 4) < 1e-12 and abs(m.first().recall_at_share - (1 + 4 / 3) / 5) < 1e-12
    windows = [x for x in m._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    assert windows and all("windowspecdefinition(__part" in x for x in windows)
