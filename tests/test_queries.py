"""Every registered query of the rule engine against its SQL in DuckDB, on the same tables."""

import math

import duckdb
import pytest

from sparkwatch import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 8) if not isinstance(v, (bool, str)) and hasattr(v, "__float__") else str(v)


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([_plain(r[i]) for i in order] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = q.queries()[name](spark, sf_dir)
    result = con.execute(q.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert rows(df.collect(), df.columns) == rows(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    assert q.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
