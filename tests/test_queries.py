"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from trailmark import plans

SQL, QUERIES = plans.all_sql(), plans.all_queries()


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return c


def rows(names, got):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(clean(r[i]) for i in order) for r in got), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
