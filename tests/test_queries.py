"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

_SQL = entry.oracle_sql()
_QUERIES = entry.queries()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(data + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = _QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rows = duck.execute(_SQL[name])
    names = [x[0] for x in rows.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rows.fetchall())


@pytest.mark.parametrize("name", sorted(_QUERIES.keys() - _SQL.keys()))
def test_query_runs(spark, data, name):
    _QUERIES[name](spark, data).count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
