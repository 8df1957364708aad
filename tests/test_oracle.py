"""Every query with SQL against DuckDB over the smallest test data."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def rows(df):
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, data, con, name):
    got = entry.queries()[name](spark, data).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, data, name):
    """Their results are tested elsewhere, against brute force or round trips; here that they give some, without repeated rows."""
    df = entry.queries()[name](spark, data)
    n = df.count()
    assert n > 0 and len(df.columns) == len(set(df.columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
