"""Every query with SQL gives the same rows as DuckDB at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, str):
        return v
    return round(float(v), 9) if not hasattr(v, "__len__") else str(list(v))


def _rows(df):
    return sorted(map(repr, (tuple(_plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
