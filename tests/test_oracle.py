"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lodestar.plans import registry
from lodestar.sources.fixtures import TABLES

SQL = registry.oracle_sql()


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        return round(float(v), 6) if isinstance(v, float) else str(v)

    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    ours, theirs = registry.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
