"""Every registered query of the engine against its SQL in DuckDB, and rows of those without SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from quarry.plans import relational, search, upkeep

QUERIES = relational.QUERIES | search.QUERIES | upkeep.QUERIES
SQL = relational.SQL | search.SQL | upkeep.SQL


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("set TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, sf, duck, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_runs(spark, sf, name):
    QUERIES[name](spark, sf).collect()


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score"]
