"""Every registered query against its statement in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def comparable(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    cells = frame.where(frame.notna(), None).itertuples(index=False)
    return sorted(tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in cells)


def test_every_statement_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    result = entry_points.queries()[name](spark, FOLDER)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = result.toPandas()
    statement = entry_points.oracle_sql().get(name)
    if statement is None:
        assert len(got) > 0
        return
    expected = duck.sql(statement).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert comparable(got) == comparable(expected)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 150
