"""Every registered query against its SQL on another engine."""

import duckdb
import pytest

import __spark_entry__ as entry
from patchloom.plans import oracle
from patchloom.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ["documents", "labels", "conversations", "events"]
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_same_names():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR)
    want = duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = [want.columns.index(c) for c in columns]
    found = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    assert found == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
