"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

from conftest import TESTDATA

# Corpus queries have tests of their own.
QUERIES, SQL = entry_module._log_queries(), entry_module._log_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{TESTDATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, TESTDATA)
    expected = duck.sql(SQL[name])
    assert sorted(result.columns) == sorted(expected.columns)
    assert canonical(result.collect(), result.columns) == canonical(expected.fetchall(), expected.columns)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
