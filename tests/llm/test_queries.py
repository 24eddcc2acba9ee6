"""Registered corpus queries against their SQL."""

import glob
import os

import duckdb
import pytest

from loglake.llm import queries as corpus

TESTDATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", corpus.oracle_sql())
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{TESTDATA}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    expected, result = duck.sql(corpus.oracle_sql()[name]), corpus.queries()[name](spark, TESTDATA)
    columns = sorted(expected.columns)
    assert sorted(result.columns) == columns
    rows = [tuple(row[c] for c in columns) for row in result.collect()]
    assert sorted(rows, key=repr) == sorted(expected.select(*columns).fetchall(), key=repr)


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in corpus.queries()) == list(range(1, 14))
