"""Every registered query against its SQL on the smallest shared tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import compare, connect

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, ROOT)
    assert ok, note


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "pIC50" in df.columns


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())
