"""Every registered query against its SQL twin, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from tests.oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    ok, message, count, _ = compare(spark, connection, QUERIES[name], SQL.get(name), FOLDER)
    assert ok, message


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0


def test_sql_has_query():
    assert set(SQL) <= set(QUERIES)
