"""Registered queries against their SQL in DuckDB, on the smallest test tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from binwright.workload import ORACLES, QUERIES
from check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
# Long jobs have their own conservation tests; the checker script runs all of them.
QUICK = sorted(n for n in QUERIES if n[0] not in "J")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    differences, n = compare(queries()[name](spark, FOLDER), duck, oracle_sql()[name])
    assert not differences, differences


def test_entry(spark):
    assert entry(spark).count() > 0
