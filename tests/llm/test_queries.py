"""Registered corpus queries: those with SQL against DuckDB on the smallest tables, and which have none."""

import os

import pytest

import corpus_pipeline
from binwright.llm.queries import ORACLES, QUERIES
from check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


def test_queries_without_sql():
    # Models, tokenizers and set joins of whole tables are held against brute force or the library elsewhere.
    assert {n.split("_")[0] for n in QUERIES.keys() - ORACLES.keys()} == {"op3", "op4", "op5", "op7", "op8", "op9", "op10", "op11", "op12", "op13"}
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    differences, n = compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name])
    assert n and not differences, differences
