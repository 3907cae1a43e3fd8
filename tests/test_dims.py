"""Joins with dimensions that are too large to broadcast: only hot keys are cut and copied."""

import pytest
from pyspark.sql import functions as F

from binwright.operators import dims
from binwright.operators.dims import heavy_keys, join_dimension
from tests.conftest import rows


@pytest.fixture()
def tables(spark, monkeypatch):
    monkeypatch.setattr(dims, "HOT_ROWS", 100)
    n = F.col("id")
    big = spark.range(2000).select(n.alias("v"), F.when(n % 2 == 0, 7).when(n % 8 == 1, 8).otherwise(n % 300).alias("k"), (n % 2).alias("half"))
    dim = spark.range(310).select(n.alias("k"), (n * 10).alias("d")).filter("k % 11 <> 5")
    return big, dim


def test_only_hot_keys_are_heavy(spark, tables):
    big, _ = tables
    held = {r["k"]: r["count"] for r in big.groupBy("k").count().collect()}
    hashes = {r["k"]: r["h"] for r in big.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    assert heavy_keys(big, ["k"]) == {hashes[k]: -(-n // 100) for k, n in held.items() if n > 100}
    assert len(heavy_keys(big, ["k"])) == 2 and heavy_keys(big.limit(0), ["k"]) == {}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_results_do_not_depend_on_the_way(tables, how):
    big, dim = tables
    assert rows(join_dimension(big, dim, "k", how, fits=False), *big.columns) == rows(join_dimension(big, dim, "k", how, fits=True), *big.columns)
    both = ["k", "half"]
    wide = dim.crossJoin(dim.sparkSession.range(2).withColumnRenamed("id", "half"))
    assert rows(join_dimension(big, wide, both, how, salt_on="v", fits=False), *big.columns) == rows(join_dimension(big, wide, both, how, fits=True), *big.columns)


def test_a_hot_key_is_spread_and_others_are_not_copied(spark, tables):
    big, dim = tables
    found = join_dimension(big, dim, "k", fits=False)
    spread = join_dimension(big, dim, "k", salt_on="v", fits=False)
    assert found.count() == spread.count()
    heavy = heavy_keys(big, ["k"])
    parts = big.withColumn("_salt", F.pmod(F.xxhash64("v"), dims._salts(["k"], heavy))).groupBy("k").agg(F.count_distinct("_salt").alias("n"))
    assert {r["k"] for r in parts.filter("n > 1").collect()} == {7, 8} and parts.filter("k = 7").first()["n"] >= 9
    copies = dim.select(dims._salts(["k"], heavy).alias("n")).agg(F.sum("n")).first()[0]
    assert copies == dim.count() - 2 + sum(heavy.values())


def test_without_hot_keys_nothing_is_copied(tables):
    big, dim = tables
    cold = big.filter("k <> 7 AND k <> 8")
    text = join_dimension(cold, dim, "k", fits=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in text and rows(join_dimension(cold, dim, "k", fits=False)) == rows(join_dimension(cold, dim, "k", fits=True))


def test_a_table_that_does_not_fit_is_never_broadcast(tables):
    """What is made from a small file looks as small as the file to Spark."""
    big, dim = tables
    made = dim.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(9)))).filter("n = 0").drop("n")
    for of in (big, big.filter("k <> 7 AND k <> 8")):
        plan = join_dimension(of, made, "k", fits=False)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
