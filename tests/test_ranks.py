import hashlib

import pytest
from pyspark.sql import functions as F

from binwright.errors import EmptySelectionError
from binwright.operators import dims, ranks
from binwright.operators.bins import chunks_in_groups, grouped_bins, keyed_bins
from binwright.operators.dims import join_dimension
from binwright.operators.ranks import (
    bin_names,
    block_bounds,
    contiguous_ids,
    contiguous_ranges,
    permute_keep_last,
    random_bins,
    rank_by_hash,
    rank_by_value,
    running_sum,
    with_shuffle_key,
)
from binwright.plans.curriculum import grouped_plan, randomized_plan
from tests.conftest import rows


def key_of(value, seed=0):
    return int(hashlib.md5(str(value + seed).encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def skewed(spark):
    """4000 cells with gaps in their ids; a third has one key, some have none, the rest many keys."""
    n = F.col("id")
    return spark.range(4000).select(
        (n * n).alias("id"),
        F.when(n % 3 == 0, F.lit("hot")).when(n % 100 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("k"), (n % 500).cast("string"))).alias("key"),
    ).cache()


def test_random_bins_match_brute_force(skewed):
    ids = sorted((r["id"] for r in skewed.collect()), key=lambda i: (key_of(i, 5), i))
    expected = {i: p // 300 for p, i in enumerate(ids)}
    assert {r["id"]: r["extract_bin"] for r in random_bins(skewed, 300, seed=5).collect()} == expected


def test_bins_do_not_depend_on_partitions_or_buckets(spark, skewed):
    base = rows(random_bins(skewed, 300, seed=5), "id", "extract_bin")
    keyed = rows(keyed_bins(skewed, ["key"], 70, seed=5), "id", "extract_bin")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert rows(random_bins(skewed.repartition(11), 300, seed=5), "id", "extract_bin") == base
        assert rows(keyed_bins(skewed.repartition(3), ["key"], 70, seed=5), "id", "extract_bin") == keyed
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    ranked = [rows(rank_by_hash(with_shuffle_key(skewed), buckets=b), "id", "rank") for b in (1, 2, 4096)]
    assert ranked[0] == ranked[1] == ranked[2]


def test_seed_changes_bins(skewed):
    assert rows(random_bins(skewed, 300, 1), "id", "extract_bin") != rows(random_bins(skewed, 300, 2), "id", "extract_bin")


@pytest.mark.parametrize("hot_rows", [100, 1_000_000])
def test_keyed_bins_match_brute_force(skewed, monkeypatch, hot_rows):
    monkeypatch.setattr(ranks, "HOT_GROUP_ROWS", hot_rows)
    by_key = {}
    for r in skewed.collect():
        by_key.setdefault(r["key"], []).append(r["id"])
    expected, first = {}, 0
    for key in sorted(by_key, key=lambda k: (k is not None, k or "")):
        ids = sorted(by_key[key], key=lambda i: (key_of(i, 9), i))
        for position, i in enumerate(ids):
            expected[i] = first + position // 70
        first += -(-len(ids) // 70)
    assert {r["id"]: r["extract_bin"] for r in keyed_bins(skewed, ["key"], 70, seed=9).collect()} == expected


@pytest.mark.parametrize("hot_rows", [100, 1_000_000])
def test_grouped_bins_follow_ids(skewed, monkeypatch, hot_rows):
    monkeypatch.setattr(ranks, "HOT_GROUP_ROWS", hot_rows)
    by_key = {}
    for r in skewed.collect():
        if r["key"] is not None:
            by_key.setdefault(r["key"], []).append(r["id"])
    expected, first = {}, 0
    for key in sorted(by_key):
        for position, i in enumerate(sorted(by_key[key])):
            expected[i] = first + position // 64
        first += -(-len(by_key[key]) // 64)
    assert {r["id"]: r["extract_bin"] for r in grouped_bins(skewed, ["key"], 64).collect()} == expected
    chunks = chunks_in_groups(skewed, ["key"], 64).groupBy("key", "chunk").count()
    assert chunks.filter("count > 64").count() == 0


def test_hot_group_is_split(skewed, monkeypatch):
    monkeypatch.setattr(ranks, "HOT_GROUP_ROWS", 100)
    split = ranks.split_hot_groups(skewed.dropna(), ["key"], lambda d: ranks.with_value_bucket(d, "id", 16))
    buckets = dict(rows(split.rows.groupBy("key").agg(F.count_distinct("_bucket").alias("n"))))
    assert buckets.pop("hot") == 16 and set(buckets.values()) == {1}
    assert split.offsets.count() == 16 + len(buckets)


def test_rank_by_value_with_outliers(spark):
    ids = [*range(1000), 10**15, 10**18]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert rows(rank_by_value(df), "id", "rank") == [(i, p + 1) for p, i in enumerate(ids)]
    assert rows(rank_by_value(df.filter("id < 0")), "id", "rank") == []


def test_ranges_and_ids(spark, skewed):
    ids = sorted(r["id"] for r in skewed.collect())
    expected = [(c, ids[c * 900], ids[min(c * 900 + 899, 3999)], min(900, 4000 - c * 900)) for c in range(5)]
    assert rows(contiguous_ranges(skewed, 900)) == expected
    labels = spark.createDataFrame([(p, f"cell_{p}") for p in range(50)], "row_pos bigint, obs_id string")
    assert rows(contiguous_ids(labels, 10, order="row_pos"), "row_pos", "id") == [(p, p + 10) for p in range(50)]
    assert sorted(r["id"] for r in contiguous_ids(labels, 10).collect()) == list(range(10, 60))


def test_running_sum_over_many_keys(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit(2).alias("n"))
    assert rows(running_sum(df, ["k"], {"s": "n"}), "k", "s") == [(k, 2 * k) for k in range(5000)]


def test_names_keep_last(spark):
    bins = spark.range(40).withColumnRenamed("id", "extract_bin")
    named = dict(rows(bin_names(bins, 40, seed=3), "extract_bin", "output_bin"))
    assert sorted(named.values()) == list(range(40)) and named[39] == 39
    assert [named[b] for b in range(39)] == [
        sorted(range(39), key=lambda v: (key_of(v, 3), v)).index(b) for b in range(39)
    ]
    assert rows(bin_names(bins, 40, None)) == [(b, b) for b in range(40)]
    assert rows(permute_keep_last(spark.range(1).withColumnRenamed("id", "p"), "p", 1, 0, "q")) == [(0, 0)]


def test_block_bounds():
    assert [block_bounds(10, i, 4) for i in range(4)] == [(0, 4), (4, 8), (8, 10), (10, 10)]


def test_plans(skewed):
    plan = randomized_plan(skewed, 900, 700, seed=1, filters={"key__eq": "hot"})
    assert plan.summary.first().asDict() == {
        "total_cells": 1334, "range_size": 900, "num_ranges": 2, "extract_bin_size": 700, "num_bins": 2,
        "last_bin_size": 634,
    }
    assert rows(plan.bin_names) == [(0, 0), (1, 1)]
    grouped = grouped_plan(skewed, ["key"], 500)
    summary = grouped.summary.first()
    assert summary["total_cells"] + summary["n_null_key"] == 4000
    hot = [r for r in grouped.bins.collect() if r["key"] == "hot"]
    assert sorted(r["cell_count"] for r in hot) == [334, 500, 500]
    for bad in ({"range_size": 0, "bin_size": 5}, {"range_size": 5, "bin_size": 0}):
        with pytest.raises(ValueError):
            randomized_plan(skewed, **bad)
    with pytest.raises(EmptySelectionError):
        randomized_plan(skewed, 5, 5, filters={"key__eq": "absent"})
    with pytest.raises(EmptySelectionError):
        grouped_plan(skewed, ["key"], 5, filters={"key__eq": "absent"})
    with pytest.raises(ValueError):
        grouped_plan(skewed, [], 5)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_large_dimension_is_salted_and_exact(skewed, how, monkeypatch):
    monkeypatch.setattr(dims, "HOT_ROWS", 50)
    dim = skewed.select("key").dropna().distinct().filter("key <> 'k7'")
    dim = dim if how in ("left_semi", "left_anti") else dim.withColumn("n", F.length("key"))
    small = join_dimension(skewed, dim, "key", how)
    large = join_dimension(skewed, dim, "key", how, salt_on="id", rows=10)
    order = small.columns
    assert sorted(map(str, small.select(order).collect())) == sorted(map(str, large.select(order).collect()))
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def test_no_single_task_over_cells(skewed, capsys):
    """The only one-task windows run over bucket tables, never over cell rows."""
    random_bins(skewed, 300).explain("formatted")
    text = capsys.readouterr().out
    windows = [b for b in text.split("\n\n") if "SinglePartition" in b]
    assert windows and all("_bucket" in b and "key#" not in b for b in windows)


def test_broadcast_counts_bytes(spark, monkeypatch):
    narrow = spark.range(1000)
    wide = narrow.select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    monkeypatch.setattr(dims, "BROADCAST_BYTES", 500_000)
    assert dims.fits_broadcast(narrow) and not dims.fits_broadcast(wide) and not dims.fits_broadcast(narrow, rows=10)
    assert dims.fits_broadcast(wide.limit(0))
