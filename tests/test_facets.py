"""Facets kept per ingest: only new ingests are read, and the result is that of a full recompute."""

import os

from pyspark.sql import functions as F

from binwright.operators.ranks import rank_by_value
from binwright.plans.facets import facet_rows, facet_state, merged_facets, refresh_warehouse_facets
from binwright.session import scratch_path
from binwright.sources.base import append_ingests, read_table
from tests.conftest import rows


def ingest(spark, warehouse, number, n, kinds):
    cells = spark.range(n).select(
        (F.col("id") + number * 1000).alias("id"), F.concat(F.lit("c"), "id").alias("original_id"), F.lit(number).cast("bigint").alias("ingest_id"),
        F.lit("{}").alias("metadata_extra"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % len(kinds) + 1).cast("int")).alias("cell_type"),
        F.concat(F.lit(f"d{number}_"), (F.col("id") % 4).cast("string")).alias("donor_id"),
    )
    append_ingests(spark, warehouse, {
        "ingest_info": spark.createDataFrame([(number, "{}")], "id bigint, metadata_extra string"), "cell_info": cells,
        "feature_info": spark.createDataFrame([], "id bigint, ensemble_id string, ingest_id bigint, metadata_extra string, reference string"),
        "raw_matrix_coo": spark.createDataFrame([], "cell_id bigint, feature_id bigint, raw_count bigint, ingest_id bigint"),
    })


def test_refresh_reads_new_ingests_only(spark):
    warehouse, path = scratch_path(spark, "wh"), scratch_path(spark, "facets")
    ingest(spark, warehouse, 0, 20, ["a", "b"])
    assert rows(refresh_warehouse_facets(spark, warehouse, path, "d", 5)) == rows(facet_rows(read_table(spark, warehouse, "cell_info"), "d", 5))
    ingest(spark, warehouse, 1, 10, ["b", "c", None])
    want = rows(facet_rows(read_table(spark, warehouse, "cell_info"), "d", 5))
    for name in os.listdir(f"{warehouse}/cell_info/ingest_id=0"):
        os.rename(f"{warehouse}/cell_info/ingest_id=0/{name}", f"{warehouse}/held{name}")
        with open(f"{warehouse}/cell_info/ingest_id=0/{name}", "wb") as f:
            f.write(b"not a table")
    found = rows(refresh_warehouse_facets(spark, warehouse, path, "d", 5))
    assert found == want
    assert [r[1:] for r in found] == [("cell_type", "a", 1), ("cell_type", "b", 1), ("cell_type", "c", 1), ("total_cells", None, 30)]
    assert rows(refresh_warehouse_facets(spark, warehouse, path, "d", 5)) == want  # nothing new: nothing is read


def test_state_is_bounded_by_the_limit(spark):
    cells = spark.range(1000).select(
        (F.col("id") % 2).alias("ingest_id"), F.col("id").cast("string").alias("many"), (F.col("id") % 3).cast("string").alias("few"), F.lit(None).cast("string").alias("none")
    )
    state = facet_state(cells, 10)
    assert state.filter("facet = 'many'").count() == 2 and state.filter("facet = 'few'").count() == 8
    assert rows(merged_facets(state, "d", 10)) == rows(facet_rows(cells, "d", 10))
    halves = facet_state(cells, 3).filter("facet = 'few'")
    assert merged_facets(halves, "d", 2).count() == 1  # within the limit in no union


def test_another_threshold_starts_anew(spark):
    warehouse, path = scratch_path(spark, "wh"), scratch_path(spark, "facets")
    ingest(spark, warehouse, 0, 20, ["a", "b", "c"])
    for threshold in (2, 4, 2):
        found = refresh_warehouse_facets(spark, warehouse, path, "d", threshold)
        assert rows(found) == rows(facet_rows(read_table(spark, warehouse, "cell_info"), "d", threshold))


def test_ranks_of_text_and_null_values(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("c",), ("aa",)], "name string").repartition(4)
    assert {r["name"]: r["rank"] for r in rank_by_value(df, "name", "rank").collect()} == {None: 1, "a": 2, "aa": 3, "b": 4, "c": 5}


def test_ranks_read_their_input_twice(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(0, 10_000, numPartitions=4).rdd.map(lambda r: (seen.add(1), r)[1]).toDF("id bigint")
    ranked = rank_by_value(df, "id", "rank")
    assert ranked.filter("rank <> id + 1").count() == 0 and seen.value <= 20_000  # once to choose the ranges, once to sort
