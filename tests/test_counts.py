"""What is read and what moves between the count table and packed rows: results and plans."""

import os

import pytest
from pyspark.sql import functions as F

from binwright.operators import counts as packing
from binwright.operators.counts import id_ranges, pack_selected, pruned_counts
from binwright.operators.joins import counts_of_cells
from binwright.plans.extract import BUCKETS_SUFFICE, assemble, extract_bins
from binwright.plans.prepare import ExtractSpec, number_features, prepare_extract
from binwright.session import scratch_path, setting, written
from binwright.sources.base import append_ingests, read_tables
from binwright.sources.sinks import PACKED_COUNTS, read_binned, read_bucketed
from tests.conftest import rows

N_FEATURES = 12


@pytest.fixture(scope="module")
def warehouse(spark):
    """Three ingests of 40 cells; each brings its own ids for the same features, ingest 2 in another order and with a repeat."""
    path, n = scratch_path(spark, "warehouse"), F.col("id")
    ingest = F.call_function("div", n, F.lit(40))
    cells = spark.range(120).select(
        (n + ingest * 1_000_000).alias("id"), F.concat(F.lit("c"), n.cast("string")).alias("original_id"), ingest.alias("ingest_id"),
        F.lit("{}").alias("metadata_extra"), F.concat(F.lit("t"), (n % 3).cast("string")).alias("tissue"),
    )
    place, of = n % N_FEATURES, F.call_function("div", n, F.lit(N_FEATURES))
    gene = F.when(of == 2, F.when(place == 11, 5).otherwise(11 - place)).otherwise(place)
    features = spark.range(3 * N_FEATURES).select(
        "id", F.concat(F.lit("E"), gene.cast("string")).alias("ensemble_id"), of.alias("ingest_id"), F.lit("{}").alias("metadata_extra"),
        F.lit("r").alias("reference"),
    )
    counts = cells.crossJoin(spark.range(N_FEATURES).withColumnRenamed("id", "place")).filter("(id + place) % 3 <> 0 AND id % 7 <> 3").select(
        F.col("id").alias("cell_id"), (F.col("ingest_id") * N_FEATURES + F.col("place")).alias("feature_id"),
        (F.col("id") % 50 + F.col("place") + 1).alias("raw_count"), "ingest_id",
    )
    ingests = spark.range(3).select("id", F.lit("{}").alias("metadata_extra"))
    append_ingests(spark, path, {"ingest_info": ingests, "cell_info": cells, "feature_info": features, "raw_matrix_coo": counts})
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broken_except(path, kept):
    """Makes the counts of all other ingests unreadable; returns how to undo it."""
    held = {}
    for folder, _, names in os.walk(f"{path}/raw_matrix_coo"):
        if "ingest_id=" in folder and not folder.endswith(f"ingest_id={kept}"):
            for name in names:
                with open(f"{folder}/{name}", "rb") as f:
                    held[f"{folder}/{name}"] = f.read()
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(b"not a table")
    return held


def test_counts_of_other_ingests_are_not_read(spark, warehouse):
    tables = read_tables(spark, warehouse)
    cells = written(tables["cell_info"].filter("ingest_id = 1").withColumn("extract_bin", F.col("id") % 4), "cells")
    want = rows(tables["raw_matrix_coo"].filter("ingest_id = 1"), "cell_id", "feature_id", "raw_count")
    held = broken_except(warehouse, 1)
    try:
        found = counts_of_cells(read_tables(spark, warehouse)["raw_matrix_coo"], cells)
        assert want and rows(found, "cell_id", "feature_id", "raw_count") == want
    finally:
        for name, data in held.items():
            with open(name, "wb") as f:
                f.write(data)
    text = plan(pruned_counts(tables["raw_matrix_coo"], cells))
    assert "dynamicpruning" in text and "GreaterThanOrEqual(cell_id,1000040)" in text


def test_id_ranges_hold_all_cells(spark, monkeypatch):
    ids = spark.createDataFrame([(5,), (99_999,), (100_000,), (1_500_000,), (1_500_001,), (9_000_000,)], "id bigint")
    assert id_ranges(ids) == [(5, 100_000), (1_500_000, 1_500_001), (9_000_000, 9_000_000)]
    assert id_ranges(ids, 2) == [(5, 1_500_001), (9_000_000, 9_000_000)]
    assert id_ranges(ids.limit(0)) == []
    monkeypatch.setattr(packing, "MOST_BLOCKS", 2)
    assert id_ranges(ids) == [(5, 9_000_000)]


@pytest.fixture(scope="module")
def selection(spark, warehouse):
    tables = read_tables(spark, warehouse)
    cells = written(tables["cell_info"].filter("id % 5 <> 0").select("id", "ingest_id", (F.col("id") % 4).alias("extract_bin")), "cells")
    wanted = spark.createDataFrame([("E3", 0), ("E5", 1), ("E0", 2), ("E3", 3)], "ensemble_id string, extract_feature_id bigint")
    mapping = tables["feature_info"].join(wanted, "ensemble_id").select(F.col("id").alias("feature_id"), "extract_feature_id")
    return tables, cells, mapping


def test_positions_give_the_same_rows_in_one_exchange(spark, selection, monkeypatch):
    tables, cells, mapping = selection
    pack = lambda fits: pack_selected(tables["raw_matrix_coo"], cells, tables["feature_info"], mapping, ["extract_bin"], fits)
    want = rows(pack(True))
    assert want and any(len(r[2]) > 3 for r in want)
    monkeypatch.setattr(packing, "CELLS_PER_BLOCK", 7)
    by_position = pack(False)
    assert by_position.columns == ["extract_bin", "cell_id", "feature_data"] and rows(by_position) == want
    text = plan(pack(False))
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning(ingest_id" in line and "REPARTITION" in line]
    assert len(moved) == 2  # the counts with their cells, and the copies of the positions
    assert "Exchange hashpartitioning(cell_id" not in text
    assert len([line for line in text.splitlines() if "FileScan" in line and "raw_count:" in line]) == 1


def test_ids_that_are_no_block_are_joined(spark, selection):
    tables, cells, mapping = selection
    far = tables["feature_info"].withColumn("id", F.col("id") * 1000)
    counts = tables["raw_matrix_coo"].withColumn("feature_id", F.col("feature_id") * 1000)
    mapping = mapping.withColumn("feature_id", F.col("feature_id") * 1000)
    assert packing.feature_positions(far, mapping) is None
    found = [rows(pack_selected(counts, cells, far, mapping, ["extract_bin"], fits)) for fits in (True, False)]
    assert found[0] and found[0] == found[1]


def test_bins_are_assembled_without_moving_counts(spark, warehouse):
    path = scratch_path(spark, "extract")
    spec = ExtractSpec(bin_size=7, seed=3, filters={"tissue__in": ["t0", "t1"]}, obs_columns=["tissue"], partition_size=2)
    wanted = number_features(spark, [("a", "E3"), ("b", "E5"), ("c", "E0")])
    prepare_extract(read_tables(spark, warehouse), wanted, path, spec)
    buckets = spark.read.json(f"{path}/layout").first()["buckets"]
    assert buckets == 6 and len(read_binned(spark, f"{path}/count_matrix").inputFiles()) == 6
    cells = read_bucketed(spark, f"{path}/cell_info", read_binned(spark, f"{path}/cell_info").schema, buckets)
    packed = read_bucketed(spark, f"{path}/count_matrix", PACKED_COUNTS, buckets)
    with setting(spark, *BUCKETS_SUFFICE):
        text = plan(assemble(cells, packed, 3).sortWithinPartitions("extract_bin", "row_num"))
    assert "Exchange" not in text and text.count("Sort [") == 2 and "array_sort" not in text  # one sort a side

    blocks = extract_bins(spark, path, f"{path}/out", partition_size=2)
    assert blocks.count() == cells.count() == 80
    want = cells.join(packed, ["extract_bin", "row_num"], "left").select("id", F.coalesce(F.size("feature_data"), F.lit(0)).alias("n"))
    assert rows(blocks.select("id", F.size("indices"))) == [(i, max(n, 0)) for i, n in rows(want)]
    assert len(blocks.inputFiles()) == blocks.select("extract_bin").distinct().count()
