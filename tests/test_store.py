"""Writers that overlap, repeat, correct, fail or work at the same time."""

import os
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from binwright.errors import DataValidationError
from binwright.operators.ranks import rank_by_value
from binwright.plans.ingest import (
    Batch,
    ingest_batch,
    ingest_partition,
    partition_files,
    plan_partitions,
    read_files,
    read_store,
    register_batch,
)
from binwright.session import scratch_path
from binwright.sources import base
from binwright.sources.base import append_ingests, read_table, vacuum
from binwright.sources.reserve import publish, reserve
from tests.conftest import rows
from tests.test_ingest import MAPS, array_inputs, small_batch


def run_plan(spark, store, schema, batch, batch_size):
    names = batch.obs.select("file").distinct().withColumn("n", F.substring("file", 2, 9).cast("bigint"))
    files = rank_by_value(names, "n", "_rank").select("file", (F.col("_rank") - 1).alias("position"))
    total = files.count()
    planned, totals = plan_partitions(files, total, batch_size)
    for index in range(totals["num_partitions"]):
        ingest_partition(spark, store, batch.only(partition_files(planned, total, index, batch_size)), schema, index)


def named(batch, *files):
    return batch.only(batch.obs.select("file").distinct().filter(F.col("file").isin(*files)))


def test_overlapping_plans_store_each_cell_once(spark):
    schema, batch = array_inputs(spark)
    store = scratch_path(spark, "store")
    register_batch(spark, store, batch)
    run_plan(spark, store, schema, named(batch, "f1"), 1)
    run_plan(spark, store, schema, named(batch, "f1", "f2"), 2)  # f1 again, in another partition of another plan
    stored = read_store(spark, store, schema)
    assert stored["obs"].count() == stored["obs"].select("id").distinct().count() == 250
    assert read_files(spark, store).count() == 2
    assert stored["X"].count() == stored["X"].select("cell_id", "feature_id").distinct().count() == named(batch, "f1", "f2").x.count()


def test_a_partition_reads_its_files_once(spark):
    schema, batch = array_inputs(spark)
    batch = named(batch, "f1", "f2")
    store, made = scratch_path(spark, "store"), spark.sparkContext.accumulator(0)
    register_batch(spark, store, batch)

    def read(value):
        made.add(1)
        return value

    once = F.udf(read, "double").asNondeterministic()
    x = batch.x.withColumn("value", once(F.col("value").cast("double")))
    untyped = batch.obs.withColumn("nothing", F.lit(None))  # no column that Parquet could hold
    ingest_partition(spark, store, Batch(untyped, batch.var, x), schema)
    n = batch.x.count()
    assert made.value == n == read_store(spark, store, schema)["X"].count()


def test_other_content_replaces_and_older_content_comes_back(spark):
    schema, batch = array_inputs(spark)
    store = scratch_path(spark, "store")
    register_batch(spark, store, batch)
    first = named(batch, "f1", "f2")
    ingest_partition(spark, store, first, schema)
    changed = Batch(first.obs.withColumn("tissue", F.when(F.col("file") == "f1", F.lit("lung")).otherwise(F.col("tissue"))), first.var,
                    first.x.withColumn("value", F.when(F.col("file") == "f1", F.col("value") + 1).otherwise(F.col("value"))))
    assert ingest_partition(spark, store, changed, schema, 7).select("file").collect() == [("f1",)]
    stored, want = read_store(spark, store, schema), changed.x.agg(F.sum("value")).first()[0]
    assert stored["X"].agg(F.sum("value")).first()[0] == want and stored["obs"].count() == 250
    assert rows(stored["obs"].groupBy("tissue").count()) == [("lung", 100), ("unknown", 150)]

    assert ingest_partition(spark, store, first, schema).count() == 1  # the first content of f1 as its third version
    stored = read_store(spark, store, schema)
    assert stored["X"].agg(F.sum("value")).first()[0] == first.x.agg(F.sum("value")).first()[0]
    assert rows(stored["obs"].groupBy("tissue").count()) == [("liver", 100), ("unknown", 150)]
    assert rows(read_files(spark, store), "file", "version") == [("f1", 0), ("f1", 1), ("f1", 2), ("f2", 0)]


def test_a_cell_has_the_rows_of_the_file_that_came_last(spark):
    schema, batch = array_inputs(spark)
    store = scratch_path(spark, "store")
    register_batch(spark, store, batch)
    f2, few = named(batch, "f2"), F.col("row_pos") < 40
    # A file with 40 cells of f2, and one with 30 of them, in one batch: that with the later name wins; both beat f2.
    def part(name, n):
        out = [df.filter(F.col("row_pos") < n).withColumn("file", F.lit(name)) for df in (f2.obs, f2.x)]
        return Batch(out[0].withColumn("cell_type", F.lit(name)), f2.var.withColumn("file", F.lit(name)), out[1].withColumn("value", F.lit(float(n))))

    a, b = part("g1", 40), part("g2", 30)
    both = Batch(a.obs.unionByName(b.obs), a.var.unionByName(b.var), a.x.unionByName(b.x))
    ingest_partition(spark, store, f2, schema)
    ingest_partition(spark, store, both, schema)
    stored = read_store(spark, store, schema)
    assert stored["obs"].count() == 150 and stored["X"].count() == f2.x.count()
    kinds = {r["cell_type"]: r["count"] for r in stored["obs"].groupBy("cell_type").count().collect()}
    assert (kinds["g1"], kinds["g2"]) == (10, 30)
    assert {(r["value"], r["count"]) for r in stored["X"].groupBy("value").count().collect()} >= {(40.0, 50), (30.0, 150)}
    assert f2.x.filter(few).count() == 200


def test_a_failed_version_is_written_again(spark, monkeypatch):
    schema, batch = array_inputs(spark)
    store = scratch_path(spark, "store")
    register_batch(spark, store, batch)
    write = base._write

    def failing(df, path, schema, sort_column, **how):
        write(df, path, schema, sort_column, **how)
        if path.endswith("/X"):
            raise RuntimeError("disk lost")

    monkeypatch.setattr(base, "_write", failing)
    with pytest.raises(RuntimeError):
        ingest_partition(spark, store, named(batch, "f1"), schema)
    assert read_files(spark, store).count() == 0
    monkeypatch.undo()
    ingest_partition(spark, store, named(batch, "f1"), schema)
    stored = read_store(spark, store, schema)
    assert stored["obs"].count() == 100 and stored["X"].count() == 500


def test_matrix_moves_only_to_be_written(spark, monkeypatch):
    schema, batch = array_inputs(spark)
    store = scratch_path(spark, "store")
    register_batch(spark, store, batch)
    plans, write = {}, base._write

    def seen(df, path, schema, sort_column, **how):
        plans[path.rsplit("/", 1)[1]] = df._jdf.queryExecution().executedPlan().toString()
        write(df, path, schema, sort_column, **how)

    monkeypatch.setattr(base, "_write", seen)
    ingest_partition(spark, store, batch, schema)
    text = plans["X"]
    assert "BroadcastHashJoin [file" in text and "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text


def test_counts_are_checked_by_the_exchange_that_writes_them(spark, monkeypatch):
    warehouse, plans, write = scratch_path(spark, "wh"), {}, base._write

    def seen(df, path, schema, sort_column, **how):
        plans[path.rsplit("/", 1)[1]] = df._jdf.queryExecution().executedPlan().toString()
        write(df, path, schema, sort_column, **how)

    monkeypatch.setattr(base, "_write", seen)
    ingest_batch(spark, warehouse, small_batch(spark, "a"), *MAPS)
    text = plans["raw_matrix_coo"]
    assert len(re.findall(r"(?<!Broadcast)Exchange ", text)) == 1 and text.count("Sort [") == 1 and "Window" in text
    monkeypatch.undo()
    twice = small_batch(spark, "b")
    twice = Batch(twice.obs, twice.var, twice.x.unionByName(twice.x.limit(1)), twice.uns)
    with pytest.raises(DataValidationError):
        ingest_batch(spark, warehouse, twice, *MAPS)
    assert read_table(spark, warehouse, "cell_info").count() == 4


def test_writers_at_the_same_time_get_blocks_apart(spark):
    warehouse, got, errors = scratch_path(spark, "wh"), [], []
    start = threading.Barrier(8)

    def work(n):
        try:
            start.wait()
            for k in range(6):
                sizes = {"cell_info": 10 * n + k, "feature_info": n + 1}
                got.append((sizes, reserve(spark, warehouse, sizes, lambda: {"cell_info": 100, "feature_info": 0})))
        except Exception as e:  # reported below
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and len(got) == 48
    for counter, first in (("cell_info", 100), ("feature_info", 0)):
        at = first
        for begin, n in sorted((at_[counter], sizes[counter]) for sizes, at_ in got if sizes[counter]):
            assert begin == at  # neither a gap nor an overlap
            at += n
    assert sorted(os.listdir(f"{warehouse}/reserved")) == [f"block-{i:012d}" for i in range(48)]


def test_published_files_are_never_replaced(spark):
    path = f"{scratch_path(spark, 'published')}/one"
    assert publish(spark, path, "first") and not publish(spark, path, "second")
    assert spark.read.text(path).first()[0] == "first"
    with pytest.raises(ValueError):
        reserve(spark, path, {"cell_info": -1}, dict)


def test_ids_continue_after_rows_without_reservations(spark):
    warehouse = scratch_path(spark, "wh")
    ingest_batch(spark, warehouse, small_batch(spark, "a"), *MAPS)
    assert reserve(spark, warehouse, {"cell_info": 2, "other": 3}, dict) == {"cell_info": 4, "other": 0}
    ingest_batch(spark, warehouse, small_batch(spark, "b"), *MAPS)
    assert rows(read_table(spark, warehouse, "cell_info"), "id") == [(i,) for i in (0, 1, 2, 3, 6, 7, 8, 9)]


def test_two_batches_ingested_at_the_same_time(spark):
    warehouse, errors = scratch_path(spark, "wh"), []

    def work(name):
        try:
            ingest_batch(spark, warehouse, small_batch(spark, name), *MAPS)
        except Exception as e:  # reported below
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    cells = read_table(spark, warehouse, "cell_info")
    assert rows(cells, "id") == [(i,) for i in range(12)] and cells.select("ingest_id").distinct().count() == 3
    assert read_table(spark, warehouse, "raw_matrix_coo").count() == 15


def test_vacuum_removes_what_was_never_committed(spark, monkeypatch):
    warehouse, write = scratch_path(spark, "wh"), base._write
    ingest_batch(spark, warehouse, small_batch(spark, "a"), *MAPS)

    def failing(df, path, schema, sort_column, **how):
        if path.endswith("raw_matrix_coo"):
            raise RuntimeError("disk lost")
        write(df, path, schema, sort_column, **how)

    monkeypatch.setattr(base, "_write", failing)
    with pytest.raises(RuntimeError):
        ingest_batch(spark, warehouse, small_batch(spark, "b"), *MAPS)
    monkeypatch.undo()
    assert vacuum(spark, warehouse).count() == 0  # may still be running
    gone = vacuum(spark, warehouse, now=time.time() + 25 * 3600)
    assert rows(gone) == [("cell_info", 1), ("feature_info", 1), ("ingest_info", 1)]
    assert spark.read.parquet(f"{warehouse}/cell_info").count() == 4
    assert read_table(spark, warehouse, "raw_matrix_coo").count() == 5
    assert vacuum(spark, scratch_path(spark, "none")).count() == 0


def test_append_tells_what_it_skipped(spark):
    warehouse = scratch_path(spark, "wh")
    tables = {
        "ingest_info": spark.range(3).select("id", F.lit("{}").alias("metadata_extra")),
        "cell_info": spark.range(3).select("id", F.lit("c").alias("original_id"), F.col("id").alias("ingest_id"), F.lit("{}").alias("metadata_extra")),
        "feature_info": spark.range(3).select("id", F.lit("E").alias("ensemble_id"), F.col("id").alias("ingest_id"), F.lit("{}").alias("metadata_extra"), F.lit("r").alias("reference")),
        "raw_matrix_coo": spark.range(3).select(F.col("id").alias("cell_id"), F.col("id").alias("feature_id"), F.lit(1).alias("raw_count"), F.col("id").alias("ingest_id")),
    }
    few = {t: df.filter("id < 2" if t == "ingest_info" else "ingest_id < 2") for t, df in tables.items()}
    assert append_ingests(spark, warehouse, few).count() == 0
    assert rows(append_ingests(spark, warehouse, tables)) == [(0,), (1,)]
    assert read_table(spark, warehouse, "cell_info").count() == 3
