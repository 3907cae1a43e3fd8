"""Scans, sources, sinks and table layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from binwright.operators.joins import local_index
from binwright.operators.quality import file_sizes
from binwright.operators.ranks import random_bins
from binwright.plans.prepare import ExtractSpec, extract_metadata
from binwright.schemas import CELL_INFO, EXTRACT_FEATURE_INFO, FEATURE_INFO, conform
from binwright.session import scratch_path
from binwright.sources.base import append_ingests, read_staged_counts, read_table, scan
from binwright.sources.sinks import (
    export_csv,
    read_binned,
    read_metadata,
    write_binned,
    write_bins,
    write_features,
    write_metadata,
)
from binwright.workload.registry import query


def base_tables(t) -> dict:
    """The star tables in the declared form of the four base tables."""
    ingests = t.ingests.select("id", F.to_json(F.struct("name")).alias("metadata_extra"))
    cells = t.cells.drop("score").withColumn("metadata_extra", F.to_json(F.struct(F.col("disease").alias("d"))))
    features = t.features.drop("size").withColumns({
        "ingest_id": F.lit(0).cast("bigint"), "metadata_extra": F.lit("{}"), "reference": F.lit("ref"),
    })
    return {"ingest_info": ingests, "cell_info": cells, "feature_info": features, "raw_matrix_coo": t.counts}


@query("A1_typed_scan", """
SELECT id, original_id, ingest_id, cell_type, tissue, assay::VARCHAR AS assay
FROM (SELECT *, NULL AS assay FROM cells)""", ("cells",))
def typed_scan(t):
    path = scratch_path(t.spark, "cell_info")
    conform(base_tables(t)["cell_info"], CELL_INFO).write.parquet(path)
    return scan(t.spark, path, CELL_INFO).select("id", "original_id", "ingest_id", "cell_type", "tissue", "assay")


@query("A2_schema_conformance", """
SELECT id, ensemble_id, symbol, NULL::VARCHAR AS tag, 0::BIGINT AS ingest_id, '{}' AS metadata_extra, biotype,
       NULL::BOOLEAN AS is_filtered, 'ref' AS reference FROM features""", ("features",))
def schema_conformance(t):
    return conform(base_tables(t)["feature_info"], FEATURE_INFO)


@query("A3_staged_load", "SELECT cell_id, feature_id, raw_count FROM counts", ("counts",))
def staged_load(t):
    stage = scratch_path(t.spark, "stage")
    t.counts.write.csv(f"{stage}/raw-counts-000000.csv")
    return read_staged_counts(t.spark, stage)


@query("A4_atomic_append", """
SELECT ingest_id, count(DISTINCT id) AS n_cells, count(cell_id) AS n_counts, coalesce(sum(raw_count), 0)::BIGINT AS total
FROM cells LEFT JOIN counts ON cell_id = id GROUP BY ingest_id""", ("cells", "counts"))
def atomic_append(t):
    warehouse = scratch_path(t.spark, "warehouse")
    tables = base_tables(t)
    owner = tables["cell_info"].select(F.col("id").alias("cell_id"), "ingest_id")
    counts = tables["raw_matrix_coo"].join(owner, "cell_id")
    first = {
        "ingest_info": tables["ingest_info"].filter("id < 10"), "feature_info": tables["feature_info"],
        "cell_info": tables["cell_info"].filter("ingest_id < 10"), "raw_matrix_coo": counts.filter("ingest_id < 10"),
    }
    append_ingests(t.spark, warehouse, first)
    append_ingests(t.spark, warehouse, {**tables, "raw_matrix_coo": counts})
    cells = read_table(t.spark, warehouse, "cell_info").select("id", "ingest_id")
    per_cell = read_table(t.spark, warehouse, "raw_matrix_coo").groupBy(F.col("cell_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("raw_count").alias("s")
    )
    return cells.join(per_cell, "id", "left").groupBy("ingest_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_counts"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("total"),
    )


@query("A5_binned_sink", """
SELECT extract_bin, least(extract_bin // 3, 5) AS bin_bucket, count(*) AS n_cells, sum(id)::BIGINT AS id_sum
FROM random_binned GROUP BY ALL""", ("random_binned",))
def binned_sink(t):
    path = scratch_path(t.spark, "binned")
    write_binned(random_bins(t.cells, 1000, seed=7), path, partition_bins=15, partition_size=3, then=("shuffle_key",))
    return read_binned(t.spark, path).groupBy("extract_bin", F.col("bin_bucket").cast("bigint").alias("bin_bucket")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("id").alias("id_sum")
    )


@query("A6_feature_list_load", "SELECT id, symbol, ensemble_id FROM wanted_features", ("wanted_features",))
def feature_list_load(t):
    path = scratch_path(t.spark, "features")
    write_features(t.wanted_features, path)
    return scan(t.spark, path, EXTRACT_FEATURE_INFO)


@query("A7_one_output_per_bin", """
SELECT extract_bin, row_number() OVER (PARTITION BY extract_bin ORDER BY shuffle_key, id) - 1 AS row_num, id
FROM random_binned""", ("random_binned",))
def one_output_per_bin(t):
    path = scratch_path(t.spark, "bins")
    write_bins(local_index(random_bins(t.cells, 1000, seed=7), order=["shuffle_key", "id"]), path)
    return t.spark.read.parquet(path).select(F.col("extract_bin").cast("bigint").alias("extract_bin"), "row_num", "id")


@query("A8_extract_metadata", """
SELECT total_bins, last_bin_size, total_cells, 1000::BIGINT AS extract_bin_size, column_name, value
FROM (SELECT count(DISTINCT extract_bin) AS total_bins, count(*) AS total_cells,
             count(*) FILTER (extract_bin = (SELECT max(extract_bin) FROM random_binned)) AS last_bin_size
      FROM random_binned),
     (SELECT DISTINCT 'cell_type' AS column_name, cell_type AS value FROM cells
      UNION ALL SELECT DISTINCT 'tissue', tissue FROM cells
      UNION ALL SELECT DISTINCT 'disease', disease FROM cells)""", ("random_binned", "cells"))
def metadata_document(t):
    path = scratch_path(t.spark, "metadata")
    spec = ExtractSpec(bin_size=1000, seed=7, category_limit=20, obs_columns=["cell_type", "tissue", "disease"])
    binned = random_bins(t.cells.select("id", *spec.obs_columns), spec.bin_size, spec.seed)
    write_metadata(extract_metadata(binned, spec), path)
    lists = F.explode("category_metadata").alias("column_name", "values")
    exploded = read_metadata(t.spark, path).select(
        "total_bins", "last_bin_size", "total_cells", "extract_bin_size", lists
    )
    return exploded.select(*exploded.columns[:5], F.explode("values").alias("value"))


@query("A9_file_size_gate", """
SELECT 'bucket=' || (cell_id % 20)::VARCHAR AS file, sum(length(line) + 1)::BIGINT AS n_bytes, sum(length(line) + 1) <= 40000 AS is_valid
FROM (SELECT cell_id, cell_id::VARCHAR || ',' || feature_id::VARCHAR || ',' || raw_count::VARCHAR AS line FROM counts)
GROUP BY cell_id % 20""", ("counts",))
def file_size_gate(t):
    path = scratch_path(t.spark, "files")
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("cell_id", "feature_id", "raw_count")])
    lines = t.counts.select(line.alias("value"), (F.col("cell_id") % 20).alias("bucket"))
    lines.repartition("bucket").write.partitionBy("bucket").text(path)
    sizes = file_sizes(t.spark, f"{path}/*/part-*", limit=40_000)
    return sizes.withColumn("file", F.regexp_extract("file", "bucket=[0-9]+", 0))


@query("A10_report_export", "SELECT id::VARCHAR AS id, cell_type, tissue FROM cells", ("cells",))
def report_export(t):
    path = scratch_path(t.spark, "report")
    export_csv(t.cells.select("id", "cell_type", "tissue", "score", "donor_id"), path, exclude=["score", "donor_id"])
    return t.spark.read.option("header", True).csv(path)
