"""Joins of cells, ingests, features and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from binwright.operators.joins import (
    align_features,
    cells_with_ingest,
    counts_of_cells,
    expand_to_axis,
    feature_axis,
    feature_map,
    feature_set_faults,
    local_index,
    positions_to_ids,
    remap_features,
    row_and_column_numbers,
    unknown_ids,
)
from binwright.operators.ranks import random_bins, rank_by_value
from binwright.workload.registry import query


@query("D1_cells_with_ingest", "SELECT id, ingest_id, tissue FROM cells WHERE ingest_id IN (SELECT id FROM ingests WHERE id % 3 <> 0)",
       ("cells", "ingests"))
def known_ingests(t):
    return cells_with_ingest(t.cells, t.ingests.filter("id % 3 <> 0")).select("id", "ingest_id", "tissue")


@query("D2_feature_remap", """
SELECT c.cell_id, w.id AS feature_id, c.raw_count FROM counts c JOIN features f ON c.feature_id = f.id
JOIN wanted_features w ON f.ensemble_id = w.ensemble_id""", ("counts", "features", "wanted_features"))
def remapped(t):
    return remap_features(t.counts, feature_map(t.features, t.wanted_features))


@query("D3_counts_of_cells", """
SELECT c.cell_id, c.feature_id, c.raw_count, b.extract_bin FROM counts c JOIN random_binned b ON c.cell_id = b.id
WHERE b.tissue = 'BUILDING'""", ("counts", "random_binned"))
def selected_counts(t):
    binned = random_bins(t.cells, 1000, seed=7).filter("tissue = 'BUILDING'")
    return counts_of_cells(t.counts, binned)


def _numbered(t):
    rows = rank_by_value(t.cells.select("id"), "id", "_r").select(
        F.col("id").alias("cell_id"), (F.col("_r") - 1).alias("row_num")
    )
    columns = feature_axis(t.features.select("id")).select(F.col("id").alias("feature_id"), "col_num")
    return rows, columns


@query("D4_row_and_column_numbers", """
SELECT r.row_num, f.col_num, c.raw_count AS value FROM counts c
JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_num FROM cells) r ON c.cell_id = r.id
JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS col_num FROM features) f ON c.feature_id = f.id""",
       ("counts", "cells", "features"))
def numbered(t):
    rows, columns = _numbered(t)
    return row_and_column_numbers(t.counts.withColumnRenamed("raw_count", "value"), rows, columns)


@query("D4_unknown_ids", """
SELECT 'cell' AS kind, count(*) AS n_entries FROM counts WHERE cell_id % 11 = 0
UNION ALL SELECT 'feature', count(*) FROM counts WHERE feature_id % 7 = 0""", ("counts",))
def unknown(t):
    rows, columns = _numbered(t)
    return unknown_ids(t.counts, rows.filter("cell_id % 11 <> 0"), columns.filter("feature_id % 7 <> 0"))


@query("D5_positions_to_ids", """
SELECT o.source_id * 10 AS cell_id, v.source_id * 100 AS feature_id, x.value
FROM file_x x JOIN file_obs o ON x.file = o.file AND x.row_pos = o.row_pos
JOIN file_var v ON x.file = v.file AND x.col_pos = v.col_pos""", ("file_x",))
def looked_up(t):
    batch = t.batch
    obs = batch.obs.select("file", "row_pos", (F.substring_index("obs_id", "_", -1).cast("bigint") * 10).alias("id"))
    var = batch.var.select("file", "col_pos", (F.substring("var_id", 5, 20).cast("bigint") * 100).alias("id"))
    return positions_to_ids(batch.x, obs, var)


@query("D6_local_index", """
SELECT extract_bin, id, row_number() OVER (PARTITION BY extract_bin ORDER BY id) - 1 AS row_num FROM random_binned""",
       ("random_binned",))
def dense_index(t):
    return local_index(random_bins(t.cells.select("id"), 1000, seed=7)).select("extract_bin", "id", "row_num")


def schema_features(t):
    """The declared feature axis: two thirds of the features, positions in id order."""
    kept = t.features.filter("id % 3 <> 0").select("id", F.col("ensemble_id").alias("feature_name"), "symbol", "biotype")
    axis = feature_axis(kept)
    return axis.select("feature_name", F.col("col_num").alias("position"), F.upper("symbol").alias("symbol"), "biotype")


_SCHEMA = """
    (SELECT ensemble_id AS feature_name, row_number() OVER (ORDER BY id) - 1 AS position, upper(symbol) AS symbol, biotype
     FROM features WHERE id % 3 <> 0)"""


@query("D7_feature_alignment", f"""
SELECT v.file, v.col_pos, v.var_id AS feature_name, s.position, s.symbol, s.biotype
FROM file_var v LEFT JOIN {_SCHEMA} s ON v.var_id = s.feature_name""", ("file_var", "features"))
def aligned(t):
    return align_features(t.batch.var.withColumnRenamed("var_id", "feature_name"), schema_features(t))


@query("D8_feature_set_faults", f"""
SELECT file, fault, count(*) AS n_features, array_to_string((list(name ORDER BY name))[1:5], ',') AS examples
FROM (SELECT v.file, 'unknown' AS fault, v.var_id AS name FROM file_var v
      WHERE v.var_id NOT IN (SELECT feature_name FROM {_SCHEMA})
      UNION ALL
      SELECT f.file, 'missing', s.feature_name FROM (SELECT DISTINCT file FROM file_var) f, {_SCHEMA} s
      WHERE NOT EXISTS (SELECT 1 FROM file_var v WHERE v.file = f.file AND v.var_id = s.feature_name))
GROUP BY file, fault""", ("file_var", "features"))
def set_faults(t):
    names = t.batch.var.withColumnRenamed("var_id", "feature_name")
    faults = feature_set_faults(names, schema_features(t), is_subset=False)
    return faults.withColumn("examples", F.array_join("examples", ","))


@query("D8_label_type", f"""
SELECT file, 'not text' AS fault, count(DISTINCT col_pos) AS n_features, 'bigint' AS examples FROM file_var GROUP BY file
UNION ALL
SELECT file, 'unknown', count(DISTINCT col_pos), array_to_string((list(DISTINCT CAST(col_pos AS VARCHAR) ORDER BY CAST(col_pos AS VARCHAR)))[1:5], ',')
FROM file_var GROUP BY file""", ("file_var",))
def label_types(t):
    labels = t.batch.var.select("file", F.col("col_pos").cast("bigint").alias("feature_name"))
    faults = feature_set_faults(labels, schema_features(t))
    return faults.withColumn("examples", F.array_join("examples", ","))


@query("D9_feature_axis_expansion", f"""
SELECT x.file, x.row_pos, s.position AS col_pos, x.value FROM file_x x
JOIN file_var v ON x.file = v.file AND x.col_pos = v.col_pos JOIN {_SCHEMA} s ON v.var_id = s.feature_name""",
       ("file_x", "features"))
def expanded(t):
    batch = t.batch
    return expand_to_axis(batch.x, batch.var.withColumnRenamed("var_id", "feature_name"), schema_features(t))
