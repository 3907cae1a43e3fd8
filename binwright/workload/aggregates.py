"""Aggregations and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from binwright.operators.aggregates import (
    cell_count_of,
    extract_summary,
    group_bin_statistics,
    with_cell_totals,
)
from binwright.operators.bins import chunks_in_groups
from binwright.operators.explore import (
    categorical_columns,
    category_lists,
    count_cells,
    distinct_count,
    distinct_counts,
    distinct_values,
)
from binwright.operators.ranks import random_bins
from binwright.plans.facets import refresh_facets, refresh_warehouse_facets
from binwright.plans.prepare import count_matrix
from binwright.session import scratch_path
from binwright.sources.base import append_ingests
from binwright.workload.registry import query
from binwright.workload.tables import base_tables


@query("C1_filtered_count", "SELECT count(*) AS total_cells FROM cells WHERE tissue = 'BUILDING' AND score >= 100000",
       ("cells",))
def filtered_count(t):
    return count_cells(t.cells, {"tissue__eq": "BUILDING", "score__gte": 100000})


@query("C2_distinct_count", "SELECT count(DISTINCT tissue) AS distinct_count FROM cells_with_nulls", ("cells_with_nulls",))
def one_distinct_count(t):
    return distinct_count(t.cells_with_nulls, "tissue")


@query("C3_distinct_counts", """
SELECT count(DISTINCT tissue) AS distinct_tissue, count(DISTINCT cell_type) AS distinct_cell_type,
       count(DISTINCT donor_id) AS distinct_donor_id, count(DISTINCT ingest_id) AS distinct_ingest_id
FROM cells_with_nulls""", ("cells_with_nulls",))
def many_distinct_counts(t):
    return distinct_counts(t.cells_with_nulls, ["tissue", "cell_type", "donor_id", "ingest_id"])


@query("C4_distinct_values", "SELECT DISTINCT donor_id AS value FROM cells WHERE donor_id IS NOT NULL ORDER BY 1", ("cells",))
def sorted_distinct_values(t):
    return distinct_values(t.cells, "donor_id")


@query("C5_categorical_columns", """
SELECT column_name, n AS n_distinct FROM (
  SELECT 'donor_id' AS column_name, count(DISTINCT donor_id) AS n FROM cells_with_nulls
  UNION ALL SELECT 'cell_type', count(DISTINCT cell_type) FROM cells_with_nulls
  UNION ALL SELECT 'disease', count(DISTINCT disease) FROM cells_with_nulls
  UNION ALL SELECT 'tissue', count(DISTINCT tissue) FROM cells_with_nulls) WHERE n <= 200""", ("cells_with_nulls",))
def categorical(t):
    return categorical_columns(t.cells_with_nulls, threshold=200, exclude=["original_id"])


@query("C6_category_lists", """
SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS position FROM (
  SELECT DISTINCT 'cell_type' AS column_name, cell_type AS value FROM cells_with_nulls WHERE cell_type IS NOT NULL
  UNION ALL SELECT DISTINCT 'disease', disease FROM cells_with_nulls WHERE disease IS NOT NULL
  UNION ALL SELECT DISTINCT 'tissue', tissue FROM cells_with_nulls WHERE tissue IS NOT NULL)""", ("cells_with_nulls",))
def category_values_listed(t):
    lists = category_lists(t.cells_with_nulls, limit=50)
    exploded = lists.select("column_name", F.posexplode("categories").alias("position", "value"))
    return exploded.withColumn("position", F.col("position").cast("bigint"))


@query("C7_extract_summary", """
SELECT total_bins, last_bin_size, total_cells, total_cells AS cell_count FROM (
  SELECT count(DISTINCT extract_bin) AS total_bins, count(*) AS total_cells,
         count(*) FILTER (extract_bin = (SELECT max(extract_bin) FROM random_binned)) AS last_bin_size
  FROM random_binned)""", ("random_binned",))
def summary(t):
    return cell_count_of(extract_summary(random_bins(t.cells, 1000, seed=7)), 1000)


@query("C8_cell_totals", """
SELECT id, coalesce(sum(raw_count), 0)::BIGINT AS total_mrna_umis FROM cells LEFT JOIN counts ON cell_id = id GROUP BY id""",
       ("cells", "counts"))
def cell_sums(t):
    return with_cell_totals(t.cells.select("id"), t.counts)


@query("C9_packed_counts", """
SELECT extract_bin, cell_id, string_agg(feature_id::VARCHAR || ':' || raw_count::VARCHAR, ' ' ORDER BY feature_id) AS entries
FROM packed GROUP BY ALL""", ("packed",))
def packed_counts(t):
    binned = random_bins(t.cells, 1000, seed=7)
    rows = count_matrix(t.counts, t.features, t.wanted_features, binned)
    text = F.transform("feature_data", lambda e: F.concat(e["feature_id"].cast("string"), F.lit(":"), e["raw_counts"].cast("string")))
    return rows.select("extract_bin", "cell_id", F.array_join(text, " ").alias("entries"))


@query("C10_group_bin_statistics", """
SELECT tissue, chunk, min(id) AS id_min, max(id) AS id_max, count(*) AS cell_count
FROM (SELECT *, (row_number() OVER (PARTITION BY tissue ORDER BY id) - 1) // 300 AS chunk FROM cells)
GROUP BY ALL""", ("cells",))
def group_statistics(t):
    return group_bin_statistics(chunks_in_groups(t.cells.select("id", "tissue"), ["tissue"], 300), ["tissue"])


@query("J12_facets", """
SELECT 'orders' AS dataset, 'total_cells' AS facet, NULL::VARCHAR AS value, count(*) AS n FROM cells
UNION ALL SELECT DISTINCT 'orders', 'cell_type', cell_type, 1 FROM cells
UNION ALL SELECT DISTINCT 'orders', 'disease', disease, 1 FROM cells
UNION ALL SELECT DISTINCT 'orders', 'tissue', tissue, 1 FROM cells
UNION ALL SELECT 'events', 'total_cells', NULL, count(*) FROM event_cells
UNION ALL SELECT DISTINCT 'events', 'cell_type', cell_type, 1 FROM event_cells
UNION ALL SELECT DISTINCT 'events', 'donor_id', donor_id, 1 FROM event_cells
  WHERE (SELECT count(DISTINCT donor_id) FROM event_cells) <= 40""", ("cells", "event_cells"))
def facets(t):
    rows = refresh_facets(
        {"orders": t.cells.drop("original_id"), "events": t.event_cells}, scratch_path(t.spark, "facets"), threshold=40
    )
    return rows.select("dataset", "facet", "value", "n")


@query("J12_facets_after_appends", """
SELECT 'orders' AS dataset, 'total_cells' AS facet, NULL::VARCHAR AS value, count(*) AS n FROM cells
UNION ALL SELECT DISTINCT 'orders', 'cell_type', cell_type, 1 FROM cells
UNION ALL SELECT DISTINCT 'orders', 'disease', disease, 1 FROM cells
UNION ALL SELECT DISTINCT 'orders', 'tissue', tissue, 1 FROM cells""", ("cells",))
def facets_after_appends(t):
    """Two appends with a refresh after each: the second reads the new ingests only."""
    warehouse, path, tables = scratch_path(t.spark, "warehouse"), scratch_path(t.spark, "facets"), base_tables(t)
    rows = None
    for part in (F.col("ingest_id") < 15, F.col("ingest_id") >= 15):
        append_ingests(t.spark, warehouse, {
            "ingest_info": tables["ingest_info"].withColumn("ingest_id", F.col("id")).filter(part).drop("ingest_id"),
            "cell_info": tables["cell_info"].filter(part), "feature_info": tables["feature_info"].limit(0),
            "raw_matrix_coo": t.spark.createDataFrame([], "cell_id long, feature_id long, raw_count long, ingest_id long"),
        })
        rows = refresh_warehouse_facets(t.spark, warehouse, path, "orders", threshold=40)
    return rows
