"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from binwright.operators.explore import filter_catalogue
from binwright.operators.filters import in_id_range, where
from binwright.operators.projection import (
    keep_existing,
    keep_existing_or_all,
    map_columns,
    ordered_feature_subset,
    read_bins,
    select_cell_columns,
)
from binwright.operators.ranks import random_bins
from binwright.session import scratch_path
from binwright.sources.sinks import read_binned, write_binned
from binwright.workload.registry import query

_NULLS = ("cells_with_nulls",)


def _filter_query(name, filters, condition):
    @query(name, f"SELECT id, cell_type, tissue, score FROM cells_with_nulls WHERE {condition}", _NULLS)
    def run(t):
        return where(t.cells_with_nulls, filters).select("id", "cell_type", "tissue", "score")


_filter_query("B1_filter_eq", {"tissue__eq": "BUILDING"}, "tissue = 'BUILDING'")
_filter_query("B2_filter_not_eq", {"tissue__not_eq": "BUILDING"}, "tissue <> 'BUILDING'")
_filter_query("B3_filter_in", {"cell_type__in": ["1-URGENT", "2-HIGH"]}, "cell_type IN ('1-URGENT', '2-HIGH')")
_filter_query("B4_filter_not_in", {"cell_type__not_in": ["1-URGENT", "2-HIGH"]},
              "cell_type NOT IN ('1-URGENT', '2-HIGH')")
_filter_query("B5_filter_gt", {"score__gt": 250000.5}, "score > 250000.5")
_filter_query("B6_filter_gte", {"id__gte": 700}, "id >= 700")
_filter_query("B7_filter_lt", {"score__lt": 100000}, "score < 100000")
_filter_query("B8_filter_lte", {"id__lte": 701}, "id <= 701")
_filter_query(
    "B9_filter_map",
    {"c.cell_type__eq": ["1-URGENT", "5-LOW"], "tissue__not_eq": ["BUILDING"], "score__gte": 50000, "disease": "F"},
    "cell_type IN ('1-URGENT', '5-LOW') AND tissue <> 'BUILDING' AND score >= 50000 AND disease = 'F'",
)


@query("B3_filter_in_long_list", "SELECT id, cell_type FROM cells WHERE id % 3 = 0 AND id < 30000", ("cells",))
def filter_in_long_list(t):
    return where(t.cells, {"id__in": list(range(0, 30_000, 3))}).select("id", "cell_type")


@query("B4_filter_not_in_long_list", "SELECT id, cell_type FROM cells WHERE NOT (id % 3 = 0 AND id < 30000)", ("cells",))
def filter_not_in_long_list(t):
    return where(t.cells, {"id__not_in": list(range(0, 30_000, 3))}).select("id", "cell_type")


@query("B13_projection", "SELECT id, ingest_id, tissue, cell_type FROM cells", ("cells",))
def projection(t):
    return select_cell_columns(t.cells, ["c.tissue", "cell_type", "c.tissue"])


@query("B14_bin_range_read", "SELECT extract_bin, id, tissue FROM random_binned WHERE extract_bin BETWEEN 4 AND 13",
       ("random_binned",))
def bin_range_read(t):
    path = scratch_path(t.spark, "binned")
    write_binned(random_bins(t.cells, 1000, seed=7), path, partition_size=2)
    return read_bins(read_binned(t.spark, path), 4, 13, ["extract_bin", "id", "tissue"], partition_size=2)


@query("B15_tolerant_pruning", "SELECT id, tissue, disease FROM cells", ("cells",))
def tolerant_pruning(t):
    return keep_existing(t.cells, ["tissue", "no_such_column", "id", "disease"])


@query("B15_tolerant_pruning_features", "SELECT id, ensemble_id, symbol, biotype, size FROM features", ("features",))
def tolerant_pruning_features(t):
    return keep_existing_or_all(t.features, ["no_such_column"])


@query("B16_ordered_feature_subset", """
SELECT p.position, p.value, max(f.id) AS id
FROM (SELECT * FROM (VALUES (0, 'red widget'), (1, 'no such part'), (2, 'blue bolt'), (3, 'small ring')) v(position, value)) p
JOIN features f ON f.symbol = p.value GROUP BY p.position, p.value""", ("features",))
def feature_subset(t):
    return ordered_feature_subset(t.features, "symbol", ["red widget", "no such part", "blue bolt", "small ring"])


@query("B17_column_mapping", "SELECT original_id AS obs_id, original_id AS label, cell_type AS kind, tissue FROM cells",
       ("cells",))
def column_mapping(t):
    source = t.cells.select(F.col("original_id").alias("obs_id"), "cell_type", "tissue")
    return map_columns(source, {"index": "label", "cell_type": "kind"}, "obs_id")


@query("B18_filter_catalogue", """
SELECT column_name, label, field_type, operators, suggest FROM (VALUES
  ('id', 'Id', 'number', 'eq,gt,gte,lt,lte', 99999), ('ingest_id', 'Ingest Id', 'number', 'eq,gt,gte,lt,lte', 99999),
  ('score', 'Score', 'number', 'eq,gt,gte,lt,lte', 99999)) v(column_name, label, field_type, operators, n),
  (SELECT false AS suggest)
UNION ALL
SELECT column_name, label, 'string', CASE WHEN n <= 200 THEN 'in,not_in' ELSE 'eq,not_eq,in,not_in' END, n <= 200
FROM (SELECT 'original_id' AS column_name, 'Original Id' AS label, count(DISTINCT original_id) AS n FROM cells
      UNION ALL SELECT 'donor_id', 'Donor Id', count(DISTINCT donor_id) FROM cells
      UNION ALL SELECT 'cell_type', 'Cell Type', count(DISTINCT cell_type) FROM cells
      UNION ALL SELECT 'disease', 'Disease', count(DISTINCT disease) FROM cells
      UNION ALL SELECT 'tissue', 'Tissue', count(DISTINCT tissue) FROM cells)""", ("cells",))
def catalogue(t):
    return filter_catalogue(t.cells, threshold=200).withColumn("operators", F.array_join("operators", ","))


@query("B19_id_range_read", """
SELECT id, tissue, score FROM cells WHERE id BETWEEN 100 AND 9000 AND tissue = 'BUILDING' AND score > 90000""", ("cells",))
def id_range_read(t):
    found = in_id_range(t.cells, 100, 9000, {"score__gt": 90000}, group={"tissue": "BUILDING"})
    return found.select("id", "tissue", "score")
