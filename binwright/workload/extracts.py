"""Prepare and extract jobs: written to the shared folder, read back and returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from binwright.plans.extract import extract_bins, extract_grouped, extract_randomized, union_pieces
from binwright.plans.prepare import ExtractSpec, prepare_extract
from binwright.session import scratch_path
from binwright.sources.sinks import read_binned
from binwright.workload.ranks import SHUFFLED
from binwright.workload.registry import query
from binwright.workload.tables import base_tables


def _flat(blocks, *columns):
    """Blocks with their sparse rows as comparable text: which columns are set, and each value in that order."""
    return blocks.select(
        F.col("extract_bin").cast("bigint").alias("extract_bin"), "row_num", "id", *columns,
        F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"),
        F.array_join(F.transform("values", lambda v: v.cast("bigint").cast("string")), ",").alias("counted"), "n_features",
    )


def _prepared(t, spec):
    path = scratch_path(t.spark, "extract")
    metadata = prepare_extract(base_tables(t), t.wanted_features, path, spec)
    return path, metadata


_RANDOM = ExtractSpec(bin_size=1000, seed=7, obs_columns=["c.tissue", "cell_type", "donor_id"], category_limit=100)
_KEYED = ExtractSpec(
    bin_size=100, seed=7, filters={"c.cell_type__in": ["1-URGENT", "2-HIGH"]}, obs_columns=["tissue"],
    bin_keys=["tissue", "disease"], metadata_columns=["d"],
)
_KEYED_BINS = """
keyed AS (
  SELECT *, dense_rank() OVER (ORDER BY category, chunk) - 1 AS extract_bin FROM (
    SELECT *, (row_number() OVER (PARTITION BY category ORDER BY shuffle_key, id) - 1) // 100 AS chunk FROM (
      SELECT id, tissue, disease, shuffle_key, tissue || '##' || disease AS category FROM random_binned
      WHERE cell_type IN ('1-URGENT', '2-HIGH'))))"""


@query("J3_prepare_extract", """
SELECT b.extract_bin, b.id, count(p.cell_id) AS n_values,
       coalesce(string_agg(p.feature_id::VARCHAR || ':' || p.raw_count::VARCHAR, ' ' ORDER BY p.feature_id), '') AS entries
FROM random_binned b LEFT JOIN packed p ON b.id = p.cell_id GROUP BY ALL""", ("random_binned", "packed"))
def prepared(t):
    path, _ = _prepared(t, _RANDOM)
    cells = read_binned(t.spark, f"{path}/cell_info")
    packed = read_binned(t.spark, f"{path}/count_matrix")
    text = F.transform("feature_data", lambda e: F.concat(e["feature_id"].cast("string"), F.lit(":"), e["raw_counts"].cast("string")))
    counts = packed.select(F.col("cell_id").alias("id"), F.size("feature_data").cast("bigint").alias("n"), F.array_join(text, " ").alias("text"))
    return cells.join(counts, "id", "left").select(
        F.col("extract_bin").cast("bigint").alias("extract_bin"), "id", F.coalesce("n", F.lit(0)).alias("n_values"), F.coalesce("text", F.lit("")).alias("entries")
    )


@query("J3_prepare_extract_keyed", f"""
SELECT * FROM (WITH {_KEYED_BINS} SELECT extract_bin, id, tissue, disease AS d FROM keyed)""", ("random_binned",))
def prepared_keyed(t):
    path, _ = _prepared(t, _KEYED)
    return read_binned(t.spark, f"{path}/cell_info").select("extract_bin", "id", "tissue", "d")


@query("J3_prepare_metadata", f"""
SELECT * FROM (WITH {_KEYED_BINS}
SELECT count(DISTINCT extract_bin) AS total_bins, count(*) FILTER (extract_bin = (SELECT max(extract_bin) FROM keyed)) AS last_bin_size,
       count(*) AS total_cells, 'd,tissue' AS categories,
       (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT tissue AS v FROM keyed)) AS tissues FROM keyed)""",
       ("random_binned",))
def prepared_metadata(t):
    _, metadata = _prepared(t, _KEYED)
    return metadata.select(
        "total_bins", "last_bin_size", "total_cells",
        F.array_join(F.sort_array(F.map_keys("category_metadata")), ",").alias("categories"),
        F.array_join(F.col("category_metadata")["tissue"], ",").alias("tissues"),
    )


_BLOCKS = """
SELECT b.extract_bin, row_number() OVER (PARTITION BY b.extract_bin ORDER BY b.shuffle_key, b.id) - 1 AS row_num, b.id,
       b.tissue, b.tissue_code, b.donor_id, coalesce(p.indices, '') AS indices, coalesce(p.counted, '') AS counted,
       (SELECT count(*) FROM wanted_features) AS n_features
FROM (SELECT *, (dense_rank() OVER (ORDER BY tissue) - 1)::INTEGER AS tissue_code FROM random_binned) b
LEFT JOIN (SELECT cell_id, string_agg(feature_id::VARCHAR, ',' ORDER BY feature_id) AS indices,
                  string_agg(raw_count::VARCHAR, ',' ORDER BY feature_id) AS counted
           FROM packed GROUP BY cell_id) p ON p.cell_id = b.id"""


@query("J4_extract_bins", f"SELECT * FROM ({_BLOCKS})", ("random_binned", "packed", "wanted_features"))
def extracted(t):
    path, _ = _prepared(t, _RANDOM)
    blocks = extract_bins(t.spark, path, f"{path}/bins", obs_columns=["tissue", "donor_id"])
    return _flat(blocks, "tissue", "tissue_code", "donor_id")


@query("J4_extract_bin_range", f"SELECT * FROM ({_BLOCKS}) WHERE extract_bin BETWEEN 3 AND 6",
       ("random_binned", "packed", "wanted_features"))
def extracted_range(t):
    path, _ = _prepared(t, _RANDOM)
    blocks = extract_bins(t.spark, path, f"{path}/bins", 3, 6, obs_columns=["tissue", "donor_id"])
    return _flat(blocks, "tissue", "tissue_code", "donor_id")


@query("J4_extract_two_ranges", f"SELECT * FROM ({_BLOCKS}) WHERE extract_bin BETWEEN 2 AND 9",
       ("random_binned", "packed", "wanted_features"))
def extracted_ranges(t):
    path, _ = _prepared(t, _RANDOM)
    extract_bins(t.spark, path, f"{path}/bins", 2, 7, obs_columns=["tissue", "donor_id"])
    blocks = extract_bins(t.spark, path, f"{path}/bins", 5, 9, obs_columns=["tissue", "donor_id"])
    return _flat(blocks, "tissue", "tissue_code", "donor_id")


_ALL_ENTRIES = """
(SELECT cell_id, string_agg(col_num::VARCHAR, ',' ORDER BY col_num) AS indices,
                  string_agg(raw_count::VARCHAR, ',' ORDER BY col_num) AS counted
 FROM counts JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS col_num FROM features) f ON f.id = feature_id
 GROUP BY cell_id)"""


@query("J5_extract_grouped", f"""
SELECT g.extract_bin, row_number() OVER (PARTITION BY g.extract_bin ORDER BY g.id) - 1 AS row_num, g.id, g.tissue,
       coalesce(p.indices, '') AS indices, coalesce(p.counted, '') AS counted, (SELECT count(*) FROM features) AS n_features
FROM (SELECT id, tissue, dense_rank() OVER (ORDER BY tissue, disease, chunk) - 1 AS extract_bin
      FROM (SELECT *, (row_number() OVER (PARTITION BY tissue, disease ORDER BY id) - 1) // 1000 AS chunk FROM cells
            WHERE score > 90000)) g
LEFT JOIN {_ALL_ENTRIES} p ON p.cell_id = g.id""", ("cells", "counts", "features"))
def grouped(t):
    blocks = extract_grouped(
        t.cells, t.counts, t.features, scratch_path(t.spark, "grouped"), ["tissue", "disease"], 1000,
        {"score__gt": 90000}, obs_columns=["tissue", "not_there"],
    )
    return _flat(blocks, "tissue")


_RANDOMIZED = f"""
SELECT s.extract_bin, row_number() OVER (PARTITION BY s.extract_bin ORDER BY s.shuffle_key, s.id) - 1 AS row_num, s.id,
       coalesce(p.indices, '') AS indices, coalesce(p.counted, '') AS counted, (SELECT count(*) FROM axis) AS n_features
FROM ({SHUFFLED}) s
LEFT JOIN (SELECT cell_id, string_agg(col_num::VARCHAR, ',' ORDER BY col_num) AS indices,
                  string_agg(raw_count::VARCHAR, ',' ORDER BY col_num) AS counted
           FROM counts JOIN axis ON axis.id = feature_id GROUP BY cell_id) p ON p.cell_id = s.id"""


@query("F5_randomized_extract", f"""
SELECT * FROM (WITH axis AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS col_num FROM features) {_RANDOMIZED})""",
       ("random_binned", "counts", "features"))
def randomized(t):
    blocks = extract_randomized(
        t.cells, t.counts, t.features, scratch_path(t.spark, "randomized"), 1000, seed=7, obs_columns=[]
    )
    return _flat(blocks)


@query("J6_randomized_features", f"""
SELECT * FROM (WITH axis AS (
  SELECT id, row_number() OVER (ORDER BY position) - 1 AS col_num
  FROM (SELECT v.position, max(f.id) AS id
        FROM (VALUES (0, 'red widget'), (1, 'no such part'), (2, 'blue bolt'), (3, 'small ring')) v(position, value)
        JOIN features f ON f.symbol = v.value GROUP BY v.position)) {_RANDOMIZED})""", ("random_binned", "counts", "features"))
def randomized_features(t):
    blocks = extract_randomized(
        t.cells, t.counts, t.features, scratch_path(t.spark, "randomized"), 1000, seed=7, obs_columns=[],
        feature_column="symbol", feature_values=["red widget", "no such part", "blue bolt", "small ring"],
    )
    return _flat(blocks)


@query("G1_union_of_pieces", """
SELECT id, tissue, CASE WHEN disease <> 'F' THEN score END AS score, CASE WHEN disease <> 'O' THEN donor_id END AS donor_id
FROM cells""", ("cells",))
def united(t):
    cells = t.cells.select("id", "tissue", "score", "donor_id", "disease")
    return union_pieces([
        cells.filter("disease = 'P'").drop("disease"), cells.filter("disease = 'F'").drop("score", "disease"),
        cells.filter("disease = 'O'").drop("donor_id", "disease"),
    ])
