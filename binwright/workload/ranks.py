"""Hashes, ranks, bins, ranges and permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from binwright.functions import shuffle_hash
from binwright.operators.bins import chunk_in_category, chunks_in_groups, keyed_bins, rank_in_category
from binwright.operators.joins import feature_axis, local_index
from binwright.operators.ranks import (
    bin_names,
    block_slice,
    chunk_of,
    contiguous_ids,
    contiguous_ranges,
    permute_keep_last,
    random_bins,
    rank_by_value,
    running_sum,
    with_shuffle_key,
)
from binwright.plans.curriculum import grouped_plan, randomized_plan
from binwright.plans.extract import shuffle_into_bins
from binwright.workload.registry import hash_sql, query


def _keyed(t):
    category = F.concat("tissue", F.lit("##"), "cell_type")
    cells = t.cells_with_nulls.select("id", category.alias("extract_bin_category_key"))
    return with_shuffle_key(cells, 3)


@query("E1_rank_in_category", """
SELECT id, row_number() OVER (PARTITION BY category ORDER BY shuffle_key, id) AS rn FROM keyed_binned""", ("keyed_binned",))
def category_rank(t):
    return rank_in_category(_keyed(t)).select("id", "rn")


@query("E2_chunk_in_category", "SELECT id, chunk AS chunk_index FROM keyed_binned", ("keyed_binned",))
def category_chunk(t):
    return chunk_in_category(_keyed(t), 100).select("id", "chunk_index")


@query("E3_category_bins", "SELECT id, category, extract_bin FROM keyed_binned", ("keyed_binned",))
def category_bin_numbers(t):
    binned = keyed_bins(t.cells_with_nulls.select("id", "tissue", "cell_type"), ["tissue", "cell_type"], 100, seed=3)
    return binned.select("id", F.col("extract_bin_category_key").alias("category"), "extract_bin")


@query("E3_category_bins_many_keys", f"""
SELECT id, donor_id, dense_rank() OVER (ORDER BY donor_id, chunk) - 1 AS extract_bin
FROM (SELECT id, donor_id, (row_number() OVER (PARTITION BY donor_id ORDER BY {hash_sql('id', 5)}, id) - 1) // 4 AS chunk
      FROM cells)""", ("cells",))
def category_bins_many_keys(t):
    return keyed_bins(t.cells.select("id", "donor_id"), ["donor_id"], 4, seed=5).select("id", "donor_id", "extract_bin")


@query("E4_random_bins", "SELECT id, shuffle_key, extract_bin FROM random_binned", ("random_binned",))
def random_bin_numbers(t):
    return random_bins(t.cells.select("id"), 1000, seed=7)


@query("E5_contiguous_ids", """
SELECT id AS source_id, 1000 + row_number() OVER (ORDER BY ('0x' || substr(md5(original_id), 1, 15))::BIGINT, original_id) - 1 AS id
FROM cells""", ("cells",))
def assigned_ids(t):
    labels = t.cells.select(F.col("id").alias("source_id"), F.col("original_id").alias("obs_id"))
    return contiguous_ids(labels, start=1000).select("source_id", "id")


@query("E6_id_blocks", """
SELECT ingest_id, n, coalesce(sum(n) OVER (ORDER BY ingest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_id
FROM (SELECT ingest_id, count(*) AS n FROM cells GROUP BY ingest_id)""", ("cells",))
def id_blocks(t):
    sizes = t.cells.groupBy("ingest_id").agg(F.count(F.lit(1)).alias("n"))
    return running_sum(sizes, ["ingest_id"], {"start_id": "n"})


@query("E7_contiguous_ranges", """
SELECT range_index, min(id) AS "start", max(id) AS "end", count(*) AS n_cells
FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 250 AS range_index FROM cells WHERE tissue = 'BUILDING')
GROUP BY range_index""", ("cells",))
def id_ranges(t):
    return contiguous_ranges(t.cells.filter("tissue = 'BUILDING'"), 250)


@query("E8_chunks_in_groups", """
SELECT id, tissue, disease, (row_number() OVER (PARTITION BY tissue, disease ORDER BY id) - 1) // 120 AS chunk
FROM cells_with_nulls WHERE tissue IS NOT NULL""", ("cells_with_nulls",))
def group_chunks(t):
    return chunks_in_groups(t.cells_with_nulls.select("id", "tissue", "disease"), ["tissue", "disease"], 120)


_NAMES = f"""
SELECT n.extract_bin, CASE WHEN n.extract_bin = m.last THEN n.extract_bin ELSE r.rn - 1 END AS output_bin
FROM (SELECT DISTINCT id // 100 AS extract_bin FROM cells) n, (SELECT max(id // 100) AS last FROM cells) m
LEFT JOIN (SELECT b, row_number() OVER (ORDER BY {hash_sql('b', 11)}, b) AS rn
           FROM (SELECT DISTINCT id // 100 AS b FROM cells) WHERE b < (SELECT max(id // 100) FROM cells)) r
  ON r.b = n.extract_bin"""


@query("E9_output_bin_names", _NAMES, ("cells",))
def output_bin_names(t):
    bins = t.cells.select(chunk_of(F.col("id") + 1, 100).alias("extract_bin")).distinct()
    return bin_names(bins, bins.count(), seed=11)


@query("E10_block_slice", "SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM cells) WHERE rank // 700 = 3",
       ("cells",))
def one_block(t):
    ranked = rank_by_value(t.cells.select("id"), "id", "rank").withColumn("rank", F.col("rank") - 1)
    return block_slice(ranked, 3, 700)


_GROUPED = """
SELECT row_number() OVER (ORDER BY tissue, disease, chunk) - 1 AS bin_index, tissue || '||' || disease AS group_key,
       tissue, disease, min(id) AS id_min, max(id) AS id_max, count(*) AS cell_count
FROM (SELECT id, tissue, disease, (row_number() OVER (PARTITION BY tissue, disease ORDER BY id) - 1) // 120 AS chunk
      FROM cells_with_nulls WHERE tissue IS NOT NULL AND score > 90000)
GROUP BY tissue, disease, chunk"""


@query("E11_grouped_plan", _GROUPED, ("cells_with_nulls",))
def plan_of_groups(t):
    return grouped_plan(t.cells_with_nulls, ["tissue", "disease"], 120, {"score__gt": 90000}).bins


@query("E11_grouped_plan_summary", f"""
SELECT count(*) AS num_bins, arg_max(cell_count, bin_index) AS last_bin_size, sum(cell_count)::BIGINT AS total_cells,
       (SELECT count(*) FROM cells_with_nulls WHERE score > 90000 AND tissue IS NULL) AS n_null_key,
       120::BIGINT AS extract_bin_size
FROM ({_GROUPED})""", ("cells_with_nulls",))
def plan_of_groups_summary(t):
    return grouped_plan(t.cells_with_nulls, ["tissue", "disease"], 120, {"score__gt": 90000}).summary


_RANGES = f"""
SELECT c.range_index, c."start", c."end", c.n_cells,
       CASE WHEN c.range_index = m.last THEN c.range_index ELSE
         (SELECT count(*) FROM ranges o WHERE o.range_index < m.last AND
           ({hash_sql('o.range_index', 13)}, o.range_index) < ({hash_sql('c.range_index', 13)}, c.range_index)) END AS read_order
FROM ranges c, (SELECT max(range_index) AS last FROM ranges) m"""


@query("E12_randomized_plan", f"""
SELECT * FROM (WITH ranges AS (
  SELECT range_index, min(id) AS "start", max(id) AS "end", count(*) AS n_cells
  FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 200 AS range_index FROM cells WHERE score > 90000)
  GROUP BY range_index) {_RANGES})""", ("cells",))
def plan_of_ranges(t):
    return randomized_plan(t.cells, 200, 350, seed=13, filters={"score__gt": 90000}).ranges


@query("E12_randomized_plan_summary", """
SELECT n AS total_cells, 200::BIGINT AS range_size, (n + 199) // 200 AS num_ranges, 350::BIGINT AS extract_bin_size,
       (n + 349) // 350 AS num_bins, n - ((n + 349) // 350 - 1) * 350 AS last_bin_size
FROM (SELECT count(*) AS n FROM cells WHERE score > 90000)""", ("cells",))
def plan_of_ranges_summary(t):
    return randomized_plan(t.cells, 200, 350, seed=13, filters={"score__gt": 90000}).summary


@query("F1_shuffle_key", f"SELECT id, {hash_sql('id', 42)} AS shuffle_key FROM cells", ("cells",))
def shuffle_keys(t):
    return t.cells.select("id", shuffle_hash(F.col("id"), 42).alias("shuffle_key"))


@query("F2_random_order_in_bin", """
SELECT extract_bin, row_number() OVER (PARTITION BY extract_bin ORDER BY shuffle_key, id) - 1 AS row_num, id
FROM random_binned WHERE extract_bin BETWEEN 2 AND 9""", ("random_binned",))
def order_in_bin(t):
    binned = random_bins(t.cells.select("id"), 1000, seed=7).filter(F.col("extract_bin").between(2, 9))
    return local_index(binned, order=["shuffle_key", "id"]).select("extract_bin", "row_num", "id")


@query("F3_feature_axis", "SELECT id, ensemble_id, row_number() OVER (ORDER BY id) - 1 AS col_num FROM features",
       ("features",))
def ordered_features(t):
    return feature_axis(t.features.select("id", "ensemble_id"))


_SHUFFLED = f"""
SELECT s.id, s.shuffle_key, CASE WHEN s.b = m.last THEN s.b ELSE
         (SELECT count(*) FROM bins o WHERE o.b < m.last AND ({hash_sql('o.b', 7)}, o.b) < ({hash_sql('s.b', 7)}, s.b)) END AS extract_bin
FROM (SELECT id, shuffle_key, extract_bin AS b FROM random_binned) s, (SELECT max(extract_bin) AS last FROM random_binned) m"""
SHUFFLED = f"SELECT * FROM (WITH bins AS (SELECT DISTINCT extract_bin AS b FROM random_binned) {_SHUFFLED})"


@query("F4_cell_permutation", SHUFFLED, ("random_binned",))
def permutation(t):
    cells = t.cells.select("id")
    return shuffle_into_bins(cells, 1000, seed=7, total=cells.count())


@query("E9_shuffle_keep_last", f"""
SELECT position, CASE WHEN position = last THEN position ELSE rn - 1 END AS new_position
FROM (SELECT DISTINCT feature_id AS position FROM counts), (SELECT max(feature_id) AS last FROM counts)
LEFT JOIN (SELECT p, row_number() OVER (ORDER BY {hash_sql('p', 5)}, p) AS rn
           FROM (SELECT DISTINCT feature_id AS p FROM counts WHERE feature_id < (SELECT max(feature_id) FROM counts)))
  ON p = position""", ("counts",))
def keep_last(t):
    positions = t.counts.select(F.col("feature_id").alias("position")).distinct()
    total = positions.agg(F.max("position")).first()[0] + 1
    return permute_keep_last(positions, "position", total, seed=5, out="new_position")
