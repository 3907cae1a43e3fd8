"""String, JSON, array, cast and null functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from binwright.functions import (
    category_code,
    category_key,
    clean_count,
    fill_for_extract,
    group_label,
    json_scalars,
    leftover_json,
    prune_metadata,
    sparse_indices,
    sparse_values,
)
from binwright.operators.explore import category_lists
from binwright.operators.ranks import random_bins
from binwright.plans.extract import encode_categories
from binwright.plans.ingest import sanitize_obs
from binwright.plans.prepare import count_matrix
from binwright.schemas import CELL_INFO, add_missing_fields
from binwright.workload.registry import query


@query("H1_category_key", "SELECT id, tissue || '##' || cell_type AS category FROM cells_with_nulls", ("cells_with_nulls",))
def keys(t):
    return t.cells_with_nulls.select("id", category_key(["tissue", "cell_type"]).alias("category"))


@query("H2_group_label", "SELECT id, tissue || '||' || ingest_id::VARCHAR AS label FROM cells", ("cells",))
def labels(t):
    return t.cells.select("id", group_label(["tissue", "ingest_id"]).alias("label"))


@query("H3_json_scalars", """
SELECT id, json_extract_string(metadata_extra, '$.k') AS k, NULL::VARCHAR AS absent FROM event_cells""", ("event_cells",))
def metadata_columns(t):
    return t.event_cells.select("id", *[c.alias(k) for k, c in json_scalars("metadata_extra", ["k", "absent"]).items()])


@query("H4_leftover_json", """
SELECT id, CASE WHEN tissue IS NULL AND cell_type IS NULL THEN '{}'
                WHEN tissue IS NULL THEN '{"cell_type":"' || cell_type || '"}'
                WHEN cell_type IS NULL THEN '{"tissue":"' || tissue || '"}'
                ELSE '{"cell_type":"' || cell_type || '","tissue":"' || tissue || '"}' END AS metadata_extra
FROM cells_with_nulls""", ("cells_with_nulls",))
def leftovers(t):
    return t.cells_with_nulls.select("id", leftover_json(["cell_type", "tissue"]).alias("metadata_extra"))


@query("H5_metadata_pruning", """
SELECT doc_id, CASE WHEN octet_length(encode(text)) > 2000
                    THEN 'Value was removed due to large size: ' || octet_length(encode(text))::VARCHAR || ' bytes.'
                    ELSE text END AS text, source, NULL::VARCHAR AS lang
FROM documents""")
def pruned_metadata(t):
    documents = t.raw("documents")
    fields = F.create_map(*[v for c in ("text", "source", "lang") for v in (F.lit(c), F.col(c))])
    pruned = documents.select("doc_id", prune_metadata(fields, limit=2000, keep=["text", "source"]).alias("j"))
    return pruned.select("doc_id", *[c.alias(k) for k, c in json_scalars("j", ["text", "source", "lang"]).items()])


@query("H6_missing_fields", """
SELECT id, cell_type, NULL::VARCHAR AS assay, NULL::BIGINT AS total_mrna_umis, NULL::VARCHAR AS sex_ontology_term_id
FROM cells""", ("cells",))
def missing_fields(t):
    return add_missing_fields(t.cells, CELL_INFO).select(
        "id", "cell_type", "assay", "total_mrna_umis", "sex_ontology_term_id"
    )


_OBS_COLUMNS = [
    ("score", "int32", False), ("tissue", "string", True), ("cell_type", "category", False),
    ("age", "float32", True), ("sample", "string", True),
]


@query("H7_reduce_and_cast", """
SELECT id::VARCHAR AS obs_id, trunc(score)::INTEGER AS score, coalesce(tissue, 'unknown') AS tissue,
       cell_type, NULL::FLOAT AS age, 'unknown' AS sample FROM cells_with_nulls""", ("cells_with_nulls",))
def reduced(t):
    cells = t.cells_with_nulls.withColumn("obs_id", F.col("id").cast("string"))
    return sanitize_obs(cells, _OBS_COLUMNS)


@query("H8_null_fill_ingest", "SELECT id::VARCHAR AS obs_id, coalesce(tissue, 'unknown') AS tissue FROM cells_with_nulls",
       ("cells_with_nulls",))
def ingest_fill(t):
    cells = t.cells_with_nulls.withColumn("obs_id", F.col("id").cast("string"))
    return sanitize_obs(cells, [("tissue", "string", True)])


@query("H9_null_fill_extract", """
SELECT id, coalesce(tissue, '') AS tissue, score IS NULL OR id % 9 = 0 AS score_is_nan,
       CASE WHEN id % 9 = 0 THEN 0 ELSE score END AS score FROM cells_with_nulls""", ("cells_with_nulls",))
def extract_fill(t):
    cells = t.cells_with_nulls.withColumn("score", F.when(F.col("id") % 9 != 0, F.col("score")))
    filled = cells.select("id", *[fill_for_extract(c, cells.schema[c].dataType).alias(c) for c in ("tissue", "score")])
    return filled.select("id", "tissue", F.isnan("score").alias("score_is_nan"), F.nanvl("score", F.lit(0.0)).alias("score"))


@query("H10_categorical_encoding", """
SELECT c.id, v.value AS cell_type, v.code::INTEGER AS cell_type_code FROM cells_with_nulls c
LEFT JOIN (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code
           FROM (SELECT DISTINCT cell_type AS value FROM cells_with_nulls WHERE disease = 'P' AND cell_type > '2')) v
  ON c.cell_type = v.value""", ("cells_with_nulls",))
def encoded(t):
    source = t.cells_with_nulls.filter("disease = 'P' AND cell_type > '2'").select("cell_type")
    listed = category_lists(source)
    codes = listed.select("column_name", F.posexplode("categories").alias("code", "value"))
    return encode_categories(t.cells_with_nulls.select("id", "cell_type"), codes, ["cell_type"])


@query("H10_category_code", """
SELECT id, disease, CASE disease WHEN 'F' THEN 0 WHEN 'O' THEN 1 END::INTEGER AS code FROM cells""", ("cells",))
def code_in_list(t):
    listed = F.array(F.lit("F"), F.lit("O"))
    return t.cells.select("id", "disease", category_code(F.col("disease"), listed).alias("code"))


@query("H11_coo_clean_up", """
SELECT l_orderkey, l_linenumber, trunc(l_discount * l_quantity)::BIGINT AS raw_count FROM lineitem
WHERE trunc(l_discount * l_quantity) <> 0""")
def cleaned(t):
    raw = t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", clean_count(F.col("l_discount") * F.col("l_quantity")).alias("raw_count")
    )
    return raw.filter("raw_count <> 0")


@query("H12_sparse_rows", """
SELECT extract_bin, cell_id, string_agg(feature_id::VARCHAR, ',' ORDER BY feature_id) AS indices,
       string_agg(raw_count::VARCHAR, ',' ORDER BY feature_id) AS counted FROM packed GROUP BY ALL""", ("packed",))
def sparse_rows(t):
    packed = count_matrix(t.counts, t.features, t.wanted_features, random_bins(t.cells, 1000, seed=7))
    entries = F.transform("feature_data", lambda e: F.struct(e["feature_id"].alias("col_num"), e["raw_counts"].alias("value")))
    rows = packed.select("extract_bin", "cell_id", entries.alias("e")).select(
        "extract_bin", "cell_id", sparse_indices(F.col("e")).alias("indices"), sparse_values(F.col("e")).alias("values")
    )
    def listed(column, kind):
        return F.array_join(F.transform(column, lambda v: v.cast(kind).cast("string")), ",")

    return rows.select(
        "extract_bin", "cell_id", listed("indices", "bigint").alias("indices"), listed("values", "bigint").alias("counted")
    )
