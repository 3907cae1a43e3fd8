"""Data-quality jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from binwright.operators.quality import (
    feature_list_faults,
    matrix_faults,
    matrix_profile,
    obs_faults,
    offending_values,
    raw_count_check,
    raw_counts_validator,
    repeated_positions,
    string_column_faults,
    validation_report,
)
from binwright.plans.ingest import ArraySchema, Batch, batch_faults
from binwright.workload.joins import _SCHEMA, schema_features
from binwright.workload.registry import query

_X = ("faulty_x", "faulty_shapes")


def faulty_x(t):
    """Line items as the matrix values of three big files, with every kind of fault."""
    key, quantity = F.col("l_orderkey"), F.col("l_quantity")
    value = (
        F.when(key % 97 == 0, F.lit(float("nan"))).when(key % 89 == 0, -quantity).when(key % 83 == 0, quantity + 0.5)
        .when(key % 79 == 0, F.lit(3e9)).when(key % 73 == 0, F.lit(float("inf"))).otherwise(quantity)
    )
    return t.raw("lineitem").select(
        F.concat(F.lit("file_"), "l_returnflag").alias("file"), key.alias("row_pos"),
        F.col("l_partkey").alias("col_pos"), value.alias("value"),
    )


def faulty_shapes(t):
    return faulty_x(t).groupBy("file").agg(
        (F.max("row_pos") - 10).alias("n_obs"), (F.max("col_pos") + 1).alias("n_vars")
    )


# Conditions of the matrix checks, in SQL.
_CHECKS = {
    "shape": "row_pos >= n_obs OR col_pos >= n_vars",
    "nan": "isnan(value)",
    "infinite": "isinf(value)",
    "negative": "NOT isnan(value) AND value < 0",
    "non_integer": "isnan(value) OR (NOT isinf(value) AND abs(value - round_even(value, 0)) > 1e-8 + 1e-5 * abs(round_even(value, 0)))",
    "int32_range": "NOT isnan(value) AND (value > 2147483647 OR value < -2147483648)",
    "null": "value IS NULL",
}
_PROFILED = (
    "SELECT file, count(*) AS n_values, "
    + ", ".join(f'count(*) FILTER ({c}) AS "{n}"' for n, c in _CHECKS.items())
    + " FROM faulty_x JOIN faulty_shapes USING (file) GROUP BY file"
)


def _one_check(identifier, name):
    @query(identifier, f"SELECT file, n_values, {name} FROM ({_PROFILED})", _X)
    def run(t):
        return matrix_profile(faulty_x(t), faulty_shapes(t)).select("file", "n_values", name)


_one_check("I4_shape", "shape")
_one_check("I5_nan", "nan")
_one_check("I5_infinite", "infinite")
_one_check("I6_non_negative", "negative")
_one_check("I7_integer_like", "non_integer")
_one_check("I8_int32_range", "int32_range")


@query("I4_null_values", """
SELECT file, count(*) FILTER (row_pos % 7 = 0) AS n_null, count(*) FILTER (col_pos % 11 = 0 OR NOT known) AS n_outside
FROM (SELECT *, file <> 'file_N' AS known FROM faulty_x) GROUP BY file""", ("faulty_x",))
def null_values(t):
    x = faulty_x(t).withColumn("value", F.when(F.col("row_pos") % 7 != 0, F.col("value"))).withColumn(
        "col_pos", F.when(F.col("col_pos") % 11 != 0, F.col("col_pos"))
    )
    shapes = x.where("file <> 'file_N'").groupBy("file").agg(
        (F.max("row_pos") + 1).alias("n_obs"), (F.max("col_pos") + 1).alias("n_vars")
    )
    return matrix_profile(x, shapes).select("file", F.col("null").alias("n_null"), F.col("shape").alias("n_outside"))


@query("I1_required_strings", """
SELECT file, 'obs: NULL values' AS "check", column_name, n, NULL::VARCHAR AS sample FROM (
  SELECT 'file_' || ingest_id::VARCHAR AS file, 'tissue' AS column_name, count(*) FILTER (tissue IS NULL) AS n
  FROM cells_with_nulls GROUP BY ALL
  UNION ALL SELECT 'file_' || ingest_id::VARCHAR, 'cell_type', count(*) FILTER (cell_type IS NULL)
  FROM cells_with_nulls GROUP BY ALL) WHERE n > 0
UNION ALL SELECT '*', 'obs: missing column', 'assay', 1, NULL
UNION ALL SELECT '*', 'obs: not text', 'score', 1, NULL""", ("cells_with_nulls",))
def required_strings(t):
    cells = t.cells_with_nulls.withColumn("file", F.concat(F.lit("file_"), F.col("ingest_id").cast("string")))
    return string_column_faults(cells, ["tissue", "cell_type", "assay", "score"], "obs")


@query("I3_obs_castability", """
SELECT '*' AS file, 'obs: missing column' AS "check", 'sample' AS column_name, 1::BIGINT AS n, NULL::VARCHAR AS sample
FROM (SELECT count(*) FROM cells)
UNION ALL SELECT 'file_' || disease, 'obs: cannot be cast', 'donor_id', count(*) FILTER (donor_id::BIGINT > 127), NULL
FROM cells GROUP BY disease HAVING count(*) FILTER (donor_id::BIGINT > 127) > 0
UNION ALL SELECT 'file_' || disease, 'obs: cannot be cast', 'score', count(*) FILTER (score <> trunc(score)), NULL
FROM cells GROUP BY disease HAVING count(*) FILTER (score <> trunc(score)) > 0
UNION ALL SELECT 'file_' || disease, 'obs: cannot be cast', 'tissue', count(*), NULL FROM cells GROUP BY disease""", ("cells",))
def castability(t):
    cells = t.cells.withColumn("file", F.concat(F.lit("file_"), "disease"))
    return obs_faults(cells, [
        ("donor_id", "int8", False), ("score", "int64", True), ("tissue", "float64", True), ("id", "int64", False),
        ("age", "int32", True), ("sample", "string", False),
    ])


@query("I4_repeated_positions", """
SELECT file, count(*) AS n_repeated FROM (SELECT file, row_pos, col_pos FROM faulty_x GROUP BY ALL HAVING count(*) > 1)
GROUP BY file""", ("faulty_x",))
def repeats(t):
    return repeated_positions(faulty_x(t))


@query("I7_examples", f"""
SELECT file, "check", row_pos, col_pos FROM (
  SELECT DISTINCT ON (file, row_pos, col_pos, "check") * FROM (
    SELECT file, 'non_integer' AS "check", row_pos, col_pos, row_number() OVER (PARTITION BY file ORDER BY row_pos, col_pos) AS rn
    FROM (SELECT * FROM faulty_x JOIN faulty_shapes USING (file) WHERE {_CHECKS['non_integer']})
    UNION ALL
    SELECT file, 'negative', row_pos, col_pos, row_number() OVER (PARTITION BY file ORDER BY row_pos, col_pos)
    FROM (SELECT * FROM faulty_x JOIN faulty_shapes USING (file) WHERE {_CHECKS['negative']})) WHERE rn <= 5)""", _X)
def examples(t):
    rows = offending_values(faulty_x(t), faulty_shapes(t), ["non_integer", "negative"])
    return rows.select("file", "check", "row_pos", "col_pos").distinct()


def _profile_sql(names):
    union = " UNION ALL ".join(f"SELECT file, 'X: {n}' AS \"check\", \"{n}\" AS n FROM ({_PROFILED})" for n in names)
    return f"SELECT * FROM ({union}) WHERE n > 0"


@query("I9_count_matrix_profile", _profile_sql(list(_CHECKS)), _X)
def count_profile(t):
    return matrix_faults(faulty_x(t), faulty_shapes(t), "count_matrix").select("file", "check", "n")


@query("I9_feature_matrix_profile", _profile_sql(["shape", "nan", "infinite"]), _X)
def feature_profile(t):
    return matrix_faults(faulty_x(t), faulty_shapes(t), "feature_matrix").select("file", "check", "n")


@query("I10_collected_validation", f"""
SELECT file, 'obs: cannot be cast' AS "check", 'tissue' AS column_name, count(*) AS n FROM file_obs GROUP BY file
UNION ALL SELECT '*', 'obs: missing column', 'sample', 1
UNION ALL SELECT v.file, 'var: unknown features', NULL, count(*) FROM file_var v
  WHERE v.var_id NOT IN (SELECT feature_name FROM {_SCHEMA}) GROUP BY v.file
UNION ALL SELECT file, 'X: negative', NULL, count(*) FROM file_x WHERE value = 0 GROUP BY file""",
       ("file_obs", "file_var", "file_x", "features"))
def collected(t):
    batch = t.batch
    x = batch.x.withColumn("value", F.when(F.col("value") == 0, -1.0).otherwise(F.col("value")))
    schema = ArraySchema([("tissue", "int32", True), ("sample", "string", False)], schema_features(t))
    return batch_faults(Batch(batch.obs, batch.var, x), schema).select("file", "check", "column_name", "n")


@query("I11_raw_count_sum", """
SELECT file, count(value) AS n_values, coalesce(abs(sum(value) - round(sum(value))) <= 0.01, false) AS is_valid
FROM (SELECT DISTINCT 'brand_' || p_brand AS file FROM part)
LEFT JOIN (SELECT 'brand_Brand#' || (l_suppkey % 40)::VARCHAR AS file,
                  CASE WHEN l_suppkey % 2 = 0 THEN l_quantity ELSE l_quantity + 0.25 END AS value
           FROM lineitem) USING (file) GROUP BY file""")
def raw_count_sums(t):
    files = t.raw("part").select(F.concat(F.lit("brand_"), "p_brand").alias("file")).distinct()
    odd = F.col("l_suppkey") % 2 == 1
    x = t.raw("lineitem").select(
        F.concat(F.lit("brand_Brand#"), (F.col("l_suppkey") % 40).cast("string")).alias("file"),
        F.when(odd, F.col("l_quantity") + 0.25).otherwise(F.col("l_quantity")).alias("value"),
    )
    return raw_count_check(x, files)


@query("I12_feature_list", """
SELECT CASE WHEN ensemble_id IS NULL THEN 'NULL id' ELSE 'repeated id' END AS "check", ensemble_id, count(*) AS n
FROM (SELECT CASE WHEN symbol <> 'red widget' THEN symbol END AS ensemble_id FROM features)
GROUP BY ensemble_id HAVING ensemble_id IS NULL OR count(*) > 1""", ("features",))
def feature_list(t):
    listed = t.features.select(F.when(F.col("symbol") != "red widget", F.col("symbol")).alias("ensemble_id"), "symbol")
    return feature_list_faults(listed)


@query("I13_validation_report", f"""
SELECT * FROM (WITH sizes AS (SELECT file, count(*) AS n FROM faulty_x GROUP BY file),
     gate AS (SELECT file, n <= (SELECT max(n) - 1 FROM sizes) AS ok FROM sizes),
     profiled AS ({_PROFILED})
SELECT file, 'file_size' AS validator, ok AS is_valid, CASE WHEN NOT ok THEN 'File size is too large.' END AS message FROM gate
UNION ALL SELECT file, 'binwright.operators.quality.raw_counts_validator', false,
  'The sum is not close to an integer: not raw counts.' FROM gate WHERE ok
UNION ALL SELECT file, 'binwright.operators.quality.count_matrix_validator', false,
  concat_ws(', ', {', '.join(f"""CASE WHEN "{n}" > 0 THEN "{n}"::VARCHAR || ' {n}' END""" for n in _CHECKS)})
FROM profiled JOIN gate USING (file) WHERE ok)""", _X)
def report(t):
    x, shapes = faulty_x(t), faulty_shapes(t)
    sizes = x.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    limit = sizes.agg(F.max("n")).first()[0] - 1
    gate = sizes.select("file", (F.col("n") <= limit).alias("is_valid"))
    return validation_report({"x": x, "shapes": shapes}, gate, [
        raw_counts_validator, "binwright.operators.quality.count_matrix_validator",
    ])


def many_values(tables):
    """A validator of the caller: files need at least 100 stored values."""
    counted = tables["x"].groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    enough = F.col("n") >= 100
    return counted.select("file", enough.alias("is_valid"), F.when(~enough, F.lit("too few values")).alias("message"))


@query("I14_pluggable_validators", """
WITH x AS (SELECT 'supp_' || l_suppkey::VARCHAR AS file FROM lineitem),
     sizes AS (SELECT file, count(*) AS n FROM x GROUP BY file)
SELECT file, 'file_size' AS validator, true AS is_valid, NULL::VARCHAR AS message FROM sizes
UNION ALL SELECT file, 'binwright.workload.quality.many_values', n >= 100, CASE WHEN n < 100 THEN 'too few values' END
FROM sizes""")
def pluggable(t):
    x = t.raw("lineitem").select(F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("file"))
    gate = x.select("file").distinct().withColumn("is_valid", F.lit(True))
    return validation_report({"x": x}, gate, [many_values])
