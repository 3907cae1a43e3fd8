"""Ingest jobs over the cells as input files."""

from __future__ import annotations

from pyspark.sql import functions as F

from binwright.errors import IngestError
from binwright.operators.joins import feature_axis
from binwright.operators.ranks import rank_by_value
from binwright.plans.ingest import (
    ArraySchema,
    Batch,
    batch_faults,
    first_file_axis,
    ingest_batch,
    ingest_partition,
    partition_files,
    placement_faults,
    plan_partitions,
    read_store,
    register_batch,
    register_labels,
    reserve_blocks,
)
from binwright.session import freeze, scratch_path
from binwright.sources.base import read_table
from binwright.workload.joins import _SCHEMA, schema_features
from binwright.workload.registry import query

_OBS_MAP = {"index": "original_id", "donor": "donor_id"}
_VAR_MAP = {"var_id": "ensemble_id"}


def _batch(t) -> Batch:
    """Input files with the reference column that the feature table requires, and file metadata."""
    batch = t.batch
    uns = batch.obs.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select(
        "file", F.create_map(F.lit("title"), F.concat(F.lit("t_"), "file"), F.lit("note"), F.repeat(F.lit("x"), 300)).alias("metadata")
    )
    return Batch(batch.obs, batch.var.withColumn("reference", F.lit("ref")), batch.x, uns)


_CELLS_SQL = """
SELECT b.cell_start + o.row_pos AS id, o.obs_id AS original_id, b.ingest_id, o.donor AS donor_id, o.cell_type, o.tissue,
       'lot' AS tag, round(o.score, 2) AS score, coalesce(x.total, 0)::BIGINT AS total_mrna_umis
FROM file_obs o JOIN blocks b USING (file)
LEFT JOIN (SELECT file, row_pos, sum(value) AS total FROM file_x GROUP BY ALL) x ON x.file = o.file AND x.row_pos = o.row_pos"""


@query("J1_ingest_cells", _CELLS_SQL, ("file_obs", "file_x", "blocks"))
def ingested_cells(t):
    warehouse = scratch_path(t.spark, "warehouse")
    ingest_batch(t.spark, warehouse, _batch(t), _OBS_MAP, _VAR_MAP, tag="lot")
    return read_table(t.spark, warehouse, "cell_info").select(
        "id", "original_id", "ingest_id", "donor_id", "cell_type", "tissue", "tag",
        F.round(F.get_json_object("metadata_extra", "$.score").cast("double"), 2).alias("score"), "total_mrna_umis",
    )


@query("J1_ingest_counts", """
SELECT b.cell_start + x.row_pos AS cell_id, b.feature_start + x.col_pos AS feature_id, x.value::BIGINT AS raw_count
FROM file_x x JOIN blocks b USING (file) WHERE x.value <> 0""", ("file_x", "blocks"))
def ingested_counts(t):
    warehouse = scratch_path(t.spark, "warehouse")
    ingest_batch(t.spark, warehouse, _batch(t), _OBS_MAP, _VAR_MAP)
    return read_table(t.spark, warehouse, "raw_matrix_coo")


@query("J1_ingest_features", """
SELECT b.feature_start + v.col_pos AS id, v.var_id AS ensemble_id, v.symbol, b.ingest_id, v.biotype, 'ref' AS reference,
       '{"title":"t_' || v.file || '"}' AS ingest_metadata
FROM file_var v JOIN blocks b USING (file)""", ("file_var", "blocks"))
def ingested_features(t):
    warehouse = scratch_path(t.spark, "warehouse")
    ingest_batch(t.spark, warehouse, _batch(t), _OBS_MAP, _VAR_MAP, metadata_keep=["title"])
    ingests = read_table(t.spark, warehouse, "ingest_info").select(
        F.col("id").alias("ingest_id"), F.col("metadata_extra").alias("ingest_metadata")
    )
    features = read_table(t.spark, warehouse, "feature_info")
    return features.select("id", "ensemble_id", "symbol", "ingest_id", "biotype", "reference").join(ingests, "ingest_id")


@query("E6_reserved_blocks", "SELECT file, n_obs, n_vars, ingest_id + 5 AS ingest_id, cell_start + 100 AS cell_start, feature_start + 1000 AS feature_start FROM blocks",
       ("blocks",))
def reserved(t):
    return reserve_blocks(t.batch.shapes, first_ingest=5, first_cell=100, first_feature=1000)


@query("J2_isolated_faults", """
SELECT ingest_id, count(*) AS n_cells, min(original_id) AS first_label FROM (
  SELECT dense_rank() OVER (ORDER BY file) - 1 AS ingest_id, obs_id AS original_id FROM file_obs
  WHERE substr(file, 6)::INTEGER % 3 <> 0) GROUP BY ingest_id""", ("file_obs",))
def isolated(t):
    warehouse = scratch_path(t.spark, "warehouse")
    batch = _batch(t)
    third = F.substring("file", 6, 9).cast("int") % 3 == 0
    var = batch.var.withColumn("reference", F.when(~((F.col("col_pos") == 7) & third), F.col("reference")))
    try:
        ingest_batch(t.spark, warehouse, Batch(batch.obs, var, batch.x, batch.uns), _OBS_MAP, _VAR_MAP, partial=True)
    except IngestError:
        pass  # reported after the good files are committed
    return read_table(t.spark, warehouse, "cell_info").groupBy("ingest_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("original_id").alias("first_label")
    )


def _array_schema(t) -> ArraySchema:
    axis = feature_axis(t.features.select("id", F.col("ensemble_id").alias("feature_name"), "symbol"))
    features = freeze(axis.select("feature_name", F.col("col_num").alias("position"), "symbol"))
    return ArraySchema([("cell_type", "string", False), ("tissue", "string", True), ("age", "int32", True)], features)


_STORED_SQL = """
SELECT o.obs_id, v.var_id AS feature_name, x.value, o.cell_type, o.tissue, NULL::INTEGER AS age
FROM file_x x JOIN file_obs o ON x.file = o.file AND x.row_pos = o.row_pos
JOIN file_var v ON x.file = v.file AND x.col_pos = v.col_pos"""
_STORED_VIEWS = ("file_x", "file_obs", "file_var")


def _run_plan(t, store, schema, batch, batch_size):
    """Ingests all files of a batch by a plan of its own."""
    names = batch.obs.select("file").distinct().withColumn("n", F.substring("file", 6, 9).cast("bigint"))
    files = rank_by_value(names, "n", "_rank").select("file", (F.col("_rank") - 1).alias("position"))
    total = files.count()
    planned, totals = plan_partitions(files, total, batch_size)
    for index in range(totals["num_partitions"]):
        part = batch.only(partition_files(planned, total, index, batch_size))
        ingest_partition(t.spark, store, part, schema, index)


def _stored(t, store, schema):
    stored = read_store(t.spark, store, schema)
    cells = stored["obs"].withColumnRenamed("id", "cell_id")
    features = stored["var"].select(F.col("id").alias("feature_id"), "feature_name")
    return stored["X"].join(cells, "cell_id").join(features, "feature_id").drop("cell_id", "feature_id")


def _first_files(batch, n):
    return batch.only(batch.obs.select("file").distinct().filter(F.substring("file", 6, 9).cast("int") < n))


@query("J7_partitioned_ingest", _STORED_SQL, _STORED_VIEWS)
def partitioned(t):
    store, schema, batch = scratch_path(t.spark, "store"), _array_schema(t), t.batch
    register_batch(t.spark, store, batch)
    _run_plan(t, store, schema, batch, 13)
    return _stored(t, store, schema)


@query("J7_overlapping_plans", _STORED_SQL, _STORED_VIEWS)
def overlapping(t):
    """Some files with other values and types, then all files as they are: each cell once, as it came last."""
    store, schema, batch = scratch_path(t.spark, "store"), _array_schema(t), t.batch
    register_batch(t.spark, store, batch)
    early = _first_files(batch, 12)
    wrong = F.col("file") == "file_003"
    early = Batch(
        early.obs.withColumn("tissue", F.when(wrong, F.lit("other")).otherwise(F.col("tissue"))), early.var,
        early.x.withColumn("value", F.when(wrong, F.col("value") + 1).otherwise(F.col("value"))),
    )
    _run_plan(t, store, schema, early, 12)
    _run_plan(t, store, schema, batch, 25)
    return _stored(t, store, schema)


@query("J7_second_plan", _STORED_SQL, _STORED_VIEWS)
def second_plan(t):
    """A plan over the first files, then one over the others, registered as they come."""
    store, schema, batch = scratch_path(t.spark, "store"), _array_schema(t), t.batch
    for lot in (_first_files(batch, 9), batch.only(batch.obs.select("file").distinct().filter(F.substring("file", 6, 9).cast("int") >= 9))):
        register_batch(t.spark, store, lot)
        _run_plan(t, store, schema, lot, 25)
    return _stored(t, store, schema)


@query("J7_ingest_plan", """
SELECT file, (row_number() OVER (ORDER BY file) - 1) // 10 AS partition_index FROM (SELECT DISTINCT file FROM file_obs)""",
       ("file_obs",))
def ingest_plan(t):
    names = t.batch.obs.select("file").distinct().withColumn("n", F.substring("file", 6, 9).cast("bigint"))
    files = rank_by_value(names, "n", "_rank").select("file", (F.col("_rank") - 1).alias("position"))
    planned, _ = plan_partitions(files, files.count(), batch_size=10)
    return planned.select("file", "partition_index")


_LABEL_HASH = "('0x' || substr(md5(label), 1, 15))::BIGINT"


@query("J8_label_registration", f"""
SELECT label, 700 + row_number() OVER (ORDER BY {_LABEL_HASH}, label) - 1 AS id
FROM (SELECT DISTINCT donor_id AS label FROM cells WHERE donor_id::BIGINT % 4 <> 0)""", ("cells",))
def registered(t):
    donors = t.cells.select(F.col("donor_id").alias("label"))
    known = donors.filter(F.col("label").cast("bigint") % 4 == 0).distinct().withColumn("id", F.lit(1).cast("bigint"))
    return register_labels(donors, known, first_id=700)


@query("J9_first_file_axis", f"""
SELECT x.file, x.row_pos, s.position AS col_pos, x.value FROM file_x x
JOIN file_var v ON x.file = v.file AND x.col_pos = v.col_pos JOIN {_SCHEMA} s ON v.var_id = s.feature_name
WHERE x.file = 'file_000'""", ("file_x", "features"))
def first_file(t):
    batch = t.batch
    first = batch.only(batch.obs.select("file").filter("file = 'file_000'").distinct())
    schema = ArraySchema([("cell_type", "string", False)], schema_features(t))
    return first_file_axis(first, schema).x


@query("I10_batch_faults_clean", """
SELECT count(DISTINCT file) AS n_files, count(*) FILTER (row_pos < 0) AS n_faults FROM file_obs""", ("file_obs",))
def clean_batch(t):
    found = batch_faults(t.batch, _array_schema(t)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    files = t.batch.obs.select("file", F.col("file").alias("own")).distinct().join(found, "file", "full")
    return files.agg(F.count("own").alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_faults"))


@query("J2_misplaced_values", """
SELECT file, count(*) FILTER (row_pos % 50 = 0) AS n_outside, count(*) FILTER (row_pos % 50 <> 0 AND col_pos % 40 = 0) AS n_null
FROM file_x GROUP BY file HAVING count(*) FILTER (row_pos % 50 = 0 OR col_pos % 40 = 0) > 0""", ("file_x",))
def misplaced(t):
    batch, out = t.batch, F.col("row_pos") % 50 == 0
    x = batch.x.withColumn("value", F.when(out | (F.col("col_pos") % 40 != 0), F.col("value"))).withColumn(
        "row_pos", F.when(out, -1 - F.col("row_pos")).otherwise(F.col("row_pos"))
    )
    faults = placement_faults(Batch(batch.obs, batch.var, x))
    return faults.groupBy("file").agg(
        F.coalesce(F.sum(F.when(F.col("check") == "X: shape", F.col("n"))), F.lit(0)).alias("n_outside"),
        F.coalesce(F.sum(F.when(F.col("check") == "X: null", F.col("n"))), F.lit(0)).alias("n_null"),
    )
