"""Ingest: files of cells, features and counts become committed base-table rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binwright.errors import IngestError
from binwright.functions import clean_count, leftover_json, prune_metadata
from binwright.functions.columns import METADATA_VALUE_LIMIT, STRING_NULL_FILL
from binwright.operators.dims import fits_broadcast, join_dimension
from binwright.operators.joins import align_features, expand_to_axis
from binwright.operators.projection import map_columns
from binwright.operators.quality import (
    collected_faults,
    matrix_faults,
    position_faults,
    raise_on_faults,
    repeated_faults,
    required_string_columns,
    string_column_faults,
)
from binwright.operators.ranks import block_bounds, rank_by_hash, running_sum
from binwright.schemas import CELL_INFO, DTYPES, FEATURE_INFO, add_missing_fields
from binwright.session import freeze, written
from binwright.sources.base import (
    append_ingests,
    append_together,
    next_id,
    path_exists,
    read_table,
    scan,
    stored_rows,
)
from binwright.sources.reserve import reserve


CELLS_PER_BLOCK = 10_000  # cells whose counts lie together in a file: some ten million counts


@dataclass(frozen=True)
class Batch:
    """Rows of any number of input files, told apart by ``file``.

    ``obs`` (file, row_pos, obs_id, ...), ``var`` (file, col_pos, var_id, ...),
    ``x`` (file, row_pos, col_pos, value), ``uns`` (file, metadata map<string,string>).
    """

    obs: DataFrame
    var: DataFrame
    x: DataFrame
    uns: DataFrame | None = None

    @property
    def shapes(self) -> DataFrame:
        """``(file, n_obs, n_vars)``."""
        n_obs = self.obs.groupBy("file").agg(F.count(F.lit(1)).alias("n_obs"))
        n_vars = self.var.groupBy("file").agg(F.count(F.lit(1)).alias("n_vars"))
        return n_obs.join(n_vars, "file", "left").select("file", "n_obs", F.coalesce("n_vars", F.lit(0)).alias("n_vars"))

    def only(self, files: DataFrame) -> Batch:
        """The part of the batch that belongs to the given files."""

        files = freeze(files.select("file"))
        small = fits_broadcast(files)

        def kept(df, salt):
            return join_dimension(df, files, "file", "left_semi", salt_on=salt, fits=small)

        return Batch(
            kept(self.obs, "row_pos"), kept(self.var, "col_pos"), kept(self.x, ["row_pos", "col_pos"]),
            kept(self.uns, "file") if self.uns is not None else None,
        )

    def stored(self) -> Batch:
        """The batch with its cells, features and matrix as tables of the shared folder, for jobs that read them many times.

        Parquet has no columns without a type; they hold NULL only, so text does as well.
        """

        def kept(df, name):
            untyped = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
            return written(df.withColumns({c: F.col(f"`{c}`").cast("string") for c in untyped}) if untyped else df, name)

        return Batch(kept(self.obs, "batch_obs"), kept(self.var, "batch_var"), kept(self.x, "batch_x"), self.uns)


# -- ids ---------------------------------------------------------------------------------------

def reserve_blocks(shapes: DataFrame, first_ingest: int = 0, first_cell: int = 0, first_feature: int = 0) -> DataFrame:
    """``(file, n_obs, n_vars, ingest_id, cell_start, feature_start)``: one id block per file.

    Blocks follow the file order without gaps from the given ids on, which ``sources.reserve`` sets apart for one writer.
    """
    sized = running_sum(
        shapes.withColumn("_one", F.lit(1)), ["file"],
        {"ingest_id": "_one", "cell_start": "n_obs", "feature_start": "n_vars"},
    ).drop("_one")
    return freeze(sized.withColumns({
        "ingest_id": F.col("ingest_id") + first_ingest,
        "cell_start": F.col("cell_start") + first_cell,
        "feature_start": F.col("feature_start") + first_feature,
    }))


# -- SQL-backend rules -------------------------------------------------------------------------

_TECHNICAL = ["file", "row_pos", "col_pos", "obs_id", "var_id"]


def _to_schema(df: DataFrame, schema: T.StructType, assigned: dict) -> DataFrame:
    """Leftover columns as JSON, then assigned ids over input columns of the same name, then NULLs."""
    extra = sorted(set(df.columns) - set(schema.names) - set(_TECHNICAL) - {"_total"})
    kept = [c for c in df.columns if c in (*schema.names, *_TECHNICAL, "_total") and c != "metadata_extra"]
    shaped = df.select(*kept, leftover_json(extra).alias("metadata_extra"))
    return add_missing_fields(shaped.withColumns(assigned), schema)


def cell_rows(obs: DataFrame, x: DataFrame, blocks: DataFrame, mapping: dict[str, str] | None = None,
              tag: str | None = None) -> DataFrame:
    """Cell table rows: mapped columns, ids from the file's block, totals and leftover JSON.

    The total is the truncated sum of the cell's stored values.
    """
    totals = x.groupBy("file", "row_pos").agg(F.sum("value").cast("bigint").alias("_total"))
    mapped = map_columns(obs, mapping, "obs_id").join(totals, ["file", "row_pos"], "left")
    placed = blocks.select("file", F.col("ingest_id").alias("_ingest"), F.col("cell_start").alias("_start"))
    shaped = _to_schema(mapped, CELL_INFO, {"total_mrna_umis": F.coalesce("_total", F.lit(0)), "tag": F.lit(tag)})
    joined = join_dimension(shaped, placed, "file", salt_on="row_pos")
    return joined.withColumns({"id": F.col("_start") + F.col("row_pos"), "ingest_id": F.col("_ingest")}).select(
        "file", *CELL_INFO.names
    )


def feature_rows(var: DataFrame, blocks: DataFrame, mapping: dict[str, str] | None = None,
                 tag: str | None = None) -> DataFrame:
    """Feature table rows, as ``cell_rows``."""
    placed = blocks.select("file", F.col("ingest_id").alias("_ingest"), F.col("feature_start").alias("_start"))
    shaped = _to_schema(map_columns(var, mapping, "var_id"), FEATURE_INFO, {"tag": F.lit(tag)})
    joined = join_dimension(shaped, placed, "file", salt_on="col_pos")
    return joined.withColumns({"id": F.col("_start") + F.col("col_pos"), "ingest_id": F.col("_ingest")}).select(
        "file", *FEATURE_INFO.names
    )


def placed_counts(x: DataFrame, blocks: DataFrame, observed: Observation) -> DataFrame:
    """Non-zero counts with global ids, dealt by ingest and block of cells and in order of cell and feature.

    Ids of a file are its block start plus the position, so the big table is mapped in place. It moves once, to be written; that
    exchange and sort also show what the files must not hold: positions that occur twice (next to each other by then),
    values outside their file or without one, and NULL values. ``observed`` counts them while the rows are written.
    """
    wanted = blocks.select("file", "ingest_id", "cell_start", "feature_start", "n_obs", "n_vars")
    known = join_dimension(x.select("file", "row_pos", "col_pos", "value"), wanted, "file", "left", salt_on=["row_pos", "col_pos"])
    inside = F.col("row_pos").between(0, F.col("n_obs") - 1) & F.col("col_pos").between(0, F.col("n_vars") - 1) & F.col("value").isNotNull()
    numbered = known.select(
        "ingest_id", (F.col("cell_start") + F.col("row_pos")).alias("cell_id"), (F.col("feature_start") + F.col("col_pos")).alias("feature_id"),
        clean_count(F.col("value")).alias("raw_count"), F.coalesce(inside, F.lit(False)).alias("_inside"),
    ).withColumn("_block", F.call_function("div", F.col("cell_id"), F.lit(CELLS_PER_BLOCK)))
    cell = Window.partitionBy("ingest_id", "_block", "cell_id").orderBy("feature_id")
    again = F.coalesce(F.lag("feature_id").over(cell) == F.col("feature_id"), F.lit(False))
    seen = numbered.repartition("ingest_id", "_block").withColumn("_again", again).observe(
        observed, F.count_if(F.col("_again")).alias("repeated"), F.count_if(~F.col("_inside")).alias("misplaced")
    )
    return seen.filter("_inside AND raw_count <> 0").select("cell_id", "feature_id", "raw_count", "ingest_id")


def ingest_rows(uns: DataFrame | None, blocks: DataFrame, limit: int = METADATA_VALUE_LIMIT,
                keep: list[str] | None = None) -> DataFrame:
    """Ingest table rows with pruned metadata."""
    files = blocks.select("file", F.col("ingest_id").alias("id"))
    if uns is None:
        return files.withColumn("metadata_extra", F.lit("{}"))
    pruned = uns.select("file", prune_metadata(F.col("metadata"), limit, keep).alias("metadata_extra"))
    return files.join(pruned, "file", "left").withColumn("metadata_extra", F.coalesce("metadata_extra", F.lit("{}")))


def required_text_faults(batch: Batch, obs_mapping=None, var_mapping=None) -> DataFrame:
    """Faults of the required text columns after mapping, all files and both tables together."""
    obs = map_columns(batch.obs, obs_mapping, "obs_id")
    var = map_columns(batch.var, var_mapping, "var_id")
    cell_columns = [c for c in required_string_columns(CELL_INFO) if c != "metadata_extra"]
    feature_columns = [c for c in required_string_columns(FEATURE_INFO) if c != "metadata_extra"]
    return string_column_faults(obs, cell_columns, "obs").unionByName(
        string_column_faults(var, feature_columns, "var")
    )


def _place_faults(batch: Batch) -> DataFrame:
    """Faults of positions: those of cells and features are 0 to n - 1, those of values occur once."""
    return position_faults(batch.obs, "row_pos", "obs").unionByName(
        position_faults(batch.var, "col_pos", "var")
    ).unionByName(repeated_faults(batch.x))


def placement_faults(batch: Batch) -> DataFrame:
    """Faults that would give a count to another cell or lose it: positions, values outside their file, NULL values."""
    return _place_faults(batch).unionByName(matrix_faults(batch.x, freeze(batch.shapes), "placed"))


class _Faulty(Exception):
    """What was written must not be committed."""


def _append(spark, warehouse, batch, shapes, obs_mapping, var_mapping, tag, metadata_limit, metadata_keep) -> DataFrame:
    """Numbers, writes and commits all files; ``_Faulty`` where the written counts turn out to be misplaced."""
    shapes = freeze(shapes)
    sums = [F.count(F.lit(1)).alias("ingest_info"), F.sum("n_obs").alias("cell_info"), F.sum("n_vars").alias("feature_info")]
    sizes = {k: v or 0 for k, v in shapes.agg(*sums).first().asDict().items()}
    start = reserve(spark, warehouse, sizes, lambda: {t: next_id(spark, warehouse, t) for t in sizes})
    blocks = reserve_blocks(shapes, start["ingest_info"], start["cell_info"], start["feature_info"])
    observed = Observation()

    def check():
        if sum(observed.get.values()):
            raise _Faulty

    append_ingests(spark, warehouse, {
        "ingest_info": ingest_rows(batch.uns, blocks, metadata_limit, metadata_keep),
        "cell_info": cell_rows(batch.obs, batch.x, blocks, obs_mapping, tag),
        "feature_info": feature_rows(batch.var, blocks, var_mapping, tag),
        "raw_matrix_coo": placed_counts(batch.x, blocks, observed),
    }, placed=["raw_matrix_coo"], check=check)
    return blocks


def ingest_batch(spark: SparkSession, warehouse: str, batch: Batch, obs_mapping: dict[str, str] | None = None,
                 var_mapping: dict[str, str] | None = None, tag: str | None = None,
                 metadata_limit: int = METADATA_VALUE_LIMIT, metadata_keep: list[str] | None = None,
                 partial: bool = False) -> DataFrame:
    """Validates, maps and numbers every file of the batch and appends all of them at once.

    The narrow tables are validated before anything is written, the counts while they are written: only if none is misplaced,
    the commit follows. Otherwise all faults are listed per file, for which the counts are read again. A faulty file fails
    the batch. With ``partial`` the good files are committed and the error that lists the faults comes afterwards. Returns the id
    blocks of the committed files. What was written and not committed goes with ``sources.base.vacuum``.
    """
    how = (obs_mapping, var_mapping, tag, metadata_limit, metadata_keep)
    narrow = required_text_faults(batch, obs_mapping, var_mapping).unionByName(
        position_faults(batch.obs, "row_pos", "obs").unionByName(position_faults(batch.var, "col_pos", "var"))
    )
    if narrow.isEmpty():
        try:
            return _append(spark, warehouse, batch, batch.shapes, *how)
        except _Faulty:
            pass
    faults = freeze(required_text_faults(batch, obs_mapping, var_mapping).unionByName(placement_faults(batch)))
    found = faults.agg(
        F.count_distinct("file").alias("n_files"), F.coalesce(F.bool_or(F.col("file") == "*"), F.lit(False)).alias("all")
    ).first()
    if found["all"] or not partial:
        raise_on_faults(faults)
    shapes = freeze(batch.shapes.join(faults.select("file").distinct(), "file", "left_anti"))
    _append(spark, warehouse, batch.only(shapes), shapes, *how)
    raise IngestError(f"{found['n_files']} files were not ingested; see the fault table", faults)


# -- array-backend rules -----------------------------------------------------------------------

@dataclass(frozen=True)
class ArraySchema:
    """Declared obs columns ``(name, dtype, nullable)``, feature axis and matrix profile.

    ``features`` holds ``(feature_name, position, ...)`` with dense positions.
    """

    obs_columns: list[tuple[str, str, bool]]
    features: DataFrame
    profile: str = "count_matrix"
    is_subset: bool = True

    def obs_type(self) -> T.StructType:
        fields = [T.StructField("id", T.LongType(), False), T.StructField("obs_id", T.StringType(), False)]
        return T.StructType(fields + [T.StructField(n, DTYPES[d], nullable) for n, d, nullable in self.obs_columns])


MATRIX = T.StructType([
    T.StructField("cell_id", T.LongType(), False),
    T.StructField("feature_id", T.LongType(), False),
    T.StructField("value", T.DoubleType(), False),
])
REGISTRY = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("id", T.LongType(), False),
])


def sanitize_obs(obs: DataFrame, columns: list[tuple[str, str, bool]]) -> DataFrame:
    """Keys plus declared columns in declared order, cast.

    NULL text in a nullable column becomes ``unknown``, also where the whole column is absent; other
    missing nullable columns are NULL; missing required ones are skipped, validation reports them.
    """
    out = [F.col(c) for c in ("file", "row_pos", "obs_id") if c in obs.columns]
    for name, dtype, nullable in columns:
        kind = DTYPES[dtype]
        if name not in obs.columns and not nullable:
            continue
        value = F.col(name).cast(kind) if name in obs.columns else F.lit(None).cast(kind)
        if nullable and dtype == "string":
            value = F.coalesce(value, F.lit(STRING_NULL_FILL))
        out.append(value.alias(name))
    return obs.select(*out)


def sanitize(batch: Batch, schema: ArraySchema) -> Batch:
    """Only obs, features and the matrix survive, in the declared form."""
    var = batch.var.withColumnRenamed("var_id", "feature_name")
    return Batch(sanitize_obs(batch.obs, schema.obs_columns), align_features(var, schema.features), batch.x)


def batch_faults(batch: Batch, schema: ArraySchema) -> DataFrame:
    """All faults of a batch against a declared schema."""
    var = batch.var.withColumnRenamed("var_id", "feature_name")
    return collected_faults(
        batch.obs, batch.x, var, freeze(batch.shapes), schema.obs_columns, schema.features, schema.profile, schema.is_subset
    ).unionByName(_place_faults(batch))


def validate_and_sanitize(batch: Batch, schema: ArraySchema) -> Batch:
    """One error that lists every fault, or the sanitized batch."""
    raise_on_faults(batch_faults(batch, schema))
    return sanitize(batch, schema)


def first_file_axis(batch: Batch, schema: ArraySchema) -> Batch:
    """Sanitized batch whose matrix lies on the full feature axis of the schema."""
    clean = sanitize(batch, schema)
    return Batch(clean.obs, schema.features, expand_to_axis(clean.x, clean.var, schema.features))


def register_labels(labels: DataFrame, registry: DataFrame, first_id: int) -> DataFrame:
    """``(label, id)`` of labels that have no id yet; labels in the registry keep theirs.

    New ids follow a hash order of the label, taken without a single-task rank.
    """
    fresh = labels.select("label").distinct().join(registry.select("label"), "label", "left_anti")
    hashed = fresh.withColumn("_hash", F.conv(F.substring(F.md5("label"), 1, 15), 16, 10).cast("bigint"))
    ranked = rank_by_hash(hashed, "_hash", "label", "_rank")
    return ranked.select("label", (F.col("_rank") - 1 + F.lit(first_id)).cast("bigint").alias("id"))


def read_registry(spark: SparkSession, store: str, kind: str) -> DataFrame:
    return scan(spark, f"{store}/registry", REGISTRY).filter(F.col("kind") == kind).select("label", "id")


def register_batch(spark: SparkSession, store: str, batch: Batch) -> None:
    """Registers the cell and feature labels of all files before any matrix is written."""
    if not path_exists(spark, f"{store}/registry"):
        spark.createDataFrame([], REGISTRY).write.partitionBy("kind").parquet(f"{store}/registry")
    for kind, labels in (("obs", batch.obs.select(F.col("obs_id").alias("label"))),
                         ("var", batch.var.select(F.col("var_id").alias("label")))):
        known = read_registry(spark, store, kind)
        first = known.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("n")).first()["n"]
        fresh = register_labels(labels, known, first).withColumn("kind", F.lit(kind))
        fresh.write.mode("append").partitionBy("kind").parquet(f"{store}/registry")


def plan_partitions(files: DataFrame, total: int, batch_size: int) -> tuple[DataFrame, dict[str, int]]:
    """Files ``(file, position)`` with their ``partition_index``, and the plan's totals."""
    if batch_size <= 0:
        raise ValueError(f"ingest batch size must be positive, got {batch_size}")
    planned = files.withColumn("partition_index", F.call_function("div", F.col("position"), F.lit(batch_size)))
    n = -(-total // batch_size)
    return planned, {
        "total_files": total, "num_partitions": n,
        "last_partition_size": total - (n - 1) * batch_size if n else 0,
    }


def partition_files(planned: DataFrame, total: int, partition_index: int, batch_size: int) -> DataFrame:
    """Files of one partition; a count other than the plan's is an error."""
    start, end = block_bounds(total, partition_index, batch_size)
    chosen = planned.filter(F.col("partition_index") == partition_index)
    found = chosen.count()
    if found != end - start:
        raise ValueError(f"expected {end - start} files for partition {partition_index}, got {found}")
    return chosen


def _known(column: str, what: str, label: str):
    """The id in ``column``; a row without one is an error that names its label."""
    unknown = F.raise_error(F.concat(F.lit(f"unregistered {what}: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL"))))
    return F.coalesce(F.col(column), unknown.cast("bigint"))


# Fixed schemas of a store: which file and content an ingest is, and which cells' rows of older ingests it replaces.
FILES = T.StructType([
    T.StructField("ingest_id", T.LongType()), T.StructField("file", T.StringType()),
    T.StructField("content", T.LongType()), T.StructField("version", T.LongType()),
])
REPLACED = T.StructType([T.StructField("cell_id", T.LongType(), False), T.StructField("old_ingest_id", T.LongType(), False)])


def file_contents(batch: Batch) -> DataFrame:
    """``(file, content)``: a hash over all rows of a file, whatever their order. Sums and XORs are combined before they move."""

    def hashed(df: DataFrame, what: str) -> DataFrame:
        row = F.xxhash64(F.lit(what), *[F.col(f"`{c}`") for c in sorted(df.columns) if c != "file"])
        return df.select("file", row.alias("h"))

    every = hashed(batch.obs, "obs").unionByName(hashed(batch.var, "var")).unionByName(hashed(batch.x, "x"))
    parts = every.groupBy("file").agg(
        F.bit_xor("h").alias("x"), F.sum(F.shiftright("h", 32)).alias("s"), F.count(F.lit(1)).alias("n")
    )
    return parts.select("file", F.xxhash64("x", "s", "n").alias("content"))


def read_files(spark: SparkSession, store: str) -> DataFrame:
    """Committed ingests of a store with their file, content and version."""
    return stored_rows(spark, f"{store}/commits", FILES).select(*FILES.names)


def new_versions(spark: SparkSession, store: str, batch: Batch) -> DataFrame:
    """``(file, content, version, ingest_id)`` of the files that are new, or whose content differs from what was ingested last."""
    last = read_files(spark, store).groupBy("file").agg(
        F.max("version").alias("last"), F.max_by("content", "version").alias("held")
    )
    found = file_contents(batch).join(last, "file", "left").filter("held IS NULL OR held <> content")
    numbered = found.select("file", "content", F.coalesce(F.col("last") + 1, F.lit(0)).cast("bigint").alias("version"))
    return freeze(numbered.withColumn("ingest_id", F.xxhash64("file", "content", "version")))


def ingest_partition(spark: SparkSession, store: str, batch: Batch, schema: ArraySchema, partition_index: int = 0) -> DataFrame:
    """Validates, sanitizes and adds the files of one partition under their registered ids; returns the versions it added.

    A file is known by its name and content, whatever the partition or plan: the same content again adds nothing, other content
    is a new version. A cell has the rows of the file that brought it last (of one batch, the file whose name comes last): the
    commit of a version says which cells of older ones it replaces, and readers leave those rows out. Labels are unique inside the
    registry, so the joins that turn them into ids meet no hot key. Features and rows of a file are dimensions of the
    matrix, which only moves to be written. A label without an id, NULL too, and a value at a position that no
    label has are errors. The files are read once and written, then told apart, checked and placed from there.
    """
    batch = batch.stored()
    fresh = new_versions(spark, store, batch)
    if fresh.isEmpty():
        return fresh
    clean = validate_and_sanitize(batch.only(fresh), schema)
    ids = join_dimension(clean.obs, fresh.select("file", "ingest_id"), "file", salt_on="row_pos").join(
        read_registry(spark, store, "obs").withColumnRenamed("label", "obs_id"), "obs_id", "left"
    ).withColumn("id", _known("id", "obs label", "obs_id"))
    cells = freeze(ids)
    features = freeze(clean.var.select("file", "col_pos", F.col("feature_name").alias("label")).join(
        read_registry(spark, store, "var"), "label", "left"
    ).select("file", "col_pos", _known("id", "var label", "label").alias("feature_id")))
    rows = cells.select("file", "row_pos", F.col("id").alias("cell_id"), "ingest_id")
    placed = join_dimension(clean.x, features, ["file", "col_pos"], "left", salt_on="row_pos")
    placed = join_dimension(placed, rows, ["file", "row_pos"], "left", salt_on="col_pos").withColumn(
        "feature_id", _known("feature_id", "column of file", "file")
    ).withColumn("cell_id", _known("cell_id", "row of file", "file"))

    # Rows of the same cells in older ingests, and in files of this batch that come before the last one that has the cell.
    own = cells.groupBy("id").agg(F.max(F.struct("file", "ingest_id")).alias("last"))
    held = _live(read_table(spark, store, "obs", schema.obs_type(), with_ingest=True), read_replaced(spark, store), "id")
    older = held.select("id", F.col("ingest_id").alias("old_ingest_id")).unionByName(
        cells.select("id", F.col("ingest_id").alias("old_ingest_id")).distinct()
    )
    replaced = older.join(own, "id").filter(F.col("old_ingest_id") != F.col("last.ingest_id")).select(
        F.col("id").alias("cell_id"), "old_ingest_id", F.col("last.ingest_id").alias("ingest_id")
    )
    append_together(
        spark, store,
        {
            "obs": cells,
            "X": placed.select("cell_id", "feature_id", F.col("value").cast("double").alias("value"), "ingest_id"),
            "replaced": freeze(replaced),
        },
        {"obs": schema.obs_type(), "X": MATRIX, "replaced": REPLACED}, {"obs": "id", "X": "cell_id", "replaced": "cell_id"},
        commits=fresh.select("ingest_id", "file", "content", "version"),
    )
    return fresh


def read_replaced(spark: SparkSession, store: str) -> DataFrame:
    """``(cell_id, ingest_id)``: rows of a cell that a later ingest replaced."""
    return read_table(spark, store, "replaced", REPLACED).select("cell_id", F.col("old_ingest_id").alias("ingest_id")).distinct()


def _live(rows: DataFrame, replaced: DataFrame, cell: str) -> DataFrame:
    """Rows without those of replaced cells: few against all, so that ``rows`` stay where they are."""
    gone = replaced.withColumnRenamed("cell_id", cell)
    return join_dimension(rows, gone, [cell, "ingest_id"], "left_anti", salt_on=rows.columns[:2])


def read_store(spark: SparkSession, store: str, schema: ArraySchema) -> dict[str, DataFrame]:
    """Committed ``obs``, ``X`` and the feature axis with registered ids; a cell as the last file that brought it has it."""
    registered = read_registry(spark, store, "var").withColumnRenamed("label", "feature_name")
    replaced = read_replaced(spark, store)
    obs = read_table(spark, store, "obs", schema.obs_type(), with_ingest=True)
    x = read_table(spark, store, "X", MATRIX, with_ingest=True)
    return {
        "obs": _live(obs, replaced, "id").drop("ingest_id"),
        "X": _live(x, replaced, "cell_id").drop("ingest_id"),
        "var": schema.features.join(registered, "feature_name"),
    }
