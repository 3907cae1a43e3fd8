"""Joins between cells, ingests, features and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binwright.operators.counts import pruned_counts
from binwright.operators.dims import WORD, dealt, join_dimension, with_word
from binwright.operators.ranks import rank_by_value

EXAMPLES = 5  # names per file and fault


def cells_with_ingest(cells: DataFrame, ingests: DataFrame) -> DataFrame:
    """Cells whose ingest is known."""
    known = ingests.select(F.col("id").alias("ingest_id"))
    return join_dimension(cells, known, "ingest_id", salt_on="id")


def feature_map(source_features: DataFrame, wanted_features: DataFrame) -> DataFrame:
    """``(feature_id, extract_feature_id)``: source ids of the requested features, by ensemble id.

    Every ingest brings its own feature rows, so the source side can be large; the wanted side is
    the request.
    """
    source = source_features.select(F.col("id").alias("feature_id"), "ensemble_id")
    wanted = wanted_features.select("ensemble_id", F.col("id").alias("extract_feature_id"))
    return join_dimension(source, wanted, "ensemble_id", salt_on="feature_id").drop("ensemble_id")


def remap_features(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts of the mapped features, with the extract's feature id in place of the source id."""
    joined = join_dimension(counts, mapping, "feature_id", salt_on="cell_id")
    return joined.select("cell_id", F.col("extract_feature_id").alias("feature_id"), "raw_count")


def counts_of_cells(counts: DataFrame, cells: DataFrame, bin_column: str = "extract_bin") -> DataFrame:
    """Counts of the selected cells, each with the bin of its cell.

    Counts of other ingests and ranges of ids are not read (``pruned_counts``). Cells are as many as the extract holds, so this
    is a shuffle join, by ingest too where both sides have it. A cell has at most one count per feature, which bounds the
    rows of one key by the length of the feature axis.
    """
    keys = ["cell_id", *(["ingest_id"] if "ingest_id" in counts.columns and "ingest_id" in cells.columns else [])]
    bins = cells.select(F.col("id").alias("cell_id"), *keys[1:], bin_column)
    return pruned_counts(counts, cells).join(bins, keys).select("cell_id", "feature_id", "raw_count", bin_column)


def row_and_column_numbers(entries: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """``(row_num, col_num, value)`` of ``(cell_id, feature_id, value)``; an unknown id fails the job.

    ``rows`` holds ``(cell_id, row_num)``, ``columns`` holds ``(feature_id, col_num)``. The check
    rides on the left joins, so there is no second pass to look for unmatched ids.
    """
    placed = join_dimension(entries, columns, "feature_id", "left", salt_on="cell_id").join(rows, "cell_id", "left")

    def checked(number, name, key):
        message = F.concat(F.lit(f"Invalid {name}: "), F.col(key).cast("string"))
        return F.coalesce(F.col(number), F.raise_error(message).cast("bigint")).alias(number)

    return placed.select(
        checked("row_num", "cell id", "cell_id"), checked("col_num", "feature id", "feature_id"), "value"
    )


def unknown_ids(entries: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """``(kind, n_entries)``: entries whose cell or feature id is not part of the block."""
    features = join_dimension(entries, columns.select("feature_id"), "feature_id", "left_anti", salt_on="cell_id")
    cells = entries.join(rows.select("cell_id"), "cell_id", "left_anti")

    def counted(df, kind):
        return df.agg(F.count(F.lit(1)).alias("n_entries")).select(F.lit(kind).alias("kind"), "n_entries")

    return counted(cells, "cell").unionByName(counted(features, "feature"))


def positions_to_ids(x: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """Matrix positions replaced by ids: ``(cell_id, feature_id, value)``.

    ``obs`` needs ``(file, row_pos, id)`` and ``var`` ``(file, col_pos, id)``.
    """
    for name, df, needed in (("obs", obs, ["file", "row_pos", "id"]), ("var", var, ["file", "col_pos", "id"])):
        missing = [c for c in needed if c not in df.columns]
        if missing:
            raise KeyError(f"{name} lacks {', '.join(missing)}")
    features = var.select("file", "col_pos", F.col("id").alias("feature_id"))
    cells = obs.select("file", "row_pos", F.col("id").alias("cell_id"))
    placed = join_dimension(x, features, ["file", "col_pos"], salt_on="row_pos").join(cells, ["file", "row_pos"])
    return placed.select("cell_id", "feature_id", "value")


def local_index(df: DataFrame, group: str = "extract_bin", order: list[str] | None = None,
                out: str = "row_num") -> DataFrame:
    """0-based dense row number inside each bin; a bin holds at most its size in cells."""
    inside = Window.partitionBy(group).orderBy(*(order or ["id"]))
    return df.withColumn(out, F.row_number().over(inside).cast("bigint") - 1)


def feature_axis(features: DataFrame, order: str = "id") -> DataFrame:
    """Features with ``col_num``, their 0-based column in the order of ``order``."""
    return rank_by_value(features, order, "_rank").withColumn("col_num", F.col("_rank") - 1).drop("_rank")


def align_features(file_features: DataFrame, schema_features: DataFrame) -> DataFrame:
    """A file's features in file order with the columns of the schema's feature rows.

    Columns of the file other than its key and position are dropped: the schema wins.
    """
    keys = file_features.select("file", "col_pos", "feature_name")
    return join_dimension(keys, schema_features, "feature_name", "left", salt_on="col_pos")


def feature_set_faults(file_features: DataFrame, schema_features: DataFrame, is_subset: bool = True) -> DataFrame:
    """``(file, fault, n_features, examples)``: labels that are not text, unknown features, and missing ones when required.

    ``schema_features`` holds ``(feature_name, position)`` with dense positions. A label that is not text equals
    no feature; its type is the fault's example. The gaps between a file's own positions give what it misses, so
    files are never paired with features. A file's positions are masks of 64 each, and only names that are no feature are
    compared with each other, dealt by file and name.
    """
    axis = schema_features.select("feature_name", "position")
    kind = file_features.schema["feature_name"].dataType
    names = file_features.select("file", F.col("feature_name").cast("string").alias("feature_name"))
    if isinstance(kind, T.StringType):
        unknown = join_dimension(names, axis.select("feature_name"), "feature_name", "left_anti", salt_on="file")
        held = join_dimension(names, axis, "feature_name", salt_on="file").select("file", F.col("position").cast("bigint").alias("position"))
        faults = _fault_rows(_distinct_names(unknown), "unknown")
    else:
        held, names = None, _distinct_names(names)
        typed = names.groupBy("file").agg(F.count(F.lit(1)).alias("n_features"))
        faults = _fault_rows(names, "unknown").unionByName(typed.select(
            "file", F.lit("not text").alias("fault"), "n_features", F.array(F.lit(kind.simpleString())).alias("examples")
        ))
    if is_subset:
        return faults
    total = axis.count()
    end = names.select("file").distinct().withColumn("position", F.lit(total).cast("bigint"))  # closes the last gap
    words = with_word(end if held is None else held.unionByName(end), "position").groupBy("file", "_word").agg(F.bit_or("_bit").alias("mask"))
    inside = Window.partitionBy("file").orderBy("_word")
    gaps = words.withColumns({
        "start": F.coalesce(F.lag("_word").over(inside) + 1, F.lit(0)) * WORD,  # first place after the mask before
        "before": F.coalesce(F.sum(F.bit_count("mask")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    base = F.col("_word") * WORD
    few = F.least(base - 1, F.col("start") + EXAMPLES - 1)
    whole = F.when(F.col("start") <= few, F.sequence("start", few)).otherwise(F.array().cast("array<bigint>"))
    unset = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.when(F.call_function("getbit", F.col("mask"), i) == 0, base + i)),
        lambda p: p < total,
    )
    first_missing = F.slice(F.concat(whole, unset), 1, EXAMPLES)
    missing = gaps.groupBy("file").agg(
        (total + 1 - F.sum(F.bit_count("mask"))).cast("bigint").alias("n_features"),
        # Of the places missing so far, start - before, five in all.
        F.slice(F.sort_array(F.flatten(F.collect_list(F.when(F.col("start") - F.col("before") < EXAMPLES, first_missing)))), 1, EXAMPLES)
        .alias("positions"),
    ).filter("n_features > 0")
    first = missing.select("file", "n_features", F.explode("positions").alias("position"))
    named = join_dimension(first, axis, "position", salt_on="file")
    missing = named.groupBy("file", "n_features").agg(F.sort_array(F.collect_list("feature_name")).alias("examples"))
    return faults.unionByName(missing.select("file", F.lit("missing").alias("fault"), "n_features", "examples"))


def _distinct_names(names: DataFrame) -> DataFrame:
    return dealt(names, ["file", "feature_name"]).distinct()


def _fault_rows(df: DataFrame, fault: str) -> DataFrame:
    """Count per file and its first five names; the row limit is applied before the shuffle."""
    first = Window.partitionBy("file").orderBy("feature_name")
    examples = (
        df.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= EXAMPLES)
        .groupBy("file").agg(F.sort_array(F.collect_list("feature_name")).alias("examples"))
    )
    counted = df.groupBy("file").agg(F.count(F.lit(1)).alias("n_features"))
    return counted.join(examples, "file").select("file", F.lit(fault).alias("fault"), "n_features", "examples")


def expand_to_axis(x: DataFrame, file_features: DataFrame, schema_features: DataFrame) -> DataFrame:
    """Matrix entries moved onto the schema's feature axis.

    ``schema_features`` holds ``(feature_name, position)``. Features outside the schema are dropped;
    schema features without entries are implicit zeros of the long form.
    """
    axis = join_dimension(
        file_features.select("file", "col_pos", "feature_name"),
        schema_features.select("feature_name", "position"),
        "feature_name",
        salt_on="file",
    ).drop("feature_name")
    placed = join_dimension(x, axis, ["file", "col_pos"], salt_on="row_pos")
    return placed.select("file", "row_pos", F.col("position").alias("col_pos"), "value")
