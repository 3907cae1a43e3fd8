"""Extract bins: sparse blocks of cells by features, one output per bin."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binwright.functions import fill_for_extract, sparse_indices, sparse_values
from binwright.operators.bins import grouped_bins
from binwright.operators.counts import pack_selected
from binwright.operators.dims import fits_broadcast, join_dimension
from binwright.operators.filters import where
from binwright.operators.joins import feature_axis, local_index
from binwright.operators.projection import (
    keep_existing,
    keep_existing_or_all,
    ordered_feature_subset,
    read_bins,
)
from binwright.operators.ranks import bin_names, random_bins
from binwright.plans.prepare import check_feature_ids
from binwright.session import freeze, setting, written
from binwright.sources.base import path_exists, remove_folders
from binwright.sources.sinks import (
    EXTRACT_METADATA,
    PACKED_COUNTS,
    PARTITION_BINS,
    PARTITION_SIZE,
    read_binned,
    read_bucketed,
    write_bins,
)

# Tables bucketed or dealt by a part of the join's keys need no exchange. Fixed value of Spark's.
BUCKETS_SUFFICE = ("spark.sql.requireAllClusterKeysForCoPartition", "false")
# Tasks that list the folders of bins: Spark starts one for each folder, up to 10,000. Fixed value.
LISTING_TASKS = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "64")


def drop_all_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without the given columns that hold no value at all; decided once, so all bins agree."""
    if not columns:
        return df
    held = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if held[c] == 0])


def fill_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL text becomes the empty string, NULL numbers become NaN."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: fill_for_extract(c, df.schema[c].dataType) for c in present}) if present else df


def category_table(metadata: DataFrame) -> DataFrame:
    """``(column_name, value, code)`` of the category lists of an extract."""
    lists = metadata.select(F.explode("category_metadata").alias("column_name", "values"))
    coded = lists.select("column_name", F.posexplode("values").alias("code", "value"))
    return coded.select("column_name", "value", F.col("code").cast("int").alias("code"))


def encode_categories(df: DataFrame, categories: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<column>_code``; a value outside the shared list becomes NULL, code and value.

    Lists are limited when they are made, so their table is small; its size is checked once.
    """
    small = fits_broadcast(categories)
    for column in columns:
        codes = categories.filter(F.col("column_name") == column).select(
            F.col("value").alias(column), F.col("code").alias(f"{column}_code")
        )
        coded = join_dimension(df, codes, column, "left", salt_on="id", fits=small)
        df = coded.withColumn(column, F.when(F.col(f"{column}_code").isNotNull(), F.col(column)))
    return df


def sparse_blocks(cells: DataFrame, packed: DataFrame, n_features: int, order: list[str]) -> DataFrame:
    """One row per cell with its sparse counts and its row number in the bin.

    ``packed`` holds ``(extract_bin, cell_id, feature_data)`` with column numbers as feature ids.
    Cells and packed counts are brought together by bin in a single shuffle, instead of a join on
    the cell id and a second shuffle for the output. A count of an unknown cell or a feature outside
    the axis fails the job; a cell without counts has empty arrays.
    """
    describing = [c for c in cells.columns if c not in ("extract_bin", "id", "bin_bucket")]
    entry = "array<struct<feature_id:bigint,raw_counts:bigint>>"
    left = cells.select(
        "extract_bin", "id", F.struct(F.lit(True).alias("_known"), *describing).alias("cell"),
        F.lit(None).cast(entry).alias("feature_data"),
    )
    right = packed.select(
        "extract_bin", F.col("cell_id").alias("id"), F.lit(None).cast(left.schema["cell"].dataType).alias("cell"),
        F.col("feature_data").cast(entry).alias("feature_data"),
    )
    together = left.unionByName(right).repartition(F.col("extract_bin")).groupBy("extract_bin", "id").agg(
        F.first("cell", ignorenulls=True).alias("cell"), F.flatten(F.collect_list("feature_data")).alias("entries")
    )

    def column_number(e):
        known = (e["feature_id"] >= 0) & (e["feature_id"] < n_features)
        message = F.concat(F.lit("Invalid feature id: "), e["feature_id"].cast("string"))
        return F.when(known, e["feature_id"]).otherwise(F.raise_error(message).cast("bigint"))

    unknown_cell = F.raise_error(F.concat(F.lit("Invalid cell id: "), F.col("id").cast("string"))).cast("boolean")
    placed = F.array_sort(F.transform(
        "entries", lambda e: F.struct(column_number(e).alias("col_num"), e["raw_counts"].alias("value"))
    ))
    checked = together.filter(F.coalesce(F.col("cell").getField("_known"), unknown_cell))
    rows = checked.select("extract_bin", "id", *[F.col("cell")[c].alias(c) for c in describing], placed.alias("entries"))
    inside = Window.partitionBy("extract_bin").orderBy(*order)
    return rows.select(
        "extract_bin", (F.row_number().over(inside).cast("bigint") - 1).alias("row_num"), "id", *describing,
        sparse_indices(F.col("entries")).alias("indices"), sparse_values(F.col("entries")).alias("values"),
        F.lit(n_features).cast("bigint").alias("n_features"),
    )


def assemble(cells: DataFrame, packed: DataFrame, n_features: int) -> DataFrame:
    """``sparse_blocks`` of cells and packed counts that both have their row in the bin, joined by it.

    ``packed`` is sorted by feature in each row. Where both sides are bucketed by ``bin_group`` or dealt by ``extract_bin``, neither
    moves, and the order of the join is that of the output.
    """
    grouped = ["bin_group"] if "bin_group" in cells.columns and "bin_group" in packed.columns else []
    keys = ["extract_bin", "row_num", *grouped]
    describing = [c for c in cells.columns if c not in (*keys, "id", "bin_bucket", "bin_group")]
    left = cells.select(*keys, "id", *describing)
    right = packed.select(*keys, F.col("feature_data").alias("entries"))

    def column_number(e):
        known = (e["feature_id"] >= 0) & (e["feature_id"] < n_features)
        message = F.concat(F.lit("Invalid feature id: "), e["feature_id"].cast("string"))
        return F.when(known, e["feature_id"]).otherwise(F.raise_error(message).cast("bigint"))

    none = F.array().cast("array<struct<feature_id:bigint,raw_counts:bigint>>")
    placed = F.transform(
        F.coalesce("entries", none), lambda e: F.struct(column_number(e).alias("col_num"), e["raw_counts"].alias("value"))
    )
    return left.join(right.hint("merge"), keys, "left").withColumn("entries", placed).select(
        "extract_bin", "row_num", "id", *describing,
        sparse_indices(F.col("entries")).alias("indices"), sparse_values(F.col("entries")).alias("values"),
        F.lit(n_features).cast("bigint").alias("n_features"),
    )


def extract_bins(spark: SparkSession, path: str, output: str, start_bin: int | None = None,
                 end_bin: int | None = None, obs_columns: list[str] | None = None,
                 partition_bins: int = PARTITION_BINS, partition_size: int = PARTITION_SIZE) -> DataFrame:
    """Writes the bins of a prepared extract, all of them unless a range is given; returns a reader."""
    metadata = spark.read.schema(EXTRACT_METADATA).json(f"{path}/metadata")
    n_features = check_feature_ids(read_binned(spark, f"{path}/feature_info"))
    buckets = spark.read.schema("buckets bigint").json(f"{path}/layout").first()["buckets"]
    cells = read_bucketed(spark, f"{path}/cell_info", read_binned(spark, f"{path}/cell_info").schema, buckets)
    packed = read_bucketed(spark, f"{path}/count_matrix", PACKED_COUNTS, buckets)
    fixed = ["extract_bin", "row_num", "bin_group", "id", "ingest_id", "shuffle_key"]
    described = [c for c in cells.columns if c not in (*fixed, "bin_bucket")]
    wanted = described if obs_columns is None else [c for c in obs_columns if c in described]
    # Decided on the whole extract, so that bins written by different runs have the same columns.
    cells = drop_all_null(cells.select(*fixed, *wanted, "bin_bucket"), wanted)
    bins = None
    if start_bin is not None or end_bin is not None:
        low = start_bin or 0
        high = metadata.first()["total_bins"] - 1 if end_bin is None else end_bin
        bins = (low, high + 1)
        cells, packed = (read_bins(t, low, high, None, partition_bins, partition_size) for t in (cells, packed))
    kept = [c for c in wanted if c in cells.columns]
    categories = category_table(metadata)
    listed = {r["column_name"] for r in categories.select("column_name").distinct().collect()}
    coded = [c for c in kept if c in listed]
    cells = encode_categories(fill_nulls(cells, [c for c in kept if c not in coded]), categories, coded)

    features = read_binned(spark, f"{path}/feature_info")
    blocks = assemble(cells, packed, n_features)
    return _write(blocks, features.withColumn("col_num", F.col("id")), output, cells, bins)


def _write(blocks: DataFrame, features: DataFrame, output: str, cells: DataFrame | None = None, bins: tuple[int, int] | None = None) -> DataFrame:
    """Bins below ``bins`` and their common feature axis below ``features``; reads the output's bins back.

    A run over the bins ``[start, end)`` replaces these and keeps those of other runs; of its own, those that ``cells`` has no
    rows of any more go. A range without cells gives no rows rather than an error. The rows of a bin must lie together before they are
    joined: the join of ``assemble`` must not deal them anew by row, or each task would write a file of each bin.
    """
    spark = blocks.sparkSession
    others = bins is not None and path_exists(spark, f"{output}/bins")
    features.write.mode("overwrite").parquet(f"{output}/features")
    with setting(spark, *BUCKETS_SUFFICE):
        write_bins(blocks, f"{output}/bins", placed=True, keep_others=others)
    if others:
        held = {r["extract_bin"] for r in cells.select("extract_bin").distinct().collect()}  # bins of one run
        remove_folders(spark, f"{output}/bins", lambda name: _stale(name, bins, held))
    with setting(spark, *LISTING_TASKS):
        return spark.read.schema(blocks.schema).parquet(f"{output}/bins")


def _stale(folder: str, bins: tuple[int, int], held: set[int]) -> bool:
    """Whether a folder ``extract_bin=n`` is of a bin of the range that holds no cells."""
    name, _, value = folder.partition("=")
    return name == "extract_bin" and value.isdigit() and bins[0] <= int(value) < bins[1] and int(value) not in held


def requested_features(features: DataFrame, axis: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The feature axis with its wanted describing columns, all of them when none exists."""
    described = keep_existing_or_all(features, columns).withColumnRenamed("id", "feature_id")
    return join_dimension(described, axis, "feature_id", salt_on="feature_id")


def requested_axis(features: DataFrame, column: str | None, values: list[str] | None) -> DataFrame:
    """``(feature_id, col_num)``: requested features in request order, else all by id."""
    if column and values:
        axis = feature_axis(ordered_feature_subset(features, column, values), "position")
    else:
        axis = feature_axis(features.select("id"))
    return freeze(axis.select(F.col("id").alias("feature_id"), "col_num"))


def blocks_of_bins(binned: DataFrame, counts: DataFrame, features: DataFrame, axis: DataFrame, obs_columns: list[str] | None = None) -> DataFrame:
    """Sparse blocks straight from base tables, for written cells with ``extract_bin`` and ``row_num``: they are read several times.

    Counts move twice: by cell, where they are packed, and packed, by bin. The ingest of a cell tells which partitions of the
    counts are read; it is part of the output only where ``obs_columns`` (all if None) name it.
    """
    mapping = axis.select("feature_id", F.col("col_num").alias("extract_feature_id"))
    packed = pack_selected(counts, binned, features, mapping, ["extract_bin", "row_num"])
    # Dealt here rather than by the join, whose partitions might be split and with them a bin.
    described = binned if obs_columns is None or "ingest_id" in obs_columns else binned.drop("ingest_id")
    return assemble(described.repartition("extract_bin"), packed.repartition("extract_bin"), axis.count())


def extract_grouped(cells: DataFrame, counts: DataFrame, features: DataFrame, output: str, keys: list[str],
                    bin_size: int, filters: Mapping | None = None, obs_columns: list[str] | None = None,
                    feature_column: str | None = None, feature_values: list[str] | None = None,
                    feature_columns: list[str] | None = None, bins: tuple[int, int] | None = None) -> DataFrame:
    """Bins of one group each, cells in id order; writes them and returns a reader.

    ``bins`` limits the run to the bins ``[start, end)``, for work split over several runs.
    """
    binned = _bin_slice(grouped_bins(where(cells, filters), keys, bin_size), bins)
    kept = keep_existing(binned, None if obs_columns is None else [*obs_columns, "extract_bin", "ingest_id"])
    kept = written(local_index(kept, order=["id"]), "binned_cells")
    axis = requested_axis(features, feature_column, feature_values)
    return _write(
        blocks_of_bins(kept, counts, features, axis, obs_columns), requested_features(features, axis, feature_columns), output,
        kept, bins,
    )


def _bin_slice(binned: DataFrame, bins: tuple[int, int] | None) -> DataFrame:
    if bins is None:
        return binned
    return binned.filter((F.col("extract_bin") >= bins[0]) & (F.col("extract_bin") < bins[1]))


def shuffle_into_bins(cells: DataFrame, bin_size: int, seed: int, total: int, shuffle_names: bool = True) -> DataFrame:
    """All cells permuted by a seeded hash, cut into bins that carry their output names.

    The permutation is global; ``extract_bin`` is the output name.
    """
    permuted = random_bins(cells, bin_size, seed)
    if not shuffle_names:
        return permuted
    n_bins = -(-total // bin_size)
    names = bin_names(cells.sparkSession.range(n_bins).withColumnRenamed("id", "extract_bin"), n_bins, seed)
    return join_dimension(permuted, names, "extract_bin", salt_on="id").drop("extract_bin").withColumnRenamed(
        "output_bin", "extract_bin"
    )


def extract_randomized(cells: DataFrame, counts: DataFrame, features: DataFrame, output: str, bin_size: int,
                       seed: int, filters: Mapping | None = None, obs_columns: list[str] | None = None,
                       feature_column: str | None = None, feature_values: list[str] | None = None,
                       feature_columns: list[str] | None = None, bins: tuple[int, int] | None = None,
                       shuffle_names: bool = True) -> DataFrame:
    """Randomly composed bins in one job; the shuffle takes the place of temporary range files.

    ``bins`` limits the run to the output bins ``[start, end)``.
    """
    from binwright.plans.curriculum import count_selected

    found = where(cells, filters)
    binned = shuffle_into_bins(found, bin_size, seed, count_selected(found, filters), shuffle_names)
    binned = _bin_slice(binned, bins)
    kept = keep_existing(binned, None if obs_columns is None else [*obs_columns, "extract_bin", "shuffle_key", "ingest_id"])
    kept = written(local_index(kept, order=["shuffle_key", "id"]), "binned_cells")
    axis = requested_axis(features, feature_column, feature_values)
    return _write(
        blocks_of_bins(kept, counts, features, axis, obs_columns),
        requested_features(features, axis, feature_columns), output, kept, bins,
    )


def union_pieces(pieces: list[DataFrame]) -> DataFrame:
    """Pieces of an extract along the cells; columns missing in a piece are NULL."""
    if not pieces:
        raise ValueError("no pieces to unite")
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece, allowMissingColumns=True)
    return out
