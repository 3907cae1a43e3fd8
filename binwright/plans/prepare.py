"""Prepare an extract: binned cells, packed counts, feature axis and metadata as tables."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binwright.errors import EmptySelectionError
from binwright.functions import category_key, json_scalars
from binwright.operators.aggregates import extract_summary
from binwright.operators.bins import CATEGORY_KEY, category_bins
from binwright.operators.counts import pack_selected
from binwright.operators.explore import CATEGORY_LIMIT_EXTRACT, category_lists
from binwright.operators.filters import where
from binwright.operators.joins import cells_with_ingest, feature_map, local_index
from binwright.operators.projection import select_cell_columns
from binwright.operators.ranks import random_bins, with_shuffle_key
from binwright.schemas import EXTRACT_FEATURE_INFO
from binwright.session import written
from binwright.sources.base import scan
from binwright.sources.sinks import (
    EXTRACT_METADATA,
    PARTITION_BINS,
    PARTITION_SIZE,
    bucket_count,
    read_binned,
    write_bucketed,
    write_features,
    write_metadata,
)


@dataclass(frozen=True)
class ExtractSpec:
    """What to extract. ``bin_keys`` empty means bins of random cells."""

    bin_size: int
    seed: int = 0
    filters: Mapping | None = None
    obs_columns: list[str] = field(default_factory=list)
    metadata_columns: list[str] = field(default_factory=list)
    bin_keys: list[str] = field(default_factory=list)
    category_limit: int = CATEGORY_LIMIT_EXTRACT
    partition_bins: int = PARTITION_BINS
    partition_size: int = PARTITION_SIZE

    def __post_init__(self):
        if self.bin_size <= 0:
            raise ValueError(f"extract bin size must be greater than 0, got {self.bin_size}")


def select_cells(cells: DataFrame, ingests: DataFrame, spec: ExtractSpec) -> DataFrame:
    """Filtered cells of known ingests with the chosen columns and what binning needs."""
    found = cells_with_ingest(where(cells, spec.filters), ingests)
    extra = dict(json_scalars("metadata_extra", spec.metadata_columns)) if spec.metadata_columns else {}
    if spec.bin_keys:
        extra[CATEGORY_KEY] = category_key(spec.bin_keys)
    chosen = select_cell_columns(found, spec.obs_columns).columns
    wide = with_shuffle_key(found.withColumns(extra) if extra else found, spec.seed)
    return wide.select(*dict.fromkeys([*chosen, *extra, "shuffle_key"]))


def bin_cells(selected: DataFrame, spec: ExtractSpec) -> DataFrame:
    """Adds ``extract_bin``: random bins, or bins of one category each."""
    if spec.bin_keys:
        return category_bins(selected, spec.bin_size).drop(CATEGORY_KEY)
    return random_bins(selected.drop("shuffle_key"), spec.bin_size, spec.seed)


def count_matrix(counts: DataFrame, source_features: DataFrame, wanted: DataFrame, cells: DataFrame,
                 carried: list[str] | None = None) -> DataFrame:
    """Packed counts of the requested features and selected cells; rows keep the ``carried`` columns of their cell.

    Of the count table only the ingests and ranges of ids that hold the cells are read, and counts move once. ``cells`` is
    read several times: pass a written table.
    """
    mapping = written(feature_map(source_features, wanted), "feature_map")
    return pack_selected(counts, cells, source_features, mapping, carried or ["extract_bin"])


def number_features(spark: SparkSession, features: list[tuple[str, str]]) -> DataFrame:
    """Requested ``(symbol, ensemble_id)`` pairs numbered from 0 in request order."""
    rows = [(i, symbol, ensemble_id) for i, (symbol, ensemble_id) in enumerate(features)]
    return spark.createDataFrame(rows, "id bigint, symbol string, ensemble_id string")


def check_feature_ids(wanted: DataFrame) -> int:
    """Number of requested features; their ids must be ``0..n-1``, because an id is a column."""
    row = wanted.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi")
    ).first()
    if row["n"] == 0 or (row["lo"], row["hi"], row["d"]) != (0, row["n"] - 1, row["n"]):
        raise ValueError("requested features must be numbered 0..n-1 without gaps or repeats")
    return row["n"]


def extract_metadata(cells: DataFrame, spec: ExtractSpec) -> DataFrame:
    """One row: bin and cell totals, filters, bin size and the category lists."""
    lists = category_lists(cells.drop("bin_bucket"), spec.category_limit)
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("column_name", "categories"))))
    document = lists.agg(entries.alias("category_metadata")).withColumn("_one", F.lit(1))
    totals = extract_summary(cells).withColumn("_one", F.lit(1))
    filters = json.dumps(dict(spec.filters)) if spec.filters else None
    return totals.join(document, "_one").select(
        "total_bins", "last_bin_size", "total_cells", F.lit(filters).cast("string").alias("filters"),
        F.lit(spec.bin_size).cast("bigint").alias("extract_bin_size"), "category_metadata",
    )


def prepare_extract(tables: Mapping[str, DataFrame], wanted: DataFrame, path: str, spec: ExtractSpec) -> DataFrame:
    """Writes the tables of an extract below ``path`` and returns its metadata row.

    ``tables`` holds cell_info, ingest_info, feature_info and raw_matrix_coo (``sources.base.read_tables``: counts that carry
    ``ingest_id`` are read by ingest). Later steps read the written cell table, so binning runs once. Cells and counts are
    bucketed alike by bin, so that ``extract_bins`` joins them without moving either.
    """
    spark = wanted.sparkSession
    write_features(wanted, f"{path}/feature_info")
    wanted = scan(spark, f"{path}/feature_info", EXTRACT_FEATURE_INFO)
    check_feature_ids(wanted)

    binned = written(bin_cells(select_cells(tables["cell_info"], tables["ingest_info"], spec), spec), "binned_cells")
    total_bins = extract_summary(binned).first()["total_bins"]
    if not total_bins:
        raise EmptySelectionError("no cells match the filters")
    buckets = bucket_count(total_bins, spec.partition_size)
    write_metadata(spark.range(1).select(F.lit(buckets).alias("buckets")), f"{path}/layout")
    # Rows are numbered here, on the narrow table; the counts get the number with the bin.
    write_bucketed(local_index(binned, order=["shuffle_key", "id"]), f"{path}/cell_info", buckets, spec.partition_bins, spec.partition_size)
    cells = read_binned(spark, f"{path}/cell_info")
    packed = count_matrix(tables["raw_matrix_coo"], tables["feature_info"], wanted, cells, ["extract_bin", "row_num"])
    write_bucketed(packed, f"{path}/count_matrix", buckets, spec.partition_bins, spec.partition_size)
    write_metadata(extract_metadata(cells, spec), f"{path}/metadata")
    return spark.read.schema(EXTRACT_METADATA).json(f"{path}/metadata")
