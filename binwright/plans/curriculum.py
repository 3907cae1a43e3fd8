"""Plans of an extract: id ranges and shuffled bins, or bins that hold one group each."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binwright.errors import EmptySelectionError
from binwright.functions import group_label
from binwright.operators.bins import grouped_bins
from binwright.operators.filters import where
from binwright.operators.projection import ordered_feature_subset
from binwright.operators.ranks import bin_names, contiguous_ranges, permute_keep_last


class GroupedPlan(NamedTuple):
    bins: DataFrame
    summary: DataFrame
    features: DataFrame | None


class RandomizedPlan(NamedTuple):
    ranges: DataFrame
    bin_names: DataFrame
    summary: DataFrame
    features: DataFrame | None


def count_selected(found: DataFrame, filters: Mapping | None) -> int:
    total = found.count()
    if total == 0:
        raise EmptySelectionError(f"no cells match the filters: {dict(filters or {})}")
    return total


def _features(features: DataFrame | None, column: str | None, values: list[str] | None) -> DataFrame | None:
    if features is None or not column or not values:
        return None
    return ordered_feature_subset(features, column, values)


def grouped_plan(cells: DataFrame, keys: list[str], bin_size: int, filters: Mapping | None = None,
                 features: DataFrame | None = None, feature_column: str | None = None,
                 feature_values: list[str] | None = None) -> GroupedPlan:
    """Bins ``(bin_index, group_key, keys, id_min, id_max, cell_count)`` in key order.

    Cells with a NULL key are in no bin; the summary says how many.
    """
    if bin_size <= 0:
        raise ValueError(f"bin size must be positive, got {bin_size}")
    if not keys:
        raise ValueError("grouping needs at least one key column")
    found = where(cells, filters).select("id", *keys)
    total = count_selected(found, filters)
    bins = (
        grouped_bins(found, keys, bin_size, out="bin_index").groupBy("bin_index", *keys)
        .agg(F.min("id").alias("id_min"), F.max("id").alias("id_max"), F.count(F.lit(1)).alias("cell_count"))
        .select("bin_index", group_label(keys).alias("group_key"), *keys, "id_min", "id_max", "cell_count")
    )
    summary = bins.agg(
        F.count(F.lit(1)).alias("num_bins"),
        F.coalesce(F.max_by("cell_count", "bin_index"), F.lit(0)).alias("last_bin_size"),
        F.coalesce(F.sum("cell_count"), F.lit(0)).alias("total_cells"),
    ).withColumns({
        "n_null_key": F.lit(total).cast("bigint") - F.col("total_cells"),
        "extract_bin_size": F.lit(bin_size).cast("bigint"),
    })
    return GroupedPlan(bins, summary, _features(features, feature_column, feature_values))


def randomized_plan(cells: DataFrame, range_size: int, bin_size: int, seed: int = 0, filters: Mapping | None = None,
                    shuffle_ranges: bool = True, shuffle_bins: bool = True, features: DataFrame | None = None,
                    feature_column: str | None = None, feature_values: list[str] | None = None) -> RandomizedPlan:
    """Contiguous id ranges in (shuffled) reading order, bin names, and one summary row."""
    for name, size in (("range_size", range_size), ("extract_bin_size", bin_size)):
        if size <= 0:
            raise ValueError(f"{name} must be positive, got {size}")
    found = where(cells, filters).select("id")
    total = count_selected(found, filters)
    n_ranges, n_bins = -(-total // range_size), -(-total // bin_size)

    ranges = contiguous_ranges(found, range_size)
    if shuffle_ranges:
        ranges = permute_keep_last(ranges, "range_index", n_ranges, seed, "read_order")
    else:
        ranges = ranges.withColumn("read_order", F.col("range_index"))
    bins = cells.sparkSession.range(n_bins).withColumnRenamed("id", "extract_bin")
    names = bin_names(bins, n_bins, seed if shuffle_bins else None)
    last = total - (n_bins - 1) * bin_size
    summary = cells.sparkSession.createDataFrame(
        [(total, range_size, n_ranges, bin_size, n_bins, last)],
        "total_cells bigint, range_size bigint, num_ranges bigint, extract_bin_size bigint, num_bins bigint, "
        "last_bin_size bigint",
    )
    return RandomizedPlan(ranges, names, summary, _features(features, feature_column, feature_values))
