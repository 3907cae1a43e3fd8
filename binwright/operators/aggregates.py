"""Aggregations over cells, counts and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binwright.operators.counts import pack_entries


def extract_summary(cells: DataFrame, bin_column: str = "extract_bin") -> DataFrame:
    """One row ``(total_bins, last_bin_size, total_cells)`` from one scan."""
    sizes = cells.groupBy(bin_column).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(bin_column).alias("total_bins"),
        F.coalesce(F.max_by("n", bin_column), F.lit(0)).alias("last_bin_size"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_cells"),
    )


def cell_count_of(summary: DataFrame, bin_size: int | None) -> DataFrame:
    """Adds ``cell_count``: the stored total, else what full bins and the last bin add up to."""
    from_bins = F.lit(bin_size or 0) * (F.col("total_bins") - 1) + F.col("last_bin_size")
    return summary.withColumn(
        "cell_count",
        F.when(F.col("total_cells") > 0, F.col("total_cells"))
        .when(F.col("total_bins") > 0, from_bins)
        .otherwise(F.lit(0)).cast("bigint"),
    )


def cell_totals(counts: DataFrame, keys: list[str] | None = None, value: str = "raw_count") -> DataFrame:
    """Sum of a cell's values as ``total_mrna_umis``."""
    return counts.groupBy(*(keys or ["cell_id"])).agg(F.sum(value).cast("bigint").alias("total_mrna_umis"))


def with_cell_totals(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """Cells with ``total_mrna_umis``; a cell without counts has 0."""
    totals = cell_totals(counts).withColumnRenamed("cell_id", "id")
    return cells.join(totals, "id", "left").withColumn("total_mrna_umis", F.coalesce("total_mrna_umis", F.lit(0)))


def pack_counts(counts: DataFrame, bin_column: str = "extract_bin") -> DataFrame:
    """Counts packed per cell: ``(extract_bin, cell_id, feature_data)``, sorted by feature.

    The rows already lie together by cell id after the join that attached the bins, so grouping
    moves nothing. Every cell has one row; its array holds one entry per feature that the cell has a count of.
    """
    return pack_entries(counts, [bin_column, "cell_id"])


def group_bin_statistics(chunked: DataFrame, keys: list[str], id_column: str = "id") -> DataFrame:
    """Per group and chunk: smallest and largest id and the number of cells."""
    return chunked.groupBy(*keys, "chunk").agg(
        F.min(id_column).alias("id_min"), F.max(id_column).alias("id_max"), F.count(F.lit(1)).alias("cell_count")
    )
