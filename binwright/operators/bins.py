"""Bins that hold cells of one category only, numbered without gaps over all categories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binwright.functions import category_key
from binwright.operators.ranks import (
    chunk_of,
    hash_bucket,
    rank_in_groups,
    running_sum,
    split_hot_groups,
    with_shuffle_key,
    with_value_bucket,
)
from binwright.session import default_buckets

CATEGORY_KEY = "extract_bin_category_key"


def _with_key(df: DataFrame, key: str) -> DataFrame:
    """Adds a NULL-free copy ``_key`` of the key, which sorts NULL first."""
    return df.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit("")))


def _by_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("_bucket", hash_bucket(F.col("shuffle_key"), default_buckets(df.sparkSession)))


def rank_in_category(df: DataFrame, key: str = CATEGORY_KEY, out: str = "rn") -> DataFrame:
    """1-based rank by ``(shuffle_key, id)`` inside each category; all NULL keys are one category."""
    return rank_in_groups(_with_key(df, key), ["_key"], ["shuffle_key", "id"], out, _by_hash).drop("_key")


def chunk_in_category(df: DataFrame, bin_size: int, key: str = CATEGORY_KEY) -> DataFrame:
    """Adds ``rn`` and its 0-based chunk ``chunk_index`` inside the category."""
    return rank_in_category(df, key).withColumn("chunk_index", chunk_of(F.col("rn"), bin_size))


def _dense_bins(df: DataFrame, keys: list[str], order: list[str], bin_size: int, out: str,
                bucketize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bin number of every row: bins of all smaller keys, plus the row's chunk inside its key.

    Rows are shuffled once: the table of first bins (and offsets of split groups) and the window
    share one partitioning on (keys, bucket), or on the keys alone when no group had to be split.
    """
    if bin_size <= 0:
        raise ValueError(f"bin size must be positive, got {bin_size}")
    groups = split_hot_groups(df, keys, bucketize)
    bins = F.ceil(F.col("_n") / F.lit(bin_size)).cast("bigint")
    first_bin = running_sum(groups.sizes.select(*keys, bins.alias("_bins")), keys, {"_first_bin": "_bins"}).drop("_bins")
    if groups.offsets is None:
        on, starts = keys, first_bin.withColumn("_offset", F.lit(0))
    else:
        on, starts = [*keys, "_bucket"], groups.offsets.join(first_bin, keys)
    inside = F.row_number().over(Window.partitionBy(*on).orderBy(*order)).cast("bigint")
    return (
        groups.rows.join(starts, on)
        .withColumn("_rn", F.col("_offset") + inside)
        .withColumn(out, F.col("_first_bin") + chunk_of(F.col("_rn"), bin_size))
        .drop("_bucket", "_offset", "_first_bin", "_rn")
    )


def category_bins(df: DataFrame, bin_size: int, key: str = CATEGORY_KEY, out: str = "extract_bin") -> DataFrame:
    """Dense bin numbers over (category, chunk) in key order, NULL keys first."""
    return _dense_bins(_with_key(df, key), ["_key"], ["shuffle_key", "id"], bin_size, out, _by_hash).drop("_key")


def keyed_bins(df: DataFrame, keys: list[str], bin_size: int, seed: int = 0) -> DataFrame:
    """Category key from ``keys``, seeded order inside it and dense bins; adds three columns."""
    keyed = with_shuffle_key(df.withColumn(CATEGORY_KEY, category_key(keys)), seed)
    return category_bins(keyed, bin_size)


def chunks_in_groups(df: DataFrame, keys: list[str], bin_size: int, id_column: str = "id") -> DataFrame:
    """Ids of each group in order, cut every ``bin_size``: adds ``chunk``. Rows with a NULL key go."""
    present = df.dropna(subset=keys)
    ranked = rank_in_groups(present, keys, [id_column], "_rn", lambda d: with_value_bucket(d, id_column))
    return ranked.withColumn("chunk", chunk_of(F.col("_rn"), bin_size)).drop("_rn")


def grouped_bins(df: DataFrame, keys: list[str], bin_size: int, id_column: str = "id",
                 out: str = "extract_bin") -> DataFrame:
    """Bins of one group each, ids in order, numbered in key order. Rows with a NULL key go."""
    present = df.dropna(subset=keys)
    return _dense_bins(present, keys, [id_column], bin_size, out, lambda d: with_value_bucket(d, id_column))
