"""Ranks, chunks and running sums over a whole table without a single-task window.

A plain ``row_number() over (order by ...)`` sends all rows to one task. Here every row gets a
bucket that is a pure function of its sort value and grows with it; a first pass counts rows per
bucket, a running sum over that small table gives each bucket its offset, and ranks inside a bucket
are taken by a window partitioned on it. Results do not depend on the number of buckets. Ranks by value take the
partitions of a range partitioning as buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binwright.functions import shuffle_hash
from binwright.functions.columns import HASH_BITS
from binwright.operators.dims import BROADCAST_ROWS, join_dimension
from binwright.session import default_buckets, freeze

MAX_VALUE_BUCKETS = 4096
# A group of at most this many rows is sorted by one task; a larger one is split.
HOT_GROUP_ROWS = 1_000_000
_NUMBER_BITS = 33  # of monotonically_increasing_id: the row in its partition. Fixed value of Spark's.


def hash_bucket(hashed: Column, buckets: int) -> Column:
    """Even buckets of a 60-bit hash, in hash order. ``buckets`` is a power of two.

    Never NULL, so joins on it add no filter that would compute the hash once more.
    """
    return F.coalesce(F.shiftright(hashed, HASH_BITS - (buckets.bit_length() - 1)).cast("int"), F.lit(0))


def with_value_bucket(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """Adds ``_bucket``: even-sized buckets of a numeric column in its order, whatever its gaps.

    Bounds are quantiles of the column. Their error only moves rows between buckets: a bucket is a
    non-decreasing function of the value, so ranks built on it are exact.
    """
    buckets = min(buckets or default_buckets(df.sparkSession), MAX_VALUE_BUCKETS)
    steps = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(df.approxQuantile(column, steps, 1 / (4 * buckets)))) or [0.0]
    splits = [float("-inf"), *bounds, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=column, outputCol="_bucket", handleInvalid="keep")
    return cut.transform(df).withColumn("_bucket", F.coalesce(F.col("_bucket").cast("int"), F.lit(0)))


def _rank_in_buckets(bucketed: DataFrame, order: list[str], out: str) -> DataFrame:
    """1-based rank; ``_bucket`` is at most a few ten thousand values, so its table is broadcast."""
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        bucketed.join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.col("_offset") + F.row_number().over(inside))
        .drop("_bucket", "_offset")
    )


def rank_by_hash(df: DataFrame, hash_column: str = "shuffle_key", tie: str = "id", out: str = "rank",
                 buckets: int | None = None) -> DataFrame:
    """1-based rank by a 60-bit hash column, ties by ``tie``."""
    buckets = buckets or default_buckets(df.sparkSession)
    bucketed = df.withColumn("_bucket", hash_bucket(F.col(hash_column), buckets))
    return _rank_in_buckets(bucketed, [hash_column, tie], out)


def rank_by_value(df: DataFrame, column: str = "id", out: str = "rank") -> DataFrame:
    """1-based rank by a column whose values are unique, NULL first.

    Rows are cut into ranges of the column and sorted there, and keep their number in the range: the low bits of a number that Spark
    gives within a partition, written down with the rows (a checkpoint), so that it stays true. Then only the sizes of the
    ranges are added up. The input is read to choose the ranges and to sort, and moves once.
    """
    placed = df.repartitionByRange(column).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id())
    placed = freeze(placed)
    part, number = F.shiftright("_at", _NUMBER_BITS), F.col("_at").bitwiseAND(F.lit((1 << _NUMBER_BITS) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(out, F.col("_offset") + number + 1).drop("_part", "_offset", "_at")


class SplitGroups(NamedTuple):
    """Rows with a ``_bucket``, rows per group as ``_n``, and ranks before each (group, bucket).

    ``offsets`` is None when no group had to be split; then every ``_bucket`` is 0.
    """

    rows: DataFrame
    sizes: DataFrame
    offsets: DataFrame | None


def split_hot_groups(df: DataFrame, keys: list[str], bucketize: Callable[[DataFrame], DataFrame]) -> SplitGroups:
    """Splits groups of more than ``HOT_GROUP_ROWS`` rows into ordered buckets; others stay whole.

    Keys hold no NULL. Group sizes come from one map-side combined pass and are frozen. Hot groups
    are few by definition, at most one per ``HOT_GROUP_ROWS`` rows, so only their buckets are
    counted and the offset table stays near one row per group however many groups there are.
    """
    sizes = freeze(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    hot = sizes.filter(F.col("_n") > HOT_GROUP_ROWS).select(*keys, F.lit(True).alias("_hot"))
    n_hot = hot.count()
    if n_hot == 0:
        return SplitGroups(df.withColumn("_bucket", F.lit(0)), sizes, None)
    marked = bucketize(join_dimension(df, hot, keys, "left", fits=n_hot <= BROADCAST_ROWS))
    rows = marked.withColumn("_bucket", F.when(F.col("_hot"), F.col("_bucket")).otherwise(F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    split = (
        rows.filter(F.col("_hot")).groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    whole = sizes.filter(F.col("_n") <= HOT_GROUP_ROWS).select(
        *keys, F.lit(0).alias("_bucket"), F.lit(0).cast("bigint").alias("_offset")
    )
    return SplitGroups(rows.drop("_hot"), sizes, split.unionByName(whole))


def rank_in_groups(df: DataFrame, keys: list[str], order: list[str], out: str,
                   bucketize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """1-based rank inside each group of NULL-free keys, whatever its size.

    The offsets and the window share one partitioning on (group, bucket), so rows move once and a
    hot group fills many tasks.
    """
    groups = split_hot_groups(df, keys, bucketize)
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)).cast("bigint")
    if groups.offsets is None:
        return groups.rows.withColumn(out, inside).drop("_bucket")
    joined = groups.rows.join(groups.offsets, [*keys, "_bucket"])
    return joined.withColumn(out, F.col("_offset") + inside).drop("_bucket", "_offset")


def running_sum(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums over all rows in the order of the (unique) sort columns.

    ``sums`` names the new columns and the columns they add up. Rows are range-partitioned and
    frozen, so that the partition number they carry stays true; the only one-task window runs over
    one row per partition.
    """
    ranged = freeze(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def sum_over(column, window):
        return F.coalesce(F.sum(column).over(window), F.lit(0)).cast("bigint")

    totals = ranged.groupBy("_part").agg(*[F.sum(value).alias(f"_sum_{out}") for out, value in sums.items()])
    bases = totals.select("_part", *[sum_over(f"_sum_{out}", before).alias(f"_base_{out}") for out in sums])
    joined = ranged.join(F.broadcast(bases), "_part")
    return joined.withColumns(
        {out: F.col(f"_base_{out}") + sum_over(value, inside) for out, value in sums.items()}
    ).drop("_part", *[f"_base_{out}" for out in sums])


def chunk_of(rank: Column, size: int) -> Column:
    """0-based chunk of a 1-based rank."""
    if size <= 0:
        raise ValueError(f"chunk size must be positive, got {size}")
    return F.call_function("div", rank - 1, F.lit(size)).cast("bigint")


def with_shuffle_key(df: DataFrame, seed: int = 0, id_column: str = "id") -> DataFrame:
    return df.withColumn("shuffle_key", shuffle_hash(F.col(id_column), seed))


def random_bins(df: DataFrame, bin_size: int, seed: int = 0, out: str = "extract_bin") -> DataFrame:
    """Cells in seeded random order cut into bins of ``bin_size``; keeps ``shuffle_key``."""
    ranked = rank_by_hash(with_shuffle_key(df, seed), out="_rank")
    return ranked.withColumn(out, chunk_of(F.col("_rank"), bin_size)).drop("_rank")


def contiguous_ids(df: DataFrame, start: int = 0, order: str | None = None, label: str = "obs_id") -> DataFrame:
    """Ids ``start, start+1, ...``: by a numeric position column, else by a hash of the row label."""
    if order:
        ranked = rank_by_value(df, order, "_rank")
    else:
        hashed = df.withColumn("_hash", F.conv(F.substring(F.md5(F.col(label)), 1, 15), 16, 10).cast("bigint"))
        ranked = rank_by_hash(hashed, "_hash", label, "_rank").drop("_hash")
    return ranked.withColumn("id", F.col("_rank") - 1 + F.lit(start)).drop("_rank")


def contiguous_ranges(df: DataFrame, range_size: int, id_column: str = "id") -> DataFrame:
    """Sorted ids cut every ``range_size``: ``(range_index, start, end, n_cells)``."""
    ranked = rank_by_value(df.select(id_column), id_column, "_rank")
    return (
        ranked.groupBy(chunk_of(F.col("_rank"), range_size).alias("range_index"))
        .agg(F.min(id_column).alias("start"), F.max(id_column).alias("end"), F.count(F.lit(1)).alias("n_cells"))
    )


def permute_keep_last(positions: DataFrame, column: str, total: int, seed: int, out: str) -> DataFrame:
    """A seeded permutation of the positions ``0..total-1`` that leaves the last one in place."""
    moved = positions.filter(F.col(column) < total - 1).withColumn("_h", shuffle_hash(F.col(column), seed))
    ranked = rank_by_hash(moved, "_h", column, "_rank").withColumn(out, F.col("_rank") - 1).drop("_rank", "_h")
    last = positions.filter(F.col(column) == total - 1).withColumn(out, F.col(column).cast("bigint"))
    return ranked.unionByName(last)


def bin_names(bins: DataFrame, total: int, seed: int | None, column: str = "extract_bin") -> DataFrame:
    """``(extract_bin, output_bin)``: shuffled output names, or the same numbers without a seed."""
    if seed is None:
        return bins.select(column, F.col(column).cast("bigint").alias("output_bin"))
    return permute_keep_last(bins.select(column), column, total, seed, "output_bin")


def block_slice(df: DataFrame, block_index: int, block_size: int, rank: str = "rank") -> DataFrame:
    """Rows whose 0-based rank falls into one block; the last is short, past the end is empty."""
    if block_size <= 0 or block_index < 0:
        raise ValueError("block size must be positive and block index not negative")
    start = block_index * block_size
    return df.filter((F.col(rank) >= start) & (F.col(rank) < start + block_size))


def block_bounds(total_items: int, block_index: int, block_size: int) -> tuple[int, int]:
    """``[start, end)`` of a block of a list of ``total_items``."""
    start = min(block_index * block_size, total_items)
    return start, min(start + block_size, total_items)
