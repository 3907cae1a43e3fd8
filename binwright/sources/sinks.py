"""Extract tables, per-bin outputs, plan documents and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binwright.operators.projection import bucket_of_bin
from binwright.schemas import EXTRACT_FEATURE_INFO, conform

PARTITION_BINS = 40_000
PARTITION_SIZE = 10
MOST_BUCKETS = 20_000

# The document that describes an extract.
EXTRACT_METADATA = T.StructType([
    T.StructField("total_bins", T.LongType()),
    T.StructField("last_bin_size", T.LongType()),
    T.StructField("total_cells", T.LongType()),
    T.StructField("filters", T.StringType()),
    T.StructField("extract_bin_size", T.LongType()),
    T.StructField("category_metadata", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])


def write_binned(df: DataFrame, path: str, partition_bins: int = PARTITION_BINS,
                 partition_size: int = PARTITION_SIZE, then: tuple[str, ...] = ()) -> None:
    """Table partitioned by groups of bins and sorted by bin inside each file.

    Rebalancing on the bin keeps a bin together and gives files of even size, however many bins
    share a partition.
    """
    bucketed = df.withColumn("bin_bucket", bucket_of_bin(F.col("extract_bin"), partition_bins, partition_size))
    (
        bucketed.hint("rebalance", F.col("bin_bucket"), F.col("extract_bin"))
        .sortWithinPartitions("bin_bucket", "extract_bin", *then)
        .write.mode("overwrite").partitionBy("bin_bucket").parquet(path)
    )


def bucket_count(total_bins: int, partition_size: int = PARTITION_SIZE) -> int:
    """Buckets for tables of that many bins: about one per group of ``partition_size`` bins."""
    return max(1, min(MOST_BUCKETS, -(-total_bins // partition_size)))


def write_bucketed(df: DataFrame, path: str, buckets: int, partition_bins: int = PARTITION_BINS,
                   partition_size: int = PARTITION_SIZE) -> None:
    """Table partitioned by groups of bins, and bucketed by these groups (``bin_group``, not capped as the storage partitions are),
    so that tables of the same bins join without an exchange.

    A group's rows are one file, in order of bin and row; a bucket holds whole groups.
    """
    spark, name = df.sparkSession, f"binned_{uuid.uuid4().hex}"
    placed = df.withColumns({
        "bin_group": F.call_function("div", F.col("extract_bin"), F.lit(partition_size)).cast("bigint"),
        "bin_bucket": bucket_of_bin(F.col("extract_bin"), partition_bins, partition_size),
    })
    (
        placed.repartition(buckets, "bin_group").write.format("parquet").mode("overwrite").option("path", path)
        .partitionBy("bin_bucket").bucketBy(buckets, "bin_group").sortBy("extract_bin", "row_num").saveAsTable(name)
    )
    spark.sql(f"DROP TABLE {name}")  # of the catalog only: its files stay


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType, buckets: int) -> DataFrame:
    """A table of ``write_bucketed``, declared again with its buckets."""
    name, own = f"binned_{uuid.uuid4().hex}", ("bin_bucket", "bin_group")
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields if f.name not in own)
    spark.sql(
        f"CREATE TABLE {name} ({columns}, bin_group BIGINT, bin_bucket BIGINT) USING parquet PARTITIONED BY (bin_bucket) "
        f"CLUSTERED BY (bin_group) SORTED BY (extract_bin, row_num) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


# Packed counts of an extract. ``row_num`` is the row of the cell in its bin.
PACKED_COUNTS = T.StructType([
    T.StructField("extract_bin", T.LongType()),
    T.StructField("row_num", T.LongType()),
    T.StructField("cell_id", T.LongType()),
    T.StructField("feature_data", T.ArrayType(T.StructType([
        T.StructField("feature_id", T.LongType()), T.StructField("raw_counts", T.LongType()),
    ]))),
])


def read_binned(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of ``write_binned``; give ``schema`` where the table may hold no rows."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("bin_bucket", T.LongType())])).parquet(path)


def write_bins(blocks: DataFrame, path: str, bin_column: str = "extract_bin", order: str = "row_num",
               placed: bool = False, keep_others: bool = False) -> None:
    """One output per bin: every bin is one directory with one file, all bins in one job.

    A bin is the unit of output and holds at most its size in cells, so one task per bin is bounded.
    ``placed`` says that the rows of a bin already lie together, which saves a shuffle. ``keep_others`` replaces
    only the bins of this run, for work split over several runs; else the output holds this run's bins alone.
    """
    together = blocks if placed else blocks.repartition(F.col(bin_column))
    (
        together.sortWithinPartitions(bin_column, order)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if keep_others else "static")
        .partitionBy(bin_column).parquet(path)
    )


def write_features(features: DataFrame, path: str) -> None:
    """Replaces the feature table of an extract."""
    conform(features, EXTRACT_FEATURE_INFO).write.mode("overwrite").parquet(path)


def read_features_csv(spark: SparkSession, path: str) -> DataFrame:
    """Feature list with a header; columns are matched by name, all as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def write_metadata(metadata: DataFrame, path: str) -> None:
    """One JSON document; the frame holds one row."""
    metadata.coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str, schema: T.StructType = EXTRACT_METADATA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def export_csv(df: DataFrame, path: str, exclude: list[str] | None = None) -> None:
    """CSV with a header without the excluded columns; nothing to export is an error."""
    if df.isEmpty():
        raise ValueError("nothing to export")
    df.drop(*(exclude or [])).write.mode("overwrite").option("header", True).csv(path)
