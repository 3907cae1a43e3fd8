"""The star-schema test tables seen as cells, ingests, features and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


FILES = 25


class StarTables:
    """Views over a folder of Parquet tables; only the requested feature axis is computed at once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def cells(self) -> DataFrame:
        """One cell per order, described by its customer."""
        customers = self.raw("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        joined = self.raw("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(
            F.col("o_orderkey").alias("id"),
            F.col("c_nationkey").cast("bigint").alias("ingest_id"),
            F.concat(F.lit("cell_"), F.col("o_orderkey").cast("string")).alias("original_id"),
            F.col("o_custkey").cast("string").alias("donor_id"),
            F.col("o_orderpriority").alias("cell_type"),
            F.col("o_orderstatus").alias("disease"),
            F.col("c_mktsegment").alias("tissue"),
            F.col("o_totalprice").alias("score"),
        )

    @property
    def cells_with_nulls(self) -> DataFrame:
        """Cells where every 50th tissue and every 70th cell type is NULL."""
        return self.cells.withColumns({
            "tissue": F.when(F.col("id") % 50 != 0, F.col("tissue")),
            "cell_type": F.when(F.col("id") % 70 != 0, F.col("cell_type")),
        })

    @property
    def ingests(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")
        )

    @property
    def features(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0")).alias("ensemble_id"),
            F.col("p_name").alias("symbol"),
            F.col("p_type").alias("biotype"),
            F.col("p_size").alias("size"),
        )

    @property
    def wanted_features(self) -> DataFrame:
        """The requested feature axis, numbered from 0 in id order."""
        from binwright.operators.ranks import rank_by_value
        from binwright.session import freeze

        chosen = rank_by_value(self.features.filter("size <= 10"), "id", "_rank")
        return freeze(chosen.select((F.col("_rank") - 1).alias("id"), "symbol", "ensemble_id"))

    @property
    def counts(self) -> DataFrame:
        """One count per (cell, feature); repeats are summed map-side first."""
        return self.raw("lineitem").groupBy("l_orderkey", "l_partkey").agg(
            F.sum("l_quantity").cast("bigint").alias("raw_count")
        ).select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("feature_id"), "raw_count")

    @property
    def event_cells(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("event_type").alias("cell_type"),
            F.col("user_id").cast("string").alias("donor_id"), F.col("props").alias("metadata_extra"),
            F.col("value"),
        )

    @property
    def batch(self):
        """The cells as 25 input files with positions instead of ids.

        Cell ``n`` is row ``n div 25`` of file ``n % 25``. A file measures all features but every
        25th, beginning with the one of its own number, so positions shift from file to file. Every
        tenth count is stored as zero.
        """
        from binwright.plans.ingest import Batch

        def file_name(number):
            return F.concat(F.lit("file_"), F.lpad(number.cast("string"), 3, "0"))

        def column(feature, number):
            skipped = F.call_function("div", feature + 24 - number, F.lit(FILES))
            return (feature - skipped).cast("bigint")

        number = F.col("id") % FILES
        obs = self.cells.select(
            file_name(number).alias("file"), F.call_function("div", F.col("id"), F.lit(FILES)).alias("row_pos"),
            F.col("original_id").alias("obs_id"), F.col("donor_id").alias("donor"), "cell_type", "tissue", "score",
        )
        measured = self.features.withColumn("_file", F.explode(F.sequence(F.lit(0), F.lit(FILES - 1))))
        measured = measured.filter(F.col("id") % FILES != F.col("_file"))
        var = measured.select(
            file_name(F.col("_file")).alias("file"), column(F.col("id"), F.col("_file")).alias("col_pos"),
            F.col("ensemble_id").alias("var_id"), "symbol", "biotype",
        )
        cell, feature = F.col("cell_id"), F.col("feature_id")
        value = F.when(F.col("raw_count") % 10 == 0, 0).otherwise(F.col("raw_count")).cast("double")
        x = self.counts.filter(feature % FILES != cell % FILES).select(
            file_name(cell % FILES).alias("file"), F.call_function("div", cell, F.lit(FILES)).alias("row_pos"),
            column(feature, cell % FILES).alias("col_pos"), value.alias("value"),
        )
        return Batch(obs, var, x)
