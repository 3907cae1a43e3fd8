"""Facet table of a cell table: row count, categorical columns and their values in one place."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binwright.operators.dims import join_dimension
from binwright.operators.explore import (
    CATEGORY_LIMIT_EXPLORE,
    NEVER_CATEGORIES,
    category_values,
    count_cells,
    string_columns,
)
from binwright.session import freeze
from binwright.sources.base import read_commits, read_table, remove_folders, stored_rows


def facet_rows(cells: DataFrame, dataset: str, threshold: int = CATEGORY_LIMIT_EXPLORE,
               exclude: list[str] | None = None) -> DataFrame:
    """``(dataset, facet, value, n)``: one ``total_cells`` row and one row per categorical value.

    Values come from columns within the threshold only, so the table stays small for any dataset.
    """
    total = count_cells(cells).select(
        F.lit(dataset).alias("dataset"), F.lit("total_cells").alias("facet"),
        F.lit(None).cast("string").alias("value"), F.col("total_cells").alias("n"),
    )
    values = category_values(cells, threshold, exclude).filter(F.col("value").isNotNull()).select(
        F.lit(dataset).alias("dataset"), F.col("column_name").alias("facet"), "value", F.lit(1).cast("bigint").alias("n")
    )
    return total.unionByName(values)


def refresh_facets(datasets: Mapping[str, DataFrame], path: str, threshold: int = CATEGORY_LIMIT_EXPLORE) -> DataFrame:
    """Rewrites the facet table of all datasets together and returns a reader."""
    rows = None
    for name, cells in datasets.items():
        part = facet_rows(cells, name, threshold)
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no datasets")
    rows.write.mode("overwrite").partitionBy("dataset").parquet(path)
    return rows.sparkSession.read.parquet(path)


TOTAL = "total_cells"
# Fixed schema: what one ingest adds to the facets. ``facet`` is TOTAL or a column; ``n`` is the number of cells, or of distinct
# values of a column. A column with more values than the limit has no values here: it can be no facet of any union.
STATE = T.StructType([
    T.StructField("facet", T.StringType()), T.StructField("value", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("ingest_id", T.LongType()),
])


def facet_state(cells: DataFrame, threshold: int = CATEGORY_LIMIT_EXPLORE, exclude: list[str] | None = None) -> DataFrame:
    """Mergeable facets of cells with ``ingest_id``: per ingest its cells, the distinct values of columns within the limit, and a
    row without value for every column. At most ``threshold`` + 1 rows per ingest and column."""
    columns = string_columns(cells, NEVER_CATEGORIES if exclude is None else exclude)
    total = cells.groupBy("ingest_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(TOTAL).alias("facet"), F.lit(None).cast("string").alias("value"), "n", "ingest_id"
    )
    if not columns:
        return total
    texts = cells.select("ingest_id", *columns).unpivot(["ingest_id"], columns, "facet", "value").filter("value IS NOT NULL").distinct()
    counts = freeze(texts.groupBy("ingest_id", "facet").agg(F.count(F.lit(1)).alias("n")))
    within = counts.filter(F.col("n") <= threshold).select("ingest_id", "facet")
    values = join_dimension(texts, within, ["ingest_id", "facet"], "left_semi", salt_on="value")
    marks = counts.select("facet", F.lit(None).cast("string").alias("value"), "n", "ingest_id")
    return total.unionByName(marks).unionByName(values.select("facet", "value", F.lit(1).cast("bigint").alias("n"), "ingest_id"))


def merged_facets(state: DataFrame, dataset: str, threshold: int = CATEGORY_LIMIT_EXPLORE) -> DataFrame:
    """``facet_rows`` of all ingests in the state."""
    total = state.filter(F.col("facet") == TOTAL).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit(dataset).alias("dataset"), F.lit(TOTAL).alias("facet"), F.lit(None).cast("string").alias("value"), "n"
    )
    columns = state.filter(F.col("facet") != TOTAL)
    values = columns.filter("value IS NOT NULL").select("facet", "value").distinct()
    over = columns.filter(F.col("value").isNull() & (F.col("n") > threshold)).select("facet")
    many = values.groupBy("facet").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > threshold).select("facet")
    kept = join_dimension(values, over.unionByName(many).distinct(), "facet", "left_anti", salt_on="value")
    return total.unionByName(kept.select(F.lit(dataset).alias("dataset"), "facet", "value", F.lit(1).cast("bigint").alias("n")))


def refresh_warehouse_facets(spark: SparkSession, warehouse: str, path: str, dataset: str, threshold: int = CATEGORY_LIMIT_EXPLORE) -> DataFrame:
    """Facets of a warehouse's committed cells: only ingests that are new since the last refresh are read.

    Each ingest's part is kept below ``path/state``, made for one threshold; another one starts anew. The result equals
    ``facet_rows`` of the whole cell table and is written below ``path/facets``.
    """
    folder = f"{path}/state/threshold={threshold}"
    remove_folders(spark, f"{path}/state", lambda name: name.startswith("threshold=") and name != f"threshold={threshold}")
    done = stored_rows(spark, folder, STATE).select("ingest_id").distinct()
    fresh = freeze(join_dimension(read_commits(spark, warehouse), done, "ingest_id", "left_anti", salt_on="ingest_id"))
    if not fresh.isEmpty():
        cells = read_table(spark, warehouse, "cell_info", with_ingest=True)
        # Always true; it tells the optimizer that this side is selective, so that other partitions are not read.
        added = join_dimension(cells, fresh.filter("ingest_id IS NOT NULL AND ingest_id >= -9223372036854775807"), "ingest_id", "left_semi", salt_on="id")
        empty = fresh.select(F.lit(TOTAL).alias("facet"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("n"), "ingest_id")
        state = facet_state(added, threshold).unionByName(empty)  # an ingest without cells is known too
        state.repartition("ingest_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_id").parquet(folder)
    merged_facets(stored_rows(spark, folder, STATE), dataset, threshold).write.mode("overwrite").partitionBy("dataset").parquet(f"{path}/facets")
    return spark.read.schema("facet string, value string, n bigint, dataset string").parquet(f"{path}/facets").select("dataset", "facet", "value", "n")
