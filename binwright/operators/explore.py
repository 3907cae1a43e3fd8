"""Counts, distinct values and categorical columns of a cell table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binwright.operators.filters import where

CATEGORY_LIMIT_EXPLORE = 2_000
CATEGORY_LIMIT_EXTRACT = 5_000
# Extract columns that are never categories.
NEVER_CATEGORIES = ["id", "extract_bin", "original_id", "metadata_extra"]


def count_cells(cells: DataFrame, filters: Mapping | None = None) -> DataFrame:
    """One row ``total_cells``."""
    return where(cells, filters).agg(F.count(F.lit(1)).alias("total_cells"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """One row ``distinct_count``; NULL is not a value."""
    return df.agg(F.count_distinct(column).alias("distinct_count"))


def _count_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, n)`` distinct values per column; repeats are combined before the shuffle."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    pairs = texts.unpivot([], columns, "column_name", "value")
    return pairs.groupBy("column_name").agg(F.count_distinct("value").alias("n"))


def string_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    skip = set(exclude or [])
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def distinct_counts_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, n_distinct)`` of many columns in one scan; all-NULL columns count zero."""
    counted = _count_values(df, columns)
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return named.join(counted, "column_name", "left").select(
        "column_name", F.coalesce("n", F.lit(0)).alias("n_distinct")
    )


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row with a column ``distinct_<name>`` per column, from one scan.

    The unpivoted form shuffles each distinct value once, where several ``count(distinct)`` over a
    wide row would expand every row once per column and shuffle it whole.
    """
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(f"distinct_{c}") for c in columns])
    counted = _count_values(df, columns)
    one = [
        F.coalesce(F.max(F.when(F.col("column_name") == c, F.col("n"))), F.lit(0)).alias(f"distinct_{c}")
        for c in columns
    ]
    return counted.agg(*one)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Non-NULL distinct values as text, ascending."""
    values = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return values.orderBy("value").select(F.col("value").cast("string").alias("value"))


def categorical_columns(df: DataFrame, threshold: int = CATEGORY_LIMIT_EXPLORE,
                        exclude: list[str] | None = None) -> DataFrame:
    """``(column_name, n_distinct)`` of text columns with at most ``threshold`` distinct values."""
    columns = string_columns(df, exclude)
    return distinct_counts_long(df, columns).filter(F.col("n_distinct") <= threshold)


def category_values(df: DataFrame, limit: int = CATEGORY_LIMIT_EXTRACT,
                    exclude: list[str] | None = None) -> DataFrame:
    """``(column_name, value)`` for every text column within the limit, one job for all columns.

    A column without any value is within the limit and has one row with a NULL value. The counts
    are one row per column; only values of columns within the limit go on, so whatever is collected
    later is bounded by ``columns x limit``.
    """
    columns = string_columns(df, NEVER_CATEGORIES if exclude is None else exclude)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    pairs = df.select(*columns).unpivot([], columns, "column_name", "value").distinct()
    counts = pairs.groupBy("column_name").agg(F.count("value").alias("n"))
    within = pairs.join(F.broadcast(counts.filter(F.col("n") <= limit)), "column_name")
    return within.filter(F.col("value").isNotNull() | (F.col("n") == 0)).drop("n")


def category_lists(df: DataFrame, limit: int = CATEGORY_LIMIT_EXTRACT,
                   exclude: list[str] | None = None) -> DataFrame:
    """``(column_name, categories)`` with sorted arrays of at most ``limit`` values."""
    return category_values(df, limit, exclude).groupBy("column_name").agg(
        F.sort_array(F.collect_list("value")).alias("categories")
    )


def filter_catalogue(df: DataFrame, threshold: int = CATEGORY_LIMIT_EXPLORE,
                     exclude: list[str] | None = None) -> DataFrame:
    """``(column_name, label, field_type, operators, suggest)`` of every filterable column."""
    skip = {"metadata_extra"} if exclude is None else set(exclude)
    rows = []
    for field in df.schema:
        if field.name in skip or field.name.endswith("_ontology_term_id"):
            continue
        kind = (
            "boolean" if isinstance(field.dataType, T.BooleanType)
            else "number" if isinstance(field.dataType, T.NumericType)
            else "string" if isinstance(field.dataType, T.StringType)
            else None
        )
        if kind:
            rows.append((field.name, field.name.replace("_", " ").title(), kind))
    fields = df.sparkSession.createDataFrame(rows, "column_name string, label string, field_type string")
    categorical = categorical_columns(df, threshold, sorted(skip)).select("column_name", F.lit(True).alias("suggest"))
    joined = fields.join(categorical, "column_name", "left").withColumn("suggest", F.coalesce("suggest", F.lit(False)))

    def names(*values):
        return F.array(*[F.lit(v) for v in values])

    operators = (
        F.when(F.col("field_type") == "boolean", names("eq", "not_eq"))
        .when(F.col("field_type") == "number", names("eq", "gt", "gte", "lt", "lte"))
        .when(F.col("suggest"), names("in", "not_in"))
        .otherwise(names("eq", "not_eq", "in", "not_in"))
    )
    return joined.select("column_name", "label", "field_type", operators.alias("operators"), "suggest")
