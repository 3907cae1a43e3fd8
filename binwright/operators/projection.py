"""Column selection, renaming and bin-pruned reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binwright.operators.dims import join_dimension

REQUIRED_CELL_COLUMNS = ["id", "ingest_id"]
ROW_LABEL = "index"


def check_column_name(name: str) -> str:
    if not name:
        raise ValueError("column names must not be empty")
    if name.count(".") > 1:
        raise ValueError(f"{name!r} has more than one period; only one may separate alias and column")
    return name


def select_columns(df: DataFrame, columns: list[str] | None, required: list[str] | None = None) -> DataFrame:
    """Columns in the caller's order without repeats, required ones in front when not named.

    Table aliases are dropped; an empty list selects everything.
    """
    names = [check_column_name(c).split(".")[-1] for c in columns or []]
    if not names and required is None:
        return df
    lead = [c for c in required or [] if c not in names]
    return df.select(*dict.fromkeys([*lead, *names]))


def select_cell_columns(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """``select_columns`` that always keeps the cell id and its ingest id."""
    return select_columns(df, columns, REQUIRED_CELL_COLUMNS)


def keep_existing(df: DataFrame, wanted: list[str] | None, key: str = "id") -> DataFrame:
    """Wanted columns that exist, plus the key; missing ones are ignored, ``None`` keeps all."""
    if wanted is None:
        return df
    return df.select(key, *[c for c in dict.fromkeys(wanted) if c in df.columns and c != key])


def keep_existing_or_all(df: DataFrame, wanted: list[str] | None, key: str = "id") -> DataFrame:
    """As ``keep_existing``, but everything is kept when none of the wanted columns exists."""
    if not wanted or not any(c in df.columns and c != key for c in wanted):
        return df
    return keep_existing(df, wanted, key)


def map_columns(df: DataFrame, mapping: dict[str, str] | None, label_column: str) -> DataFrame:
    """Rename input columns; the ``index`` key copies the row label into a new column."""
    mapping = dict(mapping or {})
    copied = mapping.pop(ROW_LABEL, None)
    if copied:
        df = df.withColumn(copied, F.col(label_column))
    return df.withColumnsRenamed(mapping) if mapping else df


def bucket_of_bin(bin_column, partition_bins: int, partition_size: int):
    """Storage partition of a bin: ``partition_size`` bins each, one last partition beyond the range."""
    bucket = F.call_function("div", bin_column, F.lit(partition_size)).cast("bigint")
    return F.least(bucket, F.lit(partition_bins // partition_size).cast("bigint"))


def read_bins(df: DataFrame, start_bin: int, end_bin: int, columns: list[str] | None = None,
              partition_bins: int = 40_000, partition_size: int = 10) -> DataFrame:
    """Rows of an inclusive bin range of a table written by ``sinks.write_binned``.

    The same range is stated on ``bin_bucket``, so only the directories that can match are listed.
    """
    last = partition_bins // partition_size
    low, high = min(start_bin // partition_size, last), min(end_bin // partition_size, last)
    found = df.filter(F.col("bin_bucket").between(low, high) & F.col("extract_bin").between(start_bin, end_bin))
    return found.select(*columns) if columns else found


def ordered_feature_subset(features: DataFrame, column: str, values: list[str]) -> DataFrame:
    """``(position, value, id)`` of the features named in ``values``, in the order of that list.

    Unknown values are skipped; a value held by several features takes the highest id. The list is
    the caller's request and bounds the result, so the feature table is only filtered by it.
    """
    spark = features.sparkSession
    listed = spark.createDataFrame([(p, v) for p, v in enumerate(values)], "position bigint, value string")
    keyed = features.select(F.col(column).alias("value"), F.col("id"))
    matched = join_dimension(keyed, listed.select("value").distinct(), "value", salt_on="id")
    last = matched.groupBy("value").agg(F.max("id").alias("id"))
    return listed.join(last, "value").select("position", "value", "id")
