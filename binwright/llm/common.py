"""Helpers shared by the corpus operators: inputs, stored intermediate tables, and shipping the code to workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binwright.session import scratch_path

# Fixed value: the white space of the contracts, as a character class for Java, Python and DuckDB patterns.
SPACES = r"[\x20\x09-\x0D]+"

NO_ID = -(2**63)  # stands for a null doc_id where a key or a file must hold one; sorts first, as null does

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An input table by name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (null: empty), so that other columns can have any name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def doc_key(column: str = "doc_id") -> Column:
    """The id as a key that joins: null ids are NO_ID."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it on their path. Safe to repeat."""
    sc = spark.sparkContext
    if _ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_binwright_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "binwright_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(_ROOT, "binwright")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, _ROOT))
    sc.addPyFile(path)
    sc._binwright_shipped = True


def held_out(column: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """True for rows of the fold that learning must not see: crc32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == fold, F.lit(False))


BROADCAST_ROWS = 1_000_000  # of narrow rows (a few numbers each)


def joined(big: DataFrame, narrow: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join with a stored table of a few numbers per row: broadcast up to BROADCAST_ROWS, else by a shuffle."""
    return big.join(F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow, on, how)
