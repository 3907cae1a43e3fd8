"""Base tables: typed scans, staged loads and an append that becomes visible all at once.

A warehouse is a folder with one Parquet table per base table, each partitioned by ``ingest_id``,
and a ``commits`` table. Rows of an ingest exist for readers only once its commit row does, so the
four tables of an ingest appear together or not at all. Writers at the same time keep apart: ids are reserved
(``sources.reserve``), each writes its own partitions and its own part of ``commits``. What a failed writer left
is removed by ``vacuum``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Collection, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binwright.operators.dims import fits_broadcast, join_dimension
from binwright.schemas import BASE_TABLES, RAW_MATRIX_COO, conform
from binwright.session import freeze

COMMITS = T.StructType([T.StructField("ingest_id", T.LongType(), False)])
RAW_COUNTS_PATTERN = "raw-counts-*.csv"

# Column each base table is sorted by inside its files.
CLUSTER_COLUMN = {"ingest_info": "id", "cell_info": "id", "feature_info": "id", "raw_matrix_coo": "cell_id"}
# A file of a long table covers one block of this many ids of its sort column.
IDS_PER_BLOCK = 100_000


def stored_schema(schema: T.StructType) -> T.StructType:
    """``schema`` with the partition column ``ingest_id``."""
    if "ingest_id" in schema.names:
        return schema
    return T.StructType([*schema.fields, T.StructField("ingest_id", T.LongType(), False)])


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def remove_folders(spark: SparkSession, path: str, chosen: Callable[[str], bool]) -> list[str]:
    """Deletes the folders right below ``path`` whose names are chosen; their names, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
    gone = [n for n in names if chosen(n)]
    for name in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return gone


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet with a declared schema: no inference, pruned columns and pushed filters."""
    return spark.read.schema(schema).parquet(path)


def stored_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows at ``path``, committed or not; none when nothing was written yet."""
    return scan(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema)


def read_commits(spark: SparkSession, warehouse: str) -> DataFrame:
    return stored_rows(spark, f"{warehouse}/commits", COMMITS).select("ingest_id").distinct()


def read_table(spark: SparkSession, warehouse: str, table: str, schema: T.StructType | None = None,
               with_ingest: bool = False) -> DataFrame:
    """Committed rows of a table, in its declared columns; ``with_ingest`` adds the partition column ``ingest_id``."""
    schema = schema or BASE_TABLES[table]
    stored = stored_rows(spark, f"{warehouse}/{table}", stored_schema(schema))
    spread = schema.names[:2]
    visible = join_dimension(stored, read_commits(spark, warehouse), "ingest_id", "left_semi", salt_on=spread)
    return visible.select(*dict.fromkeys([*schema.names, *(["ingest_id"] if with_ingest else [])]))


def read_tables(spark: SparkSession, warehouse: str) -> dict[str, DataFrame]:
    """The four base tables; counts carry their ``ingest_id``, so that extracts read the partitions of their ingests only."""
    return {t: read_table(spark, warehouse, t, with_ingest=True) for t in BASE_TABLES}


def next_id(spark: SparkSession, warehouse: str, table: str, column: str = "id",
            schema: T.StructType | None = None) -> int:
    """First free id of a table; rows that were never committed keep their ids reserved."""
    if not path_exists(spark, f"{warehouse}/{table}"):
        return 0
    stored = scan(spark, f"{warehouse}/{table}", stored_schema(schema or BASE_TABLES[table]))
    return stored.agg(F.coalesce(F.max(column) + 1, F.lit(0)).alias("n")).first()["n"]


def read_staged_counts(spark: SparkSession, directories: str | list[str]) -> DataFrame:
    """Header-less ``cell_id,feature_id,raw_count`` triples of staging directories."""
    listed = [directories] if isinstance(directories, str) else list(directories)
    return spark.read.schema(RAW_MATRIX_COO).option("mode", "FAILFAST").csv(
        [f"{d}/{RAW_COUNTS_PATTERN}" for d in listed], header=False
    )


def read_staged(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The four tables of one staging directory."""
    tables = {
        name: scan(spark, f"{directory}/{name.replace('_', '-')}.parquet", BASE_TABLES[name])
        for name in ("ingest_info", "cell_info", "feature_info")
    }
    return {**tables, "raw_matrix_coo": read_staged_counts(spark, directory)}


def _write(df: DataFrame, path: str, schema: T.StructType, sort_column: str, placed: bool = False) -> None:
    """Replaces the ingests present in ``df``; rebalancing splits a hot ingest into even files.

    ``placed`` says that rows lie together and in order as they are, which saves the exchange.
    """
    rows = conform(df, schema)
    if not placed:
        blocked = rows.withColumn("_block", F.call_function("div", F.col(sort_column), F.lit(IDS_PER_BLOCK)))
        rows = blocked.hint("rebalance", F.col("ingest_id"), F.col("_block")).drop("_block").sortWithinPartitions("ingest_id", sort_column)
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_id").parquet(path)
    )


def append_together(spark: SparkSession, warehouse: str, tables: Mapping[str, DataFrame],
                    schemas: Mapping[str, T.StructType], sort_columns: Mapping[str, str],
                    commits: DataFrame | None = None, placed: Collection[str] = (),
                    check: Callable[[], None] | None = None) -> DataFrame:
    """Writes all tables, each with an ``ingest_id`` column, then commits their ingests; returns the skipped ``ingest_id``.

    Nothing is visible before the last statement: if any write fails, no commit row is added. A
    rerun replaces what a failed run left behind and leaves committed ingests as they are: these are skipped.
    ``commits`` holds further columns per ``ingest_id`` for the commit rows, ``placed`` names tables whose rows lie in order, and
    ``check`` runs after the writes: what it raises keeps them uncommitted.
    """
    fresh, skipped = dict(tables), spark.createDataFrame([], COMMITS)
    first = next(iter(schemas))
    if path_exists(spark, f"{warehouse}/commits"):
        committed = freeze(read_commits(spark, warehouse))
        small = fits_broadcast(committed)
        fresh = {t: join_dimension(tables[t], committed, "ingest_id", "left_anti", fits=small) for t in schemas}
        asked = tables[first].select(F.col("ingest_id").cast("bigint").alias("ingest_id")).distinct()
        skipped = freeze(join_dimension(asked, committed, "ingest_id", "left_semi", fits=small))
    for table, schema in schemas.items():
        _write(fresh[table], f"{warehouse}/{table}", stored_schema(schema), sort_columns[table], **({"placed": True} if table in placed else {}))
    if check:
        check()
    ids = fresh[first].select(F.col("ingest_id").cast("bigint").alias("ingest_id")).distinct()
    rows = ids if commits is None else ids.join(commits, "ingest_id")
    # A folder of its own, so that writers never share a job's temporary files.
    rows.write.parquet(f"{warehouse}/commits/writer={uuid.uuid4().hex}")
    return skipped


GRACE_SECONDS = 24 * 3600


def vacuum(spark: SparkSession, warehouse: str, tables: Iterable[str] = tuple(BASE_TABLES),
           grace_seconds: float = GRACE_SECONDS, now: float | None = None) -> DataFrame:
    """Removes rows of ingests that were never committed; returns ``(table_name, ingest_id)`` of what went.

    A running writer's rows look the same until it commits, so only folders that did not change for ``grace_seconds`` go: the
    grace must be longer than any ingest takes. Staging folders that writers left go alike.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(warehouse)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    before = ((time.time() if now is None else now) - grace_seconds) * 1000
    old = []
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{warehouse}/{table}")
        for status in fs.listStatus(path) if fs.exists(path) else []:
            name, changed = status.getPath().getName(), status.getModificationTime()
            if status.isDirectory() and name.startswith("ingest_id="):
                inside = [s.getModificationTime() for s in fs.listStatus(status.getPath())]
                if max([changed, *inside]) < before:
                    old.append((table, int(name.removeprefix("ingest_id="))))
            elif status.isDirectory() and name.startswith(".spark-staging-") and changed < before:
                fs.delete(status.getPath(), True)
    # Commits are read after the folders: what was committed meanwhile stays.
    listed = spark.createDataFrame(old, "table_name string, ingest_id bigint")
    gone = freeze(join_dimension(listed, read_commits(spark, warehouse), "ingest_id", "left_anti", salt_on="table_name"))
    for row in gone.collect():  # one row per folder of a failed run
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{warehouse}/{row['table_name']}/ingest_id={row['ingest_id']}"), True)
    return gone.select("table_name", "ingest_id")


def append_ingests(spark: SparkSession, warehouse: str, tables: Mapping[str, DataFrame], placed: Collection[str] = (),
                   check: Callable[[], None] | None = None) -> DataFrame:
    """Appends one or many ingests to the four base tables at once; returns the ``ingest_id`` that were committed before.

    ``raw_matrix_coo`` carries ``ingest_id`` besides its own columns.
    """
    rows = {**tables, "ingest_info": tables["ingest_info"].withColumn("ingest_id", F.col("id"))}
    return append_together(spark, warehouse, rows, BASE_TABLES, CLUSTER_COLUMN, placed=placed, check=check)


def append_staged(spark: SparkSession, warehouse: str, directory: str) -> DataFrame:
    """Commits one staging directory, whose counts all belong to its single ingest; returns its id if it was committed before."""
    staged = read_staged(spark, directory)
    ids = [r["id"] for r in staged["ingest_info"].limit(2).collect()]
    if len(ids) != 1:
        raise ValueError(f"{directory} must hold exactly one ingest")
    counts = staged["raw_matrix_coo"].withColumn("ingest_id", F.lit(ids[0]).cast("bigint"))
    return append_ingests(spark, warehouse, {**staged, "raw_matrix_coo": counts})
