"""Exact deduplication: local winners, salted digest groups, global winners; content compared at every stage.

Texts are equal when they are identical after each run of white space became one space. Only the full
text decides: the digest distributes rows and names classes, and every grouping below has the text itself
among its keys.

1. *Local*: the map side of the first aggregation leaves one row per text and task.
2. *Salted*: a digest with more rows than one task should see is dealt over ``salts`` groups by input
   split; every other digest has one group. Texts move once.
3. *Global*: the few salt winners of such digests meet by digest and text. All other rows are final and
   pass without their text.

Rows get their class by digest, without text. Two texts with one digest are found by counting classes per
digest; their rows are joined by text instead.

Defined cases: null text counts as empty, so null, empty and (apart from one space) blank texts follow the
same rule as any text. ``keep_id`` is the smallest non-null ``doc_id`` of the class, null if there is none.
Rows that repeat the winner's ``doc_id`` are all ``kept``. An empty table gives no rows. Other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binwright.llm.common import SPACES, id_and_text, stored

HOT_LIST = 10_000  # a digest is hot above total / HOT_LIST rows, so at most HOT_LIST digests are hot
HOT_ROWS = 256  # and never below this many rows
SALTS = 32


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest (binary)."""
    rows = id_and_text(docs).withColumn("text", F.regexp_replace("text", SPACES, " "))
    rows = rows.withColumn("digest", digest(F.col("text")))
    prints = stored(rows.select("doc_id", "digest"), "digests")

    limit = max(HOT_ROWS, prints.count() // HOT_LIST)
    hot = stored(
        prints.groupBy("digest").count().where(F.col("count") > limit).select("digest", F.lit(True).alias("hot")),
        "hot_digests",
    )
    split = rows.join(F.broadcast(hot), "digest", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    salted = split.withColumn("salt", F.when(F.col("hot"), F.pmod(F.hash(F.spark_partition_id()), salts)).otherwise(0))
    winners = salted.groupBy("digest", "hot", "salt", "text").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    # A class that is final already is told apart by its own values; one that is not, by its text.
    final = F.struct("keep_id", "group_size", F.length("text"), F.xxhash64("text"))
    classes = stored(
        winners.select(
            "digest", "keep_id", "group_size", "hot",
            F.when(F.col("hot"), F.col("text")).alias("text"), F.when(~F.col("hot"), final).alias("final"),
        )
        .groupBy("digest", "hot", "text", "final")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .select("digest", "hot", "keep_id", "group_size"),
        "classes",
    )
    several = classes.groupBy("digest").count().where("count > 1").select("digest")
    prints = prints.join(F.broadcast(hot), "digest", "left")
    # At most HOT_LIST digests are hot; while no digest has two texts, so are their classes.
    if several.isEmpty():
        found = _classed(prints.where("hot IS NULL"), classes.where("NOT hot")).unionByName(
            _classed(prints.where("hot"), F.broadcast(classes.where("hot")))
        )
    else:
        several = stored(several.withColumn("several", F.lit(True)), "shared_digests")
        texts = rows.join(several, "digest", "left_semi")
        by_text = texts.groupBy("digest", "text").agg(
            F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        found = _classed(
            prints.join(several, "digest", "left_anti"), classes.join(several, "digest", "left_anti")
        ).unionByName(
            texts.join(by_text, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size")
        )
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def _classed(prints: DataFrame, classes: DataFrame) -> DataFrame:
    return prints.select("doc_id", "digest").join(classes.select("digest", "keep_id", "group_size"), "digest").select(
        "doc_id", "digest", "keep_id", "group_size"
    )


def exact_dedup_report(docs: DataFrame) -> DataFrame:
    """The result with the digest as lower-case hex."""
    return exact_dedup(docs).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         sha256(norm) AS text_sha256
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
