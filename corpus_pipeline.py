"""A corpus pipeline: each stage works on all that the one before kept, written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

1. ``quality``: rows that the classifier rejects go.
2. ``line_dedup``: repeated lines go, those with one word edited too; a document all of whose lines went goes with them.
3. ``jaccard``: of each component of similar documents (five-word shingles, 80 %) the one with the least doc_id stays.
4. ``decontaminate``: documents with a benchmark passage go.
5. ``pieces``: token counts and digests of the ids and of the decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binwright.llm import decontaminate, jaccard, line_dedup, pieces, quality
from binwright.llm.common import SPACES, stored, table


SHINGLE = 5
PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(docs, word_edits=True)
    emptied = (F.col("n_kept_lines") < F.col("n_lines")) & (F.regexp_replace("text", SPACES, "") == "")
    kept = out.where(~emptied).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined = jaccard.jaccard_components(docs, SHINGLE, PERCENT)
    gone = joined.where("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.pieces_report(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard", jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("pieces", pieces_stage),
]

# The classifier, the latent search and the tokenizer are not SQL: tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
