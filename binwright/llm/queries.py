"""One query per corpus operator over its whole table, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from binwright.llm import chat, decontaminate, exact_dedup, jaccard, langid, line_dedup, minhash, phrases, pieces, pii, quality, runs, token_files
from binwright.llm.common import table


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup_report(table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_report(table(spark, folder, "documents"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files_report(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(rows))


def op7_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(table(spark, folder, "documents"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.pieces_report(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.top_phrases(table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.runs_report(table(spark, folder, "documents"))


def op13_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_line_dedup, op3_quality, op4_language, op5_token_files, op6_chat_format, op7_jaccard,
    op8_personal_data, op9_decontaminate, op10_pieces, op11_phrases, op12_periodic_runs,
    op13_near_duplicates,
)}
ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE, "op2_line_dedup": line_dedup.ORACLE, "op6_chat_format": chat.ORACLE}
