"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes.

Learning takes, per language, a bounded sample of labelled texts (``EXCERPTS`` excerpts of ``EXCERPT_CHARS``
letters each, picked by a hash of the row) as a raw-content dictionary for zstandard. A whole text is reduced
to lower-case letters and single spaces, cut into pieces of ``PIECE`` bytes, and every piece is encoded with
every dictionary; sizes are summed. Short pieces keep each dictionary in use along the whole text.

The answer is rejected (``rejected`` true) when the second-best is within ``MARGIN`` of the best; ``lang_pred``
still names the best, and ties go to the language with more labelled rows.

Defined cases: null text, or one without a letter, is ``und`` with score 0. Without any labelled row every
text is ``und``. A null or repeated ``doc_id`` is carried along; rows with a null id are learned from only
if ``learn`` says so. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binwright.llm.common import held_out, ship, text_or_empty

EXCERPTS = 32
EXCERPT_CHARS = 1000
PIECE = 1500
LEVEL = 7
MARGIN = 0.01
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case letters, one space for everything between them."""
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def learn(docs: DataFrame, use: Column, excerpts: int = EXCERPTS) -> list[tuple[str, bytes]]:
    """Languages, most rows first, with their dictionaries. Reads rows where ``use`` holds and lang is not null."""
    rows = docs.where(use & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text")
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    # About four times the wanted rows of each language pass the hash, so the ranking below sees few rows.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * excerpts / n))])
    rank = F.pmod(F.xxhash64(F.lit("excerpt"), "doc_id"), F.lit(2**31))
    picked = rows.withColumn("rank", rank).where(F.col("rank") < share[F.col("lang")] * 2**31)
    start = (F.pmod(F.xxhash64(F.lit("start"), "doc_id"), F.lit(2**31)) / 2**31 * F.greatest(F.length("text") - EXCERPT_CHARS, F.lit(0))).cast("int") + 1
    picked = picked.select("lang", "rank", F.substring("text", start, F.lit(EXCERPT_CHARS)).alias("text"))
    first = Window.partitionBy("lang").orderBy("rank", "text")
    picked = picked.withColumn("n", F.row_number().over(first)).where(F.col("n") <= excerpts)
    texts: dict[str, list[str]] = {k: [] for k in sorted(counts, key=lambda k: (-counts[k], k))}
    for r in picked.orderBy("lang", "n").collect():  # at most excerpts rows of bounded length per language
        texts[r["lang"]].append(letters(r["text"]))
    return [(lang, " ".join(parts).encode("utf-8", "surrogatepass")) for lang, parts in texts.items() if any(parts)]


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]]) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), rejected."""
    ship(docs.sparkSession)
    names = [lang for lang, _ in dictionaries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coders = []
        for _, content in dictionaries:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                plain = letters(text).encode("utf-8", "surrogatepass")
                if not plain or not coders:
                    out.append((UNKNOWN, 0.0, True))
                    continue
                pieces = [plain[i : i + PIECE] for i in range(0, len(plain), PIECE)]
                sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in coders], float)
                best = int(sizes.argmin())
                others = np.delete(sizes, best)
                score = float(1 / np.exp(-np.minimum(sizes - sizes[best], 200.0) / 4).sum())
                out.append((names[best], score, bool(len(others) and others.min() < sizes[best] * (1 + MARGIN))))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def language_report(docs: DataFrame) -> DataFrame:
    """Learn from the folds that may be learned from, and predict every row."""
    dictionaries = learn(docs, ~held_out())
    return identify(docs, dictionaries).withColumn("held_out", held_out())
