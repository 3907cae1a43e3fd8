"""Line deduplication across documents, exact and within one edit, by a deletion-neighbourhood join.

Lines are compared after runs of white space became one space and the ends were trimmed; blank lines always
stay. Lines come in order of (doc_id, line number). A line goes if an earlier line is equal, or, for lines of
at least ``MIN_CHARS`` characters, within one edit (insert, delete or replace a character), whether that
earlier line itself stays or not. With ``word_edits`` a line of at least ``MIN_WORDS`` words also goes if an earlier one
of at least so many is within one edit of a word (insert, delete or replace it, whatever its length). op2 is without
word edits, as its SQL says; the pipeline is with them. Word edits take steps 2 to 5 with words in place of characters.

1. Equal lines: grouped by SHA-256; the earliest is the line's one occurrence from here on.
2. Which lines can have a partner at all: two lines within one edit share their first or their second half
   (cut at half of the shorter length), so only lines that share a half with another line go on. This loses nothing.
3. Those emit, as hashed keys, themselves and every deletion in the half where the edit can be.
4. Equal variants meet. Within a variant, lines that lost the same place differ by a replacement there, and a line
   that is the variant differs by an insertion from the others; so the earliest of each kind is enough, and a group
   gives at most two pairs for each of its lines.
5. Pairs are verified on the texts: by edit distance, or by comparing what is left without the word that was deleted.

Defined cases: null text is empty and stays so. Rows that repeat both doc_id and text count as one document and
all come out alike. A null doc_id sorts first. An empty table gives no rows. Columns other than doc_id and text pass
through ``drop_repeated_lines`` unchanged; the report reads only those two.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binwright.llm.common import SPACES, doc_key, joined, ship, stored, text_or_empty

MIN_CHARS = 20
MIN_WORDS = 8  # one word of these is an eighth of the line
WHITE = " \t\n\x0b\x0c\r"  # the characters of SPACES
ORDER = ["doc_id", "row_key", "line_no"]


def _words() -> Column:
    return F.split("line", " ")


def _without(words: Column, gone: Column) -> Column:
    """``words`` without the one at ``gone``; all of them if that is negative."""
    left = F.concat(F.slice(words, F.lit(1), F.greatest(gone, F.lit(0))), F.slice(words, gone + 2, F.size(words)))
    return F.when(gone < 0, words).otherwise(left)


def _halves(line: Column, n: Column, cut=F.substring) -> Column:
    """Keys of the two halves, once with this line as the shorter or equal one and once as the longer."""
    keys = []
    for shorter in (n, n - 1):
        half = F.floor(shorter / 2).cast("int")
        first, second = cut(line, F.lit(1), half), cut(line, n - (shorter - half) + 1, shorter - half)
        keys += [F.xxhash64(F.lit("first"), shorter, first), F.xxhash64(F.lit("second"), shorter, second)]
    return F.array(*keys)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id (null: NO_ID), row_key, line_no, line (normal form, not blank)."""
    rows = docs.select(doc_key().alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("row_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.trim(F.regexp_replace("line", SPACES, " "))).where("line != ''")


def near_repeats(lines: DataFrame, distinct: DataFrame, words: bool = False) -> DataFrame:
    """Places (doc_id, row_key, line_no) of first occurrences that have an earlier line within one edit of a character or word.

    ``keys`` of ``distinct`` are the halves' keys, null for lines that are too short.
    """
    keyed = distinct.where("keys IS NOT NULL")
    again = stored(
        keyed.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1").select("key"), "shared_halves"
    )
    halves = keyed.select(*ORDER, F.posexplode("keys").alias("which", "key"))
    chosen = stored(
        joined(halves, again, ["key"], "left_semi").groupBy(*ORDER).agg(
            F.max(F.col("which") % 2 == 0).alias("same_first"), F.max(F.col("which") % 2 == 1).alias("same_second")
        ),
        "lines_with_partners",
    )
    place = F.struct(*[F.col(c) for c in ORDER])
    candidates = stored(
        joined(lines, chosen, ORDER, "inner").select(place.alias("place"), "line", "same_first", "same_second").dropDuplicates(["place"]),
        "candidate_lines",
    )
    n = F.size(_words()) if words else F.length("line")
    half = F.floor(n / 2).cast("int")
    gone = F.concat(
        F.array(F.lit(-1)),  # the line itself
        F.when(F.col("same_second"), F.sequence(F.lit(0), F.greatest(half, F.lit(0)))).otherwise(F.array().cast("array<int>")),
        F.when(F.col("same_first"), F.sequence(F.greatest(half - 1, F.lit(0)), n - 1)).otherwise(F.array().cast("array<int>")),
    )
    variants = candidates.select("place", "line", F.explode(F.array_distinct(gone)).alias("gone"))
    variant = _without(_words(), F.col("gone")) if words else F.when(F.col("gone") < 0, F.col("line")).otherwise(
        F.concat(F.expr("substring(line, 1, gone)"), F.expr("substring(line, gone + 2)"))
    )
    if words:
        return _met_without_a_word(variants.select(F.xxhash64(variant).alias("variant"), "gone", "place"), candidates)
    variants = variants.select(F.xxhash64(variant).alias("variant"), "gone", "place")
    same, group = Window.partitionBy("variant", "gone"), Window.partitionBy("variant")
    met = variants.select(
        "place",
        F.when(F.col("gone") >= 0, F.min("place").over(same)).alias("replaced"),
        F.when(F.col("gone") >= 0, F.min(F.when(F.col("gone") < 0, F.col("place"))).over(group))
        .otherwise(F.min(F.when(F.col("gone") >= 0, F.col("place"))).over(group)).alias("inserted"),
    )
    pairs = met.select("place", F.explode(F.array("replaced", "inserted")).alias("earlier")).where("earlier < place").distinct()
    texts = candidates.select("place", "line")
    checked = pairs.join(texts, "place").join(texts.toDF("earlier", "earlier_line"), "earlier")
    return checked.where(F.levenshtein("line", "earlier_line", 1) >= 0).select("place.*").distinct()


def _met_without_a_word(variants: DataFrame, candidates: DataFrame) -> DataFrame:
    """Steps 4 and 5 for words. The earliest of each kind comes from a sum per variant: many near copies of a line
    are not one task, as in a window they would be."""
    lost = variants.groupBy("variant", "gone").agg(F.min("place").alias("place"))
    replaced = lost.where("gone >= 0").select("variant", "gone", F.struct("place", F.col("gone").alias("at")).alias("earlier"))
    each = F.struct("place", F.col("gone").alias("at"))
    kinds = lost.groupBy("variant").agg(F.min(F.when(F.col("gone") < 0, each)).alias("whole"), F.min(F.when(F.col("gone") >= 0, each)).alias("cut"))
    inserted = kinds.where("whole IS NOT NULL AND cut IS NOT NULL")
    met = variants.join(replaced, ["variant", "gone"]).select("place", "gone", "earlier").unionByName(
        variants.join(inserted, "variant").select("place", "gone", F.when(F.col("gone") < 0, F.col("cut")).otherwise(F.col("whole")).alias("earlier"))
    )
    pairs = met.where("earlier.place < place").select("place", "gone", F.col("earlier.place").alias("earlier"), F.col("earlier.at").alias("at")).distinct()
    texts = candidates.select("place", _words().alias("words"))
    checked = pairs.join(texts, "place").join(texts.toDF("earlier", "earlier_words"), "earlier")
    same = _without(F.col("words"), F.col("gone")) == _without(F.col("earlier_words"), F.col("at"))
    return checked.where(same).select("place.*").distinct()


def kept_lines(docs: DataFrame, word_edits: bool = False) -> DataFrame:
    """Per document (doc_id or NO_ID, row_key) the numbers of its not blank lines that stay; none if none stay."""
    lines = _lines(docs)
    n, n_words = F.length("line"), F.size(_words())
    keys = {"keys": F.when(n >= MIN_CHARS, _halves(F.col("line"), n))}
    if word_edits:
        keys["word_keys"] = F.when(n_words >= MIN_WORDS, _halves(_words(), n_words, F.slice))
    marked = lines.select(F.unhex(F.sha2("line", 256)).alias("digest"), F.struct(*ORDER).alias("place"), *[v.alias(k) for k, v in keys.items()])
    distinct = stored(
        marked.groupBy("digest").agg(F.min("place").alias("place"), *[F.first(k).alias(k) for k in keys]).select("place.*", *keys),
        "distinct_lines",
    )
    near = near_repeats(lines, distinct.select(*ORDER, "keys"))
    if word_edits:
        by_word = near_repeats(lines, distinct.select(*ORDER, F.col("word_keys").alias("keys")), words=True)
        near = near.unionByName(by_word).distinct()
    near = stored(near, "near_repeats")
    stay = joined(distinct.select(*ORDER), near, ORDER, "left_anti") if not near.isEmpty() else distinct.select(*ORDER)
    return stay.groupBy("doc_id", "row_key").agg(F.collect_list("line_no").alias("stay"))


def drop_repeated_lines(docs: DataFrame, word_edits: bool = False) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, and n_lines and n_kept_lines added."""
    if clash := {"n_lines", "n_kept_lines", "_row_key", "_stay"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist already")
    ship(docs.sparkSession)
    stay = kept_lines(docs, word_edits).toDF("_doc_id", "_row_key", "_stay")
    rows = docs.withColumn("_row_key", F.xxhash64(text_or_empty())).alias("d")
    same = (doc_key("d.doc_id") == F.col("s._doc_id")) & (F.col("d._row_key") == F.col("s._row_key"))
    rows = rows.join(stay.alias("s"), same, "left").select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("s._stay").alias("_stay"))
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, kept = [], [], []
            for text, stay in zip(batch.column("text").to_pylist(), batch.column("_stay").to_pylist(), strict=True):
                lines, stays = (text or "").split("\n"), set(stay or ())
                left = [x for i, x in enumerate(lines) if i in stays or not x.strip(WHITE)]
                texts.append("\n".join(left))
                totals.append(len(lines))
                kept.append(len(left))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(kept, pa.int64())], [*names, "n_lines", "n_kept_lines"])

    return rows.mapInArrow(run, f"{fields}, n_lines long, n_kept_lines long")


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept_lines and the digest of the text that stays."""
    out = drop_repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", "n_lines", "n_kept_lines", F.sha2("text", 256).alias("text_sha256"))


ORACLE = r"""
WITH split_up AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents
), lines AS (
  SELECT doc_id, unnest(range(len(raw))) AS line_no, unnest(raw) AS raw_line FROM split_up
), normal AS (
  SELECT *, trim(regexp_replace(raw_line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM lines
), firsts AS (
  SELECT line, length(line) AS n, min(struct_pack(doc_id := doc_id, line_no := line_no)) AS place FROM normal WHERE line != '' GROUP BY line
), halves AS (
  SELECT *, unnest([struct_pack(l := n, f := true, h := left(line, n // 2)), struct_pack(l := n, f := false, h := substr(line, n // 2 + 1)),
    struct_pack(l := n - 1, f := true, h := left(line, (n - 1) // 2)),
    struct_pack(l := n - 1, f := false, h := right(line, n - 1 - (n - 1) // 2))]) AS k FROM firsts WHERE n >= 20
), near AS (
  SELECT DISTINCT b.place FROM halves a JOIN halves b ON a.k = b.k
  WHERE a.place < b.place AND abs(a.n - b.n) <= 1 AND len(list_filter(range(greatest(a.n, b.n)), lambda p:
    left(a.line, p) = left(b.line, p)
    AND CASE WHEN a.n = b.n THEN substr(a.line, p + 2) = substr(b.line, p + 2)
        WHEN a.n < b.n THEN substr(a.line, p + 1) = substr(b.line, p + 2) ELSE substr(a.line, p + 2) = substr(b.line, p + 1) END)) > 0
), stay AS (
  SELECT place FROM firsts WHERE place NOT IN (SELECT place FROM near)
), kept AS (
  SELECT doc_id, count(*) AS n_kept_lines, string_agg(raw_line, chr(10) ORDER BY line_no) AS text FROM normal
  WHERE line = '' OR struct_pack(doc_id := doc_id, line_no := line_no) IN (SELECT place FROM stay) GROUP BY doc_id
)
SELECT s.doc_id, len(raw) AS n_lines, coalesce(n_kept_lines, 0) AS n_kept_lines, sha256(coalesce(k.text, '')) AS text_sha256
FROM split_up s LEFT JOIN kept k USING (doc_id)
"""
