"""Phrase collocations per language, from count streams in prefix and in suffix order.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and those into words. A phrase of 2 to 4 words
with at least ``LEAST`` occurrences is a candidate. Its score is floor(2000000 a / (l + r)), for the cut into a first part (l
occurrences) and a rest (r) that scores lowest; candidates that occur mostly inside a longer one go.

1. *Counts*, one pass per length. A task numbers the words of a block, sorts the block's phrases and sends each distinct one
   with its count; sums are by language and phrase. A phrase can only reach ``LEAST`` if both its parts without the last and
   without the first word do, so the later passes skip others. Which phrases reached it is told by a bit table of fixed
   size whose errors only let more through: results are exact counts, whatever its filling.
2. *Streams.* The frequent phrases of all lengths are written in prefix order (language, first word, second word, ...) and in
   suffix order (last word, the one before, ...). There a phrase stands before all that extend it to the right, or to the
   left; so one pass with a stack of at most four phrases reads off, in lockstep, the counts of all first parts (of all last
   parts) and the most frequent extension by one word. Longer extensions occur no oftener. Streams are cut into ranges of
   keys; what is on the stack where a range ends is carried into the next (four phrases a range pass the driver).
3. The results of both streams are merged by phrase in key order (sort aggregation), scored with exact decimals, and each
   language's first ``TOP`` are kept.

No task holds a language, a word or a phrase whole: counts are summed per block before they are sent, ranges are cut at any
phrase, ranks are cut to ``TOP`` before rows of a language meet.

Defined cases: null, empty and blank texts have no words; a null lang is ``und``, together with rows whose lang is that.
Repeated rows count each. Ties are ordered by occurrences, then phrase in UTF-8 byte order. A language without candidates
has no rows, nor has an empty table. Columns beside ``text`` and ``lang`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binwright.llm.common import ship, stored, text_or_empty
from binwright.session import freeze

LEAST = 30  # occurrences of a candidate, at least
LONGEST = 4  # words of a candidate, at most
INSIDE = 80  # percent of a candidate's occurrences inside a longer one from which it goes
TOP = 2000  # candidates reported per language
SCALE = 2_000_000
BLOCK_WORDS = 1 << 20  # words that are counted together in a task; results don't depend on it
SLICE_CHARS = 1 << 20  # characters split into words at once
TABLE_BITS = 1 << 26  # of the table of frequent phrases: 8 MB

# What ends a piece, and the mark that stands for it (a byte that UTF-8 never holds).
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
MARK = b"\xff"
_TO_MARK = bytes.maketrans(PIECE_ENDS, MARK * len(PIECE_ENDS))
_COUNTS = "lang string, phrase string, n long"


def split_words(text: str) -> list[bytes]:
    """The words of a text, with MARK between pieces."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_TO_MARK)
    return data.replace(MARK, b" " + MARK + b" ").split()  # bytes: what white space is left is space and tab


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _phrase_hashes(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """Of phrases whose first, second, ... words have the given hashes."""
    out = np.full(len(words[0]), _word_hashes([lang.encode()])[0] + np.uint64(len(words)))
    for w in words:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each hash in a table of ``bits``."""
    size = np.uint64(bits)
    return np.stack((hashes % size, (hashes >> np.uint64(32)) % size)).astype(np.int64)


class _Numbers(dict):
    """Numbers words in order of first sight; 0 is MARK."""

    def __init__(self):
        super().__init__({MARK: 0})

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _distinct(columns: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The index of one of each distinct row and how many are equal, in sorted order."""
    key, size = columns[0].astype(np.int64), vocabulary
    for column in columns[1:]:
        if size * vocabulary >= 2**62:
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key, size = key * vocabulary + column, size * vocabulary
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return first, counts


def _block_counts(words: list[bytes], texts: dict[str, list[np.ndarray]], length: int, table: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of ``length`` words in a block; for single words, each language's total too, without a phrase."""
    spelled = np.array(words, object)
    hashes = _word_hashes(words) if length > 1 else None
    for lang, parts in texts.items():
        ids = np.concatenate(parts)
        if length == 1:
            counts = np.bincount(ids, minlength=1)
            counts[0] = 0
            first = np.flatnonzero(counts)
            phrases, counts = [*spelled[first].tolist(), None], [*counts[first].tolist(), int(counts.sum())]
        else:
            n = len(ids) - length + 2  # places where a phrase of one word less can start
            if n < 2:
                continue
            shorter = _phrase_hashes(lang, [hashes[ids[j : n + j]] for j in range(length - 1)])
            bits = _places(shorter, 8 * len(table))
            ok = ((table[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).all(0)
            for j in range(length - 1):
                ok &= ids[j : n + j] != 0
            at = np.flatnonzero(ok[:-1] & ok[1:])
            if not len(at):
                continue
            columns = [ids[at + j] for j in range(length)]
            first, counts = _distinct(columns, len(words))
            phrases = [b" ".join(p) for p in zip(*(spelled[c[first]].tolist() for c in columns), strict=True)]
            counts = counts.tolist()
        for i in range(0, len(phrases), 100_000):
            some = phrases[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array(counts[i : i + 100_000], pa.int64())],
                ["lang", "phrase", "n"],
            )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language, about SLICE_CHARS at a time."""
    for batch in batches:
        waiting: dict[str, list[str]] = {}
        size = 0
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            waiting.setdefault(lang, []).append(text)
            size += len(text)
            if size > SLICE_CHARS:
                yield from waiting.items()
                waiting, size = {}, 0
        yield from waiting.items()


def _counted(docs: DataFrame, length: int, table) -> DataFrame:
    """lang, phrase, n: sums over all texts, of the phrases of ``length`` words that the table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if table is None else table.value
        number, texts, held = _Numbers(), {}, 0
        for lang, some in _slices(batches):
            words = split_words("\n".join(some))
            texts.setdefault(lang, []).append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            texts[lang].append(np.zeros(1, np.int32))
            held += len(words) + 1
            if held >= BLOCK_WORDS:
                yield from _block_counts(list(number), texts, length, bits)
                number, texts, held = _Numbers(), {}, 0
        if held:
            yield from _block_counts(list(number), texts, length, bits)

    return docs.mapInArrow(run, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _table(frequent: DataFrame, bits: int) -> np.ndarray:
    """The bit table of these phrases. Its cells come to the driver: at most ``bits`` / 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(phrase.encode("utf-8", "surrogatepass").split(b" "))
            for lang, phrases in by_lang.items():
                places = _places(_phrase_hashes(lang, [_word_hashes(list(w)) for w in zip(*phrases, strict=True)]), bits).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places >> 6), pa.array(np.left_shift(np.int64(1), places & 63))], ["cell", "bits"]
                )

    cells = frequent.select("lang", "phrase").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return table.view(np.uint8)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of 1 to ``longest`` words with at least ``least`` occurrences, and (lang, n) of all words."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    words = stored(_counted(texts, 1, None).where(f"phrase IS NULL OR n >= {least}"), "words")
    every = [words.where("phrase IS NOT NULL")]
    for length in range(2, longest + 1):
        table = docs.sparkSession.sparkContext.broadcast(_table(every[-1], TABLE_BITS))
        every.append(stored(_counted(texts, length, table).where(f"n >= {least}"), "phrases"))
    frequent = every[0]
    for more in every[1:]:
        frequent = frequent.unionByName(more)
    return frequent, words.where("phrase IS NULL").select("lang", "n")


# A phrase on the stack: language, words in the order of its stream, occurrences (None if another range reports it), the
# occurrences of its beginnings, and of its most frequent extension.
_Entry = list


def _follow(rows: Iterator[tuple], stack: list[_Entry], report: Callable[[_Entry], None]) -> list[_Entry]:
    """One pass over (lang, words, n) in stream order; ``stack`` holds what was on it before. Returns what is left."""
    for lang, words, n in rows:
        while stack and (stack[-1][0] != lang or len(stack[-1][1]) >= len(words) or words[: len(stack[-1][1])] != stack[-1][1]):
            report(stack.pop())
        if stack:
            stack[-1][4] = max(stack[-1][4], n)
        stack.append([lang, words, n, [e[2] for e in stack], 0])
    return stack


def _stream(frequent: DataFrame, longest: int, suffix: bool) -> DataFrame:
    """lang, phrase, n, parts (occurrences of its beginnings of 1, 2, ... words; endings if ``suffix``) and extension.

    A range that ends on a phrase may report it for the next too, with no n: ``extension`` is the most over all of its rows.
    """
    words = F.split("phrase", " ")
    ordered = F.reverse(words) if suffix else words
    keys = [f"w{i}" for i in range(longest)]
    wide = frequent.select("lang", "n", *[F.get(ordered, F.lit(i)).alias(k) for i, k in enumerate(keys)])
    order = ["lang", *[F.col(k).asc_nulls_first() for k in keys]]
    # A checkpoint keeps the ranges and the order of rows in them, for both passes.
    stream = freeze(wide.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long")))

    def rows(batch):
        columns = [batch.column(k).to_pylist() for k in keys]
        for lang, n, *ws in zip(batch.column("lang").to_pylist(), batch.column("n").to_pylist(), *columns, strict=True):
            yield lang, tuple(w for w in ws if w is not None), n

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, part = [], []
        for batch in batches:
            stack, part = _follow(rows(batch), stack, lambda e: None), batch.column("part")[:1].to_pylist() or part
        if stack:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(part * len(stack), pa.int64()), "lang": [e[0] for e in stack],
                "words": pa.array([list(e[1]) for e in stack], pa.list_(pa.string())), "n": pa.array([e[2] for e in stack], pa.int64()),
            })

    left: dict[int, list[tuple]] = {}
    for r in stream.mapInArrow(ends, "part long, lang string, words array<string>, n long").collect():  # four rows a range
        left.setdefault(r.part, []).append((r.lang, tuple(r.words), r.n))
    carried: dict[int, list[tuple]] = {}
    now: list[tuple] = []
    for part in range(stream.rdd.getNumPartitions()):
        carried[part] = now
        if part in left:
            own = sorted(left[part], key=lambda e: len(e[1]))
            lang, last, _ = own[-1]
            now = [e for e in now if e[0] == lang and len(e[1]) < len(own[0][1]) and last[: len(e[1])] == e[1]] + own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, done = None, []
        for batch in batches:
            if stack is None and batch.num_rows:
                stack = [[lang, words, n, None, 0] for lang, words, n in carried[batch.column("part")[0].as_py()]]
            stack = _follow(rows(batch), stack or [], done.append)
            yield _reported(done, suffix)
            done.clear()
        yield _reported(stack or [], suffix)

    return stream.mapInArrow(run, "lang string, phrase string, n long, parts array<long>, extension long")


def _reported(entries: list[_Entry], suffix: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([e[0] for e in entries], pa.string()),
        pa.array([" ".join(e[1][::-1] if suffix else e[1]) for e in entries], pa.string()),
        pa.array([None if e[3] is None else e[2] for e in entries], pa.int64()),
        pa.array([e[3] for e in entries], pa.list_(pa.int64())),
        pa.array([e[4] for e in entries], pa.int64()),
    ], ["lang", "phrase", "n", "parts", "extension"])


def scored_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a, l, r, score) of every candidate that stays, and (lang, n) of all words."""
    frequent, totals = phrase_counts(docs, least, longest)
    none = F.lit(None).cast("array<bigint>")
    prefix = _stream(frequent, longest, False).select("lang", "phrase", "n", F.col("parts").alias("firsts"), none.alias("lasts"), "extension")
    suffix = _stream(frequent, longest, True).select("lang", "phrase", "n", none.alias("firsts"), F.col("parts").alias("lasts"), "extension")
    merged = prefix.unionByName(suffix).groupBy("lang", "phrase").agg(
        F.max("n").alias("a"), F.max("firsts").alias("firsts"), F.max("lasts").alias("lasts"), F.max("extension").alias("extension")
    ).where(f"size(firsts) > 0 AND 100 * extension < {inside} * a")
    score = (
        f"(CAST({SCALE} AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(19, 0))) div"
        " (CAST(firsts[k - 1] AS DECIMAL(19, 0)) + CAST(lasts[size(lasts) - k] AS DECIMAL(19, 0)))"
    )
    cut = F.expr(
        f"array_min(transform(sequence(1, size(firsts)), k -> struct({score} AS score, k AS k, firsts[k - 1] AS l, lasts[size(lasts) - k] AS r)))"
    )
    return merged.withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), totals


def top_phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` candidates: lang, rank, phrase, a, l, r, n, score."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found, totals = scored_phrases(docs)
    # Each task keeps its first ``top`` of a language before the languages are brought together.
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
