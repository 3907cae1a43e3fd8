"""Periodic runs of words, found by online dyadic square catching.

A run is a stretch of consecutive words with least period q (words q apart are equal), at least ``LEAST`` words and
``TIMES`` periods long, that no neighbouring word extends keeping period q.

Words arrive at a ``Catcher`` in any portions. Each completed block of 2^k words, aligned to multiples of 2^k, has a
catcher that watches for its copy 2 * 2^k to 4 * 2^k - 1 words later: the suffix that ends at an appended word has two
such blocks per k. The first half of a square of period q >= 2 * 2^k holds an aligned block of 2^k words, so every square is
caught at the level of its period. Suffixes are compared by prefix hashes, all appended words of a portion at once; a hit
is verified word by word and extended to both sides. A stretch that reaches the last word stays open, and each appended
word advances its comparison. Stretches of at least two periods are squares; those of the same period that overlap are one
stretch by then, and multiples of a smaller period merge into its run. For periods below 8, blocks of 8 watch for copies 1
to 7 words later: a stretch of ``LEAST`` words holds such a block with its copy. Documents follow each other in one stream,
parted by words that equal no other, in order of length.

Work is n log n per document and its memory a few numbers per word; tasks hold a portion of a batch of documents, or one
long document. Nothing is shuffled.

Defined cases: null and empty texts, and texts without words, have no runs and an empty collapsed text. Overlapping runs
of different periods are all reported; a word goes if any of them contains it after its first period. Equal documents have
equal results; a repeated or null doc_id is no matter, rows are independent. An empty table gives no rows. Columns beside
``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binwright.llm.common import SPACES, id_and_text, ship

LEAST = 24  # words of a run, at least
TIMES = 3  # periods of a run, at least
SMALLEST = 4  # words of the smallest blocks
NEAR = 2 * SMALLEST  # words of the blocks for periods below this: LEAST - (NEAR - 1) words hold an aligned one
PORTION = 1 << 16  # words that a catcher takes at once; results don't depend on it
BATCH_ROWS = 512

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(held: np.ndarray, n: int) -> np.ndarray:
    """``held`` or a copy with room for ``n`` entries."""
    if n <= len(held):
        return held
    out = np.empty(max(n, 2 * len(held)), held.dtype)
    out[: len(held)] = held
    return out


class Catcher:
    """Squares and runs of a growing word sequence."""

    def __init__(self) -> None:
        self.n = 0
        self.words = np.empty(1024, np.int64)
        self.sums = np.zeros(1025, np.uint64)  # of words' hashes times powers of the base: sums[i] covers the first i words
        self.powers = np.ones(1025, np.uint64)
        self.level_done: dict[int, int] = {}  # block length -> first window that was not compared yet
        self.open: list[tuple[int, int, int]] = []  # (start, period, square) of stretches that reach the last word
        self.cover = np.zeros(1024, np.int64)  # word -> a square stretch that holds it
        self.square_start, self.square_end, self.square_period = [0], np.zeros(1024, np.int64), np.ones(1024, np.int64)  # 0: none

    def append(self, words: np.ndarray, longest: int) -> None:
        """Take more words; ``longest`` bounds the length of the documents they belong to."""
        before, n = self.n, self.n + len(words)
        if n == before:
            return
        self.words, self.cover = _grown(self.words, n), _grown(self.cover, n)
        self.sums, self.powers = _grown(self.sums, n + 1), _grown(self.powers, n + 1)
        self.words[before:n], self.cover[before:n] = words, 0
        factors = np.full(n - before, _BASE, np.uint64)
        self.powers[before + 1 : n + 1] = np.cumprod(factors) * self.powers[before]
        self.sums[before + 1 : n + 1] = np.cumsum(_mixed(words.view(np.uint64) + np.uint64(_BASE)) * self.powers[before:n]) + self.sums[before]
        self.n = n
        still, self.open = self.open, []
        for start, period, square in still:  # the appended words advance what is open
            self._close(start, self._right(before - period, before), period, square, before if square else start)
        window = self._completed(0, before, NEAR)
        self._catch(window, window // NEAR * NEAR, NEAR)
        block = SMALLEST
        while 4 * block <= longest:  # small periods first: their multiples are known then
            window = self._completed(block, before, block)
            own = window // block * block
            self._catch(window, own - 2 * block, block)
            self._catch(window, own - 3 * block, block)
            block *= 2

    def _completed(self, level: int, before: int, block: int) -> np.ndarray:
        """The windows of ``block`` words that the last words completed, for a level that first sees words from ``before`` on."""
        first, end = self.level_done.get(level, before), self.n - block + 1
        self.level_done[level] = max(first, end)
        return np.arange(first, end)

    def _catch(self, window: np.ndarray, held: np.ndarray, block: int) -> None:
        """Compare the windows that start at ``window`` with the completed blocks that start at ``held``."""
        ok = (held >= 0) & (held < window)
        window, held = window[ok], held[ok]
        lag = window - held
        hit = self.sums[window + block] - self.sums[window] == (self.sums[held + block] - self.sums[held]) * self.powers[lag]
        window, held, lag = window[hit], held[hit], lag[hit]
        square = self.cover[held]
        known = (self.square_end[square] >= window + block) & (lag % self.square_period[square] == 0)
        window, held, lag = window[~known], held[~known], lag[~known]
        order = np.lexsort((window, lag))
        end, last = 0, 0
        for w, a, q in zip(window[order].tolist(), held[order].tolist(), lag[order].tolist(), strict=True):
            if q != last:
                last, end = q, max((self.n for s, p, _ in self.open if p == q and s <= a), default=0)
            if w + block <= end:
                continue  # inside the stretch that was found last
            if not np.array_equal(self.words[a : a + block], self.words[w : w + block]):
                continue  # hashes are equal, words are not
            start, end = self._left(a, w), self._right(a + block, w + block)
            self._close(start, end, q, 0, start)

    def _right(self, i: int, j: int) -> int:
        """The end of the stretch where words from j on equal those from i on."""
        step = 16
        while j < self.n:
            m = min(step, self.n - j)
            differ = self.words[i : i + m] != self.words[j : j + m]
            if differ.any():
                return j + int(differ.argmax())
            i, j, step = i + m, j + m, 2 * step
        return j

    def _left(self, i: int, j: int) -> int:
        """The start of the stretch where words before j equal those before i."""
        step = 16
        while i > 0:
            m = min(step, i)
            differ = self.words[i - m : i][::-1] != self.words[j - m : j][::-1]
            if differ.any():
                return i - int(differ.argmax())
            i, j, step = i - m, j - m, 2 * step
        return 0

    def _close(self, start: int, end: int, period: int, square: int, fresh: int) -> None:
        """A stretch of words period apart that are equal: kept open at the last word, a square if it has two periods.
        ``square`` is its number if it was one before; its words before ``fresh`` are covered by then."""
        of = self.cover[start]
        if of != square and self.square_end[of] >= end and period % self.square_period[of] == 0:
            return  # known, or a multiple of the period of a run
        if not square and end - start >= 2 * period:
            square = len(self.square_start)
            self.square_start.append(start)
            self.square_end, self.square_period = _grown(self.square_end, square + 1), _grown(self.square_period, square + 1)
            self.square_period[square] = period
        if square:
            self.square_end[square] = end
            held = self.cover[fresh:end]
            held[(self.square_end[held] < end) | (self.square_period[held] > period)] = square
        if end == self.n:
            self.open.append((start, period, square))

    def runs(self, least: int = LEAST, times: int = TIMES) -> np.ndarray:
        """Rows (start, length, period) in order of start and period."""
        squares: dict[tuple[int, int], int] = {}
        for i, start in enumerate(self.square_start[1:], 1):
            end, period = int(self.square_end[i]), int(self.square_period[i])
            squares[start, end] = min(period, squares.get((start, end), period))
        rows = [(s, e - s, q) for (s, e), q in squares.items() if e - s >= max(least, times * q)]
        return np.array(sorted(rows, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


class _Numbers(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def document_runs(texts: list[list[bytes]], portion: int = PORTION) -> list[np.ndarray]:
    """Per list of words the rows (start, length, period) of its runs."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if len(t) >= LEAST), key=lambda i: len(texts[i]))
    number, catcher, starts, waiting, held = _Numbers(), Catcher(), [], [], 0
    for k, i in enumerate(order):
        words = np.fromiter(map(number.__getitem__, texts[i]), np.int64, len(texts[i]))
        starts.append(catcher.n + held)
        waiting += [words, np.array([-1 - k])]
        held += len(words) + 1
        if held >= portion or k + 1 == len(order):
            stream = np.concatenate(waiting)
            for at in range(0, held, portion):
                catcher.append(stream[at : at + portion], len(words))
            waiting, held = [], 0
    rows = catcher.runs()
    owner = np.searchsorted(np.array(starts, np.int64), rows[:, 0], "right") - 1
    cuts = np.searchsorted(owner, np.arange(len(order) + 1))
    for k, i in enumerate(order):
        if cuts[k] < cuts[k + 1]:
            out[i] = rows[cuts[k] : cuts[k + 1]] - np.array([starts[k], 0, 0])
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs.tolist():
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, runs (array of start, length, period, in order of start and period) and the
    collapsed text: the words that no run contains after its first period, joined by one space."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = [t.encode("utf-8", "surrogatepass").split() for t in part.column("text").to_pylist()]
                found, collapsed = document_runs(texts), []
                for words, runs in zip(texts, found, strict=True):
                    if len(runs):
                        keep = kept_words(len(words), runs).tolist()
                        words = [w for w, k in zip(words, keep, strict=True) if k]
                    collapsed.append(b" ".join(words))
                flat = np.vstack(found)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), structs).cast(kind), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["doc_id", "runs", "collapsed"],
                )

    schema = "doc_id long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return id_and_text(docs).mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` where one document in ten repeats its end.

    Let h be the unsigned crc32 of the decimal doc_id and g = floor(h / 10). If h % 10 = 0 and there are n > 0 words, each word i >= a
    becomes word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null doc_id has no h.
    """
    rows = id_and_text(docs)
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    chosen = rows.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    placed = chosen.withColumn("g", g).withColumn("a", F.expr("IF(n > 0, g % n, 0)")).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)")
    )
    repeated = F.expr(
        "array_join(concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))), ' ')"
    )
    return placed.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def _top() -> Column:
    """The run with the greatest length / period; of equal ones the first in order of start and period."""
    better = "r.length * best.period > best.length * r.period"
    return F.expr(f"aggregate(runs, runs[0], (best, r) -> IF({better}, r, best))")


def runs_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent, and digests of all runs and of the collapsed text."""
    found = periodic_runs(planted(docs)).withColumn("top", F.when(F.size("runs") > 0, _top()))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"),
        F.col("top.period").alias("period"), F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
