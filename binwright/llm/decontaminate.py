"""Benchmark decontamination by latent semantic retrieval, then longest-common-subsequence and answer checks.

1. One scan turns every text into the places and numbers of the words that the benchmark has; these are kept.
   Passages are windows of words over every text. Features are the words of the benchmark, weighed by TF-IDF;
   document frequencies count the passages of all documents. Used are the ``FEATURES`` rarest words
   of each item's passage, without words in more than ``COMMON`` of the passages but for its ``LEAST_FEATURES`` rarest.
2. A randomised SVD finds a basis of the features in one more pass: each task sums its part of A'A times a random matrix
   of ``RANK`` columns (features times RANK, never passages times anything), the benchmark's own passages among the
   rows of A; of the sum, the Nystrom form gives the singular vectors.
3. Every overlapping window is projected and compared with all items; pairs with a cosine of at least ``COSINE`` go on.
   The items are the stated query set: they are small and go to every task.
4. A candidate counts if the longest common subsequence of words covers ``COVER`` of the item's passage (all of it for
   fewer than ``SHORT`` words) and half of the words of its answer, the passage's last ``ANSWER`` words, are in order in the window.

Documents that hold too few words of every item for the subsequence of step 4 are left out before step 3, as are windows
without features; so are, before step 4, candidates whose window holds too few words of the item. This loses nothing that the
steps find, whatever the cosine of the projections.
Words are compared in lower case without punctuation at their ends.

Defined cases: null text is empty and has no passages; so do empty and null benchmark items, which are never found.
An empty benchmark finds nothing. A null or repeated doc_id is reported as it is, once per item. Texts of any
length are cut into windows whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binwright.llm.common import id_and_text, ship, stored

ITEM_WORDS = 64  # longer items are cut into passages of this length
STRIDE = 16
RANK = 256
COSINE = 0.5
FEATURES = 16  # per passage of the benchmark: its rarest words
COMMON = 0.001  # of the passages; more frequent words are no features,
LEAST_FEATURES = 6  # but for so many of each item
COVER = 0.6
SHORT = 8
ANSWER = 8
EDGES = ".,;:!?\"'()[]{}#$%&*|+-_"  # cut from the ends of words
BLOCKS = 64
CACHED_WORDS = 400_000  # per Python worker; emptied when full


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]


@dataclass
class Items:
    """The benchmark as passages of words, and the numbers of its words."""

    ids: list
    passages: list[list[str]]
    vocabulary: dict[str, int]

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        ids, passages = [], []
        for item, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
            words = words_of(text or "")
            for at in range(0, len(words), ITEM_WORDS):
                # a short rest is taken together with what stands before it
                part = words[at : at + ITEM_WORDS] if len(words) - at >= ITEM_WORDS // 2 else words[max(0, len(words) - ITEM_WORDS) :]
                ids.append(item)
                passages.append(part)
        return Items(ids, passages, {w: i for i, w in enumerate(sorted({w for p in passages for w in p}))})

    @property
    def width(self) -> int:
        """Words of a window: wherever a passage stands, some window holds it whole."""
        return max(map(len, self.passages)) + STRIDE


@dataclass
class Coded:
    """A batch of documents as numbers of benchmark words: document, place in its words, number, per word found."""

    doc: np.ndarray
    place: np.ndarray
    code: np.ndarray
    lengths: np.ndarray  # words of each document

    @staticmethod
    def of(batch: pa.RecordBatch) -> Coded:
        places, codes = batch.column("places"), batch.column("codes")
        counts = np.diff(places.offsets.to_numpy())
        return Coded(
            np.repeat(np.arange(batch.num_rows), counts), places.flatten().to_numpy().astype(np.int64), codes.flatten().to_numpy().astype(np.int64),
            batch.column("n_words").to_numpy(),
        )

    def windows(self, width: int, stride: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window and number of each entry (only of ``chosen`` numbers), repeats included, and each document's first window."""
        n = np.maximum(1, -(-np.maximum(0, self.lengths - width) // stride) + 1)
        base = np.cumsum(n) - n
        keep = slice(None) if chosen is None else chosen[self.code]
        doc, place, code = self.doc[keep], self.place[keep], self.code[keep]
        last = np.minimum(place // stride, n[doc] - 1)
        first = np.minimum(np.maximum(0, -(-(place - width + 1) // stride)), last)
        reps = last - first + 1
        window = np.repeat(base[doc] + first, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        return window, np.repeat(code, reps), np.append(base, n.sum())

    def between(self, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of the entries of a document from place ``begin``, and from ``end``, per document asked for."""
        far = int(self.lengths.max(initial=0)) + int(end.max(initial=0)) + 1
        at = self.doc * far + self.place
        return np.searchsorted(at, doc * far + begin), np.searchsorted(at, doc * far + end)


class WordNumbers(dict):
    """A word as it stands in a text: its number, -1 for others, -2 if nothing is left of it. Filled as words are met."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        bare = word.strip(EDGES)
        number = self[word] = self.vocabulary.get(bare, -1) if bare else -2
        return number


CODED = "doc_id long, n_words long, places array<int>, codes array<int>"


def coded(rows: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """Per document its number of words, and the places and numbers of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordNumbers(vocabulary)
        for batch in batches:
            counts, places, codes = [], [], []
            for text in batch.column("text").to_pylist():
                words = text.lower().split()
                if len(known) > CACHED_WORDS:
                    known.clear()
                found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                found = found[found != -2]
                at = np.flatnonzero(found >= 0)
                counts.append(len(found))
                places.append(at.astype(np.int32))
                codes.append(found[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(codes, pa.list_(pa.int32()))],
                ["doc_id", "n_words", "places", "codes"],
            )

    return rows.mapInArrow(run, CODED)


def _counted(window: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (window, word) with their counts, by window."""
    keys, counts = np.unique(window.astype(np.int64) * n_words + word, return_counts=True)
    return keys // n_words, keys % n_words, counts


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(at, rows).columns], batch.schema.names)


def _frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Passages that hold each benchmark word, and the number of passages, over all documents."""
    size, width = len(items.vocabulary), items.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(size, np.int64), 0
        for batch in _batches(batches):
            rows = Coded.of(batch)
            window, word, bases = rows.windows(width, width)
            found += np.bincount(np.unique(window * size + word) % size, minlength=size)
            total += int(bases[-1])
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.append(some, -1), pa.int64()), "n": pa.array(np.append(found[some], total), pa.int64())})

    rows = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per benchmark word
    out, total = np.zeros(size, np.int64), 0
    for r in rows:
        if r["word"] < 0:
            total = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, total


def _features(items: Items, found: np.ndarray, total: int) -> np.ndarray:
    """The weight of each benchmark word: its IDF, or 0 if it is no feature."""
    weight, chosen = np.log((1 + total) / (1 + found)) + 1, np.zeros(len(found), bool)
    for p in items.passages:
        rare = sorted({items.vocabulary[w] for w in p}, key=lambda c: (found[c], c))
        chosen[rare[:LEAST_FEATURES]] = True
        chosen[[c for c in rare[:FEATURES] if found[c] <= COMMON * total]] = True
    return np.where(chosen, weight, 0.0)


def _tfidf(window, word, count, weight):
    """Entries with a weight, as unit rows: window number (dense), word, value, number of rows."""
    keep = weight[word] > 0
    window, word, value = window[keep], word[keep], (1 + np.log(count[keep])) * weight[word[keep]]
    if not len(window):
        return window, word, value, 0
    starts = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(window))))
    return row, word, value / np.sqrt(np.add.reduceat(value * value, starts))[row], len(starts)


def _sum_rows(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``values`` per group."""
    order = np.argsort(groups, kind="stable")
    groups = groups[order]
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    out = np.zeros((n, values.shape[1]))
    out[groups[starts]] = np.add.reduceat(values[order], starts)
    return out


def _gram_times(row, word, value, n_rows: int, basis: np.ndarray) -> np.ndarray:
    """A' A basis for the rows of A given by entries."""
    out = np.zeros(basis.shape)
    if not n_rows:
        return out
    for at in range(0, n_rows, 2000):
        a, b = np.searchsorted(row, [at, at + 2000])
        if a == b:
            continue
        y = _sum_rows(value[a:b, None] * basis[word[a:b]], row[a:b] - at, min(2000, n_rows - at))
        out += _sum_rows(value[a:b, None] * y[row[a:b] - at], word[a:b], len(out))
    return out


def _corpus_gram(docs: DataFrame, items: Items, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A' A basis over the passages of all documents: summed per task, then by Spark per block of features."""
    size, width = len(items.vocabulary), items.width
    blocks = np.array_split(np.arange(size), min(BLOCKS, size))
    cols = basis.shape[1]
    slim = basis.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slim.shape)
        for batch in _batches(batches):
            window, word, _ = Coded.of(batch).windows(width, width, weight > 0)
            if len(window):
                total += _gram_times(*_tfidf(*_counted(window, word, size), weight), slim)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(range(len(blocks)), pa.int64()), "sums": pa.array([total[b].astype(np.float32).tobytes() for b in blocks], pa.binary()),
        })

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                held[block] = held.get(block, 0) + np.frombuffer(sums, np.float32).astype(float)
        yield pa.RecordBatch.from_pydict({"block": pa.array(held, pa.int64()), "sums": pa.array([v.tobytes() for v in held.values()], pa.binary())})

    schema = "block long, sums binary"
    rows = docs.mapInArrow(run, schema).repartition(len(blocks), "block").mapInArrow(add, schema).collect()  # features times RANK numbers
    out = np.zeros((size, cols))
    for r in rows:
        out[blocks[r["block"]]] += np.frombuffer(r["sums"], float).reshape(-1, cols)
    return out


def latent_basis(docs: DataFrame, items: Items, weight: np.ndarray, total: int, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Features times at most ``rank``: right singular vectors of the TF-IDF passages, the benchmark's among them."""
    rank = min(rank, int((weight > 0).sum()))
    row = np.repeat(np.arange(len(items.passages)), [len(p) for p in items.passages])
    word = np.array([items.vocabulary[w] for p in items.passages for w in p])
    own = _tfidf(*_counted(row, word, len(items.vocabulary)), weight)
    share = max(1.0, total / len(items.passages))  # the benchmark weighs as much as the corpus
    gram = lambda q: _corpus_gram(docs, items, weight, q) + share * _gram_times(*own, q)
    start = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(weight), rank)) * (weight > 0)[:, None])[0]
    sketch = gram(start)
    small, turn = np.linalg.eigh((start.T @ sketch + sketch.T @ start) / 2)
    keep = small > 1e-9 * max(small.max(), 1e-30)
    vectors, _, _ = np.linalg.svd(sketch @ (turn[:, keep] / np.sqrt(small[keep])), full_matrices=False)
    return vectors


def _project(row, word, value, n_rows: int, basis: np.ndarray) -> np.ndarray:
    """Unit rows in the latent space (zero where nothing is left)."""
    if not n_rows:
        return np.zeros((0, basis.shape[1]))
    y = _sum_rows(value[:, None] * basis[word], row, n_rows)
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)


def common_subsequence(masks: dict, words: list, size: int) -> int:
    """Length of the longest common subsequence; ``masks`` has the places of each word of the other text as bits."""
    state, full = (1 << size) - 1, (1 << size) - 1
    for w in words:
        hit = state & masks.get(w, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def place_bits(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def least_words(sizes: np.ndarray) -> np.ndarray:
    """Per item of so many words: the fewest of its places that the longest common subsequence must cover."""
    return np.where(sizes >= SHORT, np.ceil(COVER * sizes - 1e-9).astype(np.int64), sizes)


class Places:
    """How many places of each item can be covered by the words of a document, and how many must be."""

    def __init__(self, item: np.ndarray, word: np.ndarray, count: np.ndarray, size: int, need: np.ndarray):
        order = np.argsort(word, kind="stable")
        self.item, self.count, self.need = item[order], count[order].astype(float), need
        self.first = np.searchsorted(word[order], np.arange(size + 1))

    def possible(self, doc: np.ndarray, word: np.ndarray, n_docs: int) -> np.ndarray:
        """Per document, given its different words (by document), whether they can cover enough places of some item."""
        n_items, out = len(self.need), np.zeros(n_docs, bool)
        step = max(1, 4_000_000 // n_items)
        for at in range(0, n_docs, step):
            a, b = np.searchsorted(doc, [at, at + step])
            n = self.first[word[a:b] + 1] - self.first[word[a:b]]
            post = np.repeat(self.first[word[a:b]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows = min(step, n_docs - at)
            met = np.bincount(np.repeat(doc[a:b] - at, n) * n_items + self.item[post], self.count[post], rows * n_items)
            out[at : at + rows] = (met.reshape(rows, n_items) >= self.need).any(1)
        return out


PAIRS = 1 << 16  # windows and items that are compared at once


def words_in_items(code: np.ndarray, first: np.ndarray, end: np.ndarray, item: np.ndarray, member: np.ndarray, size: int) -> np.ndarray:
    """Per pair of a stretch of numbers (``first`` to ``end``) and an item, how many of them the item has: no common subsequence is longer.

    ``member``: item * size + number, ascending, of all numbers of the items.
    """
    out = np.zeros(len(item), np.int64)
    for at in range(0, len(item), PAIRS):
        n = end[at : at + PAIRS] - first[at : at + PAIRS]
        until = np.cumsum(n)
        entry = np.repeat(first[at : at + PAIRS] - (until - n), n) + np.arange(n.sum())
        wanted = np.repeat(item[at : at + PAIRS] * size, n) + code[entry]
        inside = np.append(0, np.cumsum(member[np.minimum(np.searchsorted(member, wanted), len(member) - 1)] == wanted))
        out[at : at + PAIRS] = inside[until] - inside[until - n]
    return out


HITS = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the best passage's figures, for every document and item that match."""
    ship(docs.sparkSession)
    rows = id_and_text(docs)
    items = Items.of([tuple(r) for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).collect()])  # the query set
    if not items.passages:
        return rows.where("false").mapInArrow(lambda b: iter(()), HITS)
    size, width = len(items.vocabulary), items.width
    rows = stored(coded(rows, items.vocabulary), "coded_documents")
    found, total = _frequencies(rows, items)
    weight = _features(items, found, total)
    basis = latent_basis(rows, items, weight, total).astype(np.float32)
    passages, ids = [[items.vocabulary[w] for w in p] for p in items.passages], items.ids
    row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    item, word, count = _counted(row, np.array([c for p in passages for c in p]), size)
    entries = _tfidf(item, word, count, weight)
    queries = _project(*entries, basis).astype(np.float32)
    sizes, feature = np.array([len(p) for p in passages]), weight[word] > 0
    need = least_words(sizes)
    # Of the places with features, those that the others cannot make up for; a window without any has no direction.
    fewest = np.maximum(1, np.bincount(item[feature], count[feature], len(passages)).astype(np.int64) - (sizes - need))
    by_feature = Places(item[feature], word[feature], count[feature], size, fewest)
    by_word = Places(item, word, count, size, need)
    member = item * size + word  # ascending
    weight = weight.astype(np.float32)

    def possible(docs: Coded) -> np.ndarray:
        """Per document whether it holds enough words of some item."""
        pair = np.unique(docs.doc * size + docs.code)
        doc, code = pair // size, pair % size
        keep = weight[code] > 0
        some = by_feature.possible(doc[keep], code[keep], len(docs.lengths))
        keep = some[doc]
        return some & by_word.possible(doc[keep], code[keep], len(docs.lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, tails = [place_bits(p) for p in passages], [place_bits(p[-ANSWER:]) for p in passages]
        for batch in _batches(batches):
            batch = batch.filter(pa.array(possible(Coded.of(batch))))
            docs = Coded.of(batch)
            window, code, bases = docs.windows(width, STRIDE, weight > 0)
            if not len(window):
                continue
            enough = np.bincount(window)[window] >= fewest.min()
            window, code, count = _counted(window[enough], code[enough], size)
            names = np.unique(window)
            entries = _tfidf(window, code, count, weight)
            out: dict[tuple, tuple] = {}
            for block in range(0, len(names), 4096):
                a, b = np.searchsorted(entries[0], [block, block + 4096])
                near = _project(entries[0][a:b] - block, entries[1][a:b], entries[2][a:b], min(4096, len(names) - block), basis) @ queries.T
                w, q = np.nonzero(near >= COSINE)
                at = np.searchsorted(bases, names[block + w], "right") - 1
                begin = (names[block + w] - bases[at]) * STRIDE
                first, end = docs.between(at, begin, begin + width)
                fine = words_in_items(docs.code, first, end, q, member, size) >= need[q]
                for w, q, at, a, b in zip(*(x[fine].tolist() for x in (w, q, at, first, end)), strict=True):
                    part, item = docs.code[a:b].tolist(), passages[q]
                    cover = common_subsequence(bits[q], part, len(item)) / len(item)
                    if cover < (COVER if len(item) >= SHORT else 1.0):
                        continue
                    tail = min(ANSWER, len(item))
                    answer = common_subsequence(tails[q], part, tail) / tail
                    if answer >= 0.5:
                        key, value = (at, ids[q]), (cover, answer, float(near[w, q]))
                        out[key] = max(out.get(key, value), value)
            if out:
                names_ = batch.column("doc_id").to_pylist()
                columns = zip(*((names_[at], item, v[2], v[0], v[1]) for (at, item), v in out.items()), strict=True)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in HITS.split(", ")])

    hits = rows.mapInArrow(run, HITS)
    best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("best")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.lcs_share", "best.answer_share")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of documents that match no item. A null doc_id is matched by null."""
    hits = stored(contaminated(docs, benchmark).select(F.col("doc_id").alias("_hit")).distinct(), "contaminated")
    return docs.join(hits, F.col("doc_id").cast("long").eqNullSafe(F.col("_hit")), "left_anti")
