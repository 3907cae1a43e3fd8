"""Exact Jaccard join of documents' sets of word shingles, by parts of sets that must be equal.

Two documents link when 100 * |A and B| >= percent * |A or B|: by default 90 over shingles of three words, the figures
of op7; the pipeline takes 80 over five. Sets are of 64-bit hashes of shingles.

1. Equal sets are one class (by a 128-bit digest of the set); one document stands for it from here on.
2. Linked sets differ in at most d elements, where d follows from the size of the smaller one. Sizes are cut into ranges; for a range
   the hashes are dealt into more than d parts, so linked sets agree in whole parts. A set has a key per part, for the ranges
   that the smaller of a pair may be in: its own and the one before. A key is of some ten elements at 90 percent, so sets that
   just share a common shingle do not meet. Empty parts have keys only where a set has so many that all it agrees in may be empty.
3. The index is a list per key in order of size. Lists of the same sets are one.
4. *Neighbours first*: each entry is paired with the nearest of the ``NEAR`` entries before it that it may link with,
   and with its list's first: two pairs an entry at most. Verified pairs give components.
5. *Between components*: what is in one component needs no more pairs. Lists that still hold several are cut into blocks
   (``blocks.py``), which meet inside the tasks. Entries of different components that may link are tied there: a row per
   entry at most, which names the first entry it is tied with. Tied sets are clusters; each is cut into blocks once, however many lists
   it was in, and its blocks meet with full sets. So no link between components is lost, components are exact, and pairs are no rows.

Entries may link if their sizes and parity bitmaps allow it (bits that differ are at most the elements that differ): a short one
is in the lists, a longer one, of as many bits as elements, is compared before full sets are made, for near pairs and for ties. A short one
says nothing of sets with more elements than bits; tied by it alone, such sets are one cluster that grows with the input, and each goes
with its elements into every pair of blocks.

Defined cases: a document without words (null text too) has an empty set, is linked with nothing and is its own
component. Rows that repeat a doc_id with different texts are different sets whose components may have one
name. A null doc_id stays null and stands for a class only if no other id does; classes that have only null ids are
told apart by their set and named null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binwright.llm.blocks import GROUP, full_sets, in_blocks, merging_links, once
from binwright.llm.common import doc_key, id_and_text, joined, ship, stored

PERCENT = 90  # defaults: the figures of op7
SHINGLE = 3
NEAR = 64
CACHED_WORDS = 400_000  # per Python worker; emptied when full
_WORDS: dict[bytes, int] = {}


def required(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of these sizes link."""
    return -(-percent * (n + m) // (100 + percent))


@lru_cache(maxsize=64)
def size_ranges(most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of the ranges of sizes up to ``most``, and the most elements in which linked sets differ if the smaller is in it."""
    ends, least = [], 1
    while not ends or ends[-1] < most:
        ends.append(100 * least // percent)
        least = ends[-1] + 1
    ends = np.array(ends, np.int64)
    return ends, (ends + 100 * ends // percent) * (100 - percent) // (100 + percent)


def part_keys(values: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the parts of a set (ascending hashes): two linked sets have one in common."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    ends, apart = size_ranges(1 << n.bit_length(), percent)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(values), dtype=np.uint64)))
    out = []
    for k in {int(np.searchsorted(ends, -(-percent * n // 100))), int(np.searchsorted(ends, n))}:
        d = int(apart[k])
        parts = d + 1 + d // 8
        part = (values >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        keys = _mixed(sums[bounds[1:]] - sums[bounds[:-1]] + _mixed(np.arange(parts, dtype=np.uint64) + np.uint64((k + 1) << 32)))
        filled = bounds[1:] > bounds[:-1]
        # linked sets agree in parts - d parts or more, so in a filled one unless both have as many empty ones
        out.append(keys[filled] if parts - filled.sum() < parts - d else keys)
    return np.concatenate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, shingle: int) -> np.ndarray:
    """The set of hashed shingles of a text, ascending. Fewer words than a shingle are one shingle."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > CACHED_WORDS:
        _WORDS.clear()
    hashes = np.empty(len(words), np.uint64)
    try:
        hashes[:] = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words):
            if w not in _WORDS:
                _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        hashes[:] = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(words) - width + 1 + i])
    return np.unique(out)


def bitmap(values: np.ndarray) -> bytes:
    """Parity of the elements per bit; about as many bits as elements, a power of two."""
    bits = 64
    while bits < len(values):
        bits *= 2
    odd = np.bincount((values % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def short_bitmap(values: np.ndarray) -> list[int]:
    """Parity of the elements in each of 256 bits, as four numbers."""
    odd = np.bincount((values % np.uint64(256)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the elements that differ, from two bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.unpackbits(x ^ y).sum())


def _map(df: DataFrame, schema: str, make) -> DataFrame:
    """mapInArrow where ``make`` turns a batch of at most 512 rows into columns."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                columns = make(batch.slice(at, 512))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return df.mapInArrow(run, schema)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def keyed_sets(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, digest of the set, bitmaps and the keys of its parts."""

    def make(batch):
        sets = [shingles(t, shingle) for t in batch.column("text").to_pylist()]
        return [
            batch.column("doc_id"), batch.column("text_key"), [len(s) for s in sets],
            [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [bitmap(s) for s in sets],
            [short_bitmap(s) for s in sets], [_signed(part_keys(s, percent)) for s in sets],
        ]

    return _map(rows, "doc_id long, text_key long, n long, digest binary, bits binary, short array<long>, keys array<long>", make)


LIST = ["key", "n", "id"]
BITS = ["bits_0", "bits_1", "bits_2", "bits_3"]


def index_lists(entries: DataFrame) -> DataFrame:
    """The entries (key, n, id) of lists with at least two sets."""
    ordered = entries.select(*LIST).repartition("key").sortWithinPartitions(*LIST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, again = np.zeros((0, 3), np.int64), False  # the last row, and whether its list has others before it
        for batch in batches:
            rows = np.vstack((held, np.column_stack([batch.column(c).to_numpy() for c in LIST])))
            same = rows[1:, 0] == rows[:-1, 0]
            keep = np.append(again, same) | np.append(same, False)
            again, held = bool(same[-1]) if len(same) else again, rows[-1:]
            done = rows[:-1][keep[:-1]]
            if len(done):
                yield pa.RecordBatch.from_arrays([pa.array(done[:, c]) for c in range(3)], LIST)
        if again:
            yield pa.RecordBatch.from_arrays([pa.array(held[:, c]) for c in range(3)], LIST)

    return ordered.mapInArrow(run, "key long, n long, id long")


def near_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each entry with the nearest of the ``NEAR`` before it that it may link with, and with the first."""
    ordered = lists.repartition("key").sortWithinPartitions(*LIST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 7), np.int64)
        for batch in batches:
            rows = np.vstack((held, np.column_stack([batch.column(c).to_numpy() for c in LIST + BITS])))
            start, found = len(held), []
            waiting = np.arange(start, len(rows))
            for back in range(1, NEAR + 1):
                waiting = waiting[waiting >= back]
                waiting = waiting[rows[waiting, 0] == rows[waiting - back, 0]]
                if not len(waiting):
                    break
                x, y = rows[waiting], rows[waiting - back]
                ok = _allowed(x, y, percent)
                found.append((x[ok, 2], y[ok, 2]))
                waiting = waiting[~ok & (100 * y[:, 1] >= percent * x[:, 1])]  # sizes ascend: before a small one, all are small
            index = np.arange(len(rows))
            first = np.maximum.accumulate(np.where(np.append(True, rows[1:, 0] != rows[:-1, 0]), index, 0))
            x, y = rows[start:], rows[first[start:]]
            ok = (first[start:] < index[start:]) & _allowed(x, y, percent)
            found.append((x[ok, 2], y[ok, 2]))
            held = rows[-NEAR:]
            a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            low, high = np.unique(np.column_stack((np.minimum(a, b), np.maximum(a, b))), axis=0).T if len(a) else (a, b)
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _allowed(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether entries (key, n, id, bitmap) of the same lists may link, by sizes and short bitmaps."""
    return may_link(x[:, 1], x[:, 3:], y[:, 1], y[:, 3:], percent)


def may_link(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m with the short bitmaps x and y (rows of signed numbers) may link."""
    differ = np.bitwise_count((x ^ y).view(np.uint64)).sum(1, dtype=np.int64)  # of signed numbers numpy counts the absolute value's bits
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (differ <= n + m - 2 * required(n, m, percent))


PORTION = 1 << 20  # words of bitmaps that are compared at once


class Bitmaps:
    """Bitmaps of several sets, each a power of two in bits."""

    def __init__(self, maps: list[bytes]):
        self.words = np.frombuffer(b"".join(maps), np.uint64)
        self.size = np.array([len(m) // 8 for m in maps], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def folded(self, rows: np.ndarray, size: int) -> np.ndarray:
        """The bitmaps of rows, all at least that long, as rows of ``size`` words."""
        out = np.empty((len(rows), size), np.uint64)
        for long in np.unique(self.size[rows]).tolist():
            at = np.flatnonzero(self.size[rows] == long)
            whole = self.words[self.start[rows[at], None] + np.arange(long)]
            out[at] = np.bitwise_xor.reduce(whole.reshape(len(at), -1, size), axis=1)
        return out

    def may_link(self, n: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether the sets in rows x and y (of sizes n) may link, by bitmaps folded to the length of the shorter one."""
        most, short = n[x] + n[y] - 2 * required(n[x], n[y], percent), np.minimum(self.size[x], self.size[y])
        out = np.empty(len(x), bool)
        for size in np.unique(short).tolist():
            same, step = np.flatnonzero(short == size), max(1, PORTION // int(self.size[x].max(initial=1)))
            for at in (same[k : k + step] for k in range(0, len(same), step)):
                differ = np.bitwise_count(self.folded(x[at], size) ^ self.folded(y[at], size)).sum(1, dtype=np.int64)
                out[at] = differ <= most[at]
        return out


def ties(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that connect, in each group of two blocks (GROUP), the entries of different components that may link:
    at most one pair for an entry. ``entries``: GROUP, block, id, comp, n, short bitmap and, if there, ``bits`` (the longer one).
    """
    columns = [*GROUP, "block", "id", "comp", "n", *BITS]
    more = [c for c in ("bits",) if c in entries.columns]
    ordered = entries.select(*columns, *more).repartition(*GROUP).sortWithinPartitions(*GROUP, "n", "id")

    def tied(rows: np.ndarray, maps: list[bytes]) -> pa.RecordBatch:
        longer = Bitmaps(maps) if maps else None
        block, ids, comp, n = rows[:, 3:7].T
        bits, index, label = np.ascontiguousarray(rows[:, 7:]), np.arange(len(rows)), np.arange(len(rows))
        start = np.maximum.accumulate(np.where(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1)), index, 0))
        within = rows[:, 1] == rows[:, 2]  # the group is one block
        waiting, back = index, 0
        while len(waiting):
            back += 1
            waiting = waiting[waiting - back >= start[waiting]]
            waiting = waiting[100 * n[waiting - back] >= percent * n[waiting]]  # sizes ascend: before a small one, all are small
            x = waiting[(comp[waiting] != comp[waiting - back]) & (within[waiting] | (block[waiting] != block[waiting - back]))]
            x = x[label[x] != label[x - back]]
            x = x[may_link(n[x], bits[x], n[x - back], bits[x - back], percent)]
            x = x[longer.may_link(n, x, x - back, percent)] if longer else x
            y = x - back
            while len(x):
                np.minimum.at(label, np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))
                while (label != label[label]).any():
                    label = label[label]
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
        some = np.flatnonzero(label != index)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label[some]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_maps = np.zeros((0, len(columns)), np.int64), []
        for batch in batches:
            rows = np.vstack((held, np.column_stack([batch.column(c).to_numpy() for c in columns])))
            maps = held_maps + [m for c in more for m in batch.column(c).to_pylist()]
            cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1))
            whole = cut[-1] + 1 if len(cut) else 0  # the last group may go on
            held, held_maps = rows[whole:], maps[whole:]
            if whole:
                yield tied(rows[:whole], maps[:whole])
        if len(held):
            yield tied(held, held_maps)

    return ordered.mapInArrow(run, "a long, b long").where("a != b").distinct()


def _passing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) whose bitmaps allow a link."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    def make(batch):
        a, b, n, m = (batch.column(c).to_numpy() for c in ("a", "b", "n_a", "n_b"))
        most = n + m - 2 * required(n, m, percent)
        ok = np.array([least_difference(x, y) <= d for x, y, d in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), most, strict=True)], bool)
        return [a[ok], b[ok], n[ok], m[ok]]

    return _map(pairs.join(side("a"), "a").join(side("b"), "b"), "a long, b long, n_a long, n_b long", make)


def _overlaps(pairs: DataFrame, members: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Exact overlap of each pair: a, b, n_a, n_b, overlap. Full sets are made for the documents in pairs alone."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(members, "id"), "wanted_sets")
    text = rows.withColumn("doc_key", doc_key())
    full = _map(
        joined(text, wanted, ["doc_key", "text_key"], "inner").select("id", "text"), "id long, elements binary",
        lambda batch: [batch.column("id"), [shingles(t, shingle).tobytes() for t in batch.column("text").to_pylist()]],
    ).dropDuplicates(["id"])
    full = stored(full, "full_sets")

    def make(batch):
        both = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
        common = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in both]
        return [*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), common]

    filled = pairs.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b")
    return _map(filled, "a long, b long, n_a long, n_b long, overlap long", make)


def links(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.where(f"100 * overlap >= {percent} * (n_a + n_b - overlap)").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """id and comp (the least id it is connected with) for every id in ``edges`` (a, b).

    Each round ties every node's neighbours to the least of them, first for larger neighbours and then for
    smaller ones, until nothing changes; rounds grow with the logarithm of the longest chain.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "u", "least")
        small = small.select(F.explode(F.array(F.struct("u", "least"), F.struct(F.col("x").alias("u"), "least"))).alias("e")).select("e.*")
        edges = stored(small.select("u", F.col("least").alias("v")).where("u != v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    )


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), per row of ``docs``.

    ``shingle`` is the number of words of a shingle, ``percent`` the similarity from which documents link.
    """
    ship(docs.sparkSession)
    rows = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    sized = stored(keyed_sets(rows, shingle, percent), "keyed_sets")
    sets = stored(
        sized.where("n > 0").withColumn("doc_key", doc_key()).groupBy("digest").agg(
            F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_key", "text_key")).alias("at"), F.first("n").alias("n"),
            F.first("bits").alias("bits"), F.first("short").alias("short"), F.first("keys").alias("keys"),
        ).select("digest", "doc_id", "at.*", "n", "bits", "short", "keys", F.coalesce("doc_id", F.xxhash64("digest")).alias("id")),
        "sets",
    )
    # Ids that several sets have (repeated or null doc_ids) are replaced by a hash of the set.
    shared = sets.groupBy("id").count().where("count > 1").select("id")
    if not shared.isEmpty():
        sets = stored(
            sets.join(stored(shared.withColumn("several", F.lit(True)), "shared_ids"), "id", "left")
            .withColumn("id", F.when(F.col("several"), F.xxhash64("digest", "id")).otherwise(F.col("id"))).drop("several"),
            "sets",
        )
    entries = sets.select(F.explode("keys").alias("key"), "n", "id")
    short = sets.select("id", *[F.col("short")[i].alias(c) for i, c in enumerate(BITS)])
    lists = stored(index_lists(entries), "index_lists")
    lists = stored(once(lists, ["key"], []).join(short, "id").select(*LIST, *BITS), "index_lists")
    members = sets.select("id", "doc_key", "text_key")  # where the text of a set is

    led = stored(_passing(stored(near_pairs(lists, percent), "near_pairs"), sets, percent), "near_pairs")
    known = stored(links(_overlaps(led, members, rows, shingle), percent), "links")
    final = stored(components(known), "components")

    met = in_blocks(lists, final, ("n", *BITS)).join(sets.select("id", "bits"), "id")
    tied = stored(ties(met, percent), "ties")
    if not tied.isEmpty():
        clusters = stored(components(tied).select(F.col("comp").alias("key"), "id"), "clusters")
        rest = stored(in_blocks(clusters, final), "open_entries")
        more = stored(merging_links(rest, full_sets(rest, members, rows, partial(shingles, shingle=shingle)), percent), "merging_links")
        final = stored(components(known.unionByName(more)), "components")

    named = sets.select("digest", "id", F.col("doc_id").alias("least")).join(final, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = named.join(names, "comp").select("digest", "component_id")
    return sized.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(classes, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
