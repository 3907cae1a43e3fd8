"""Comparing large buckets of sets block against block inside tasks, for the joins on sets of shingles.

Buckets that hold several components are cut into blocks of about ``BLOCK`` entries. Every entry outside the bucket's largest
component meets every entry of other components, in a task that holds two blocks; pairs are never rows. An operator first
keeps the entries that have a possible partner, then these get their full sets and meet again, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binwright.llm.common import doc_key, joined, stored

BLOCK = 256  # entries of a bucket's block


def full_sets(wanted: DataFrame, members: DataFrame, rows: DataFrame, elements_of) -> DataFrame:
    """(id, elements) of the ids in ``wanted``, made from their texts by ``elements_of`` (text -> ascending unsigned numbers)."""
    at = stored(wanted.select("id").distinct().join(members, "id"), "wanted_sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                elements = [elements_of(t).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(elements, pa.binary())], ["id", "elements"])

    texts = joined(rows.withColumn("doc_key", doc_key()), at, ["doc_key", "text_key"], "inner").select("id", "text")
    return texts.mapInArrow(run, "id long, elements binary").dropDuplicates(["id"])


GROUP = ["key", "p", "q"]  # a bucket and two of its blocks


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch per group of rows that come sorted by GROUP."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if waiting is None else [waiting, batch]).combine_chunks().to_batches()[0]
        keys = np.column_stack([rows.column(c).to_numpy() for c in GROUP])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()]
        for at, end in zip(cuts, cuts[1:]):
            yield rows.slice(at, end - at)
        waiting = rows.slice(cuts[-1])
    if waiting is not None:
        yield waiting


def sides(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, bool]:
    """Which rows are in the group's first and in its second block; whether these are one block."""
    first = batch.column("block").to_numpy() == batch.column("p").to_numpy()
    same = batch.column("p")[0] == batch.column("q")[0]
    return np.flatnonzero(first), np.flatnonzero(first if same else ~first), same


def in_blocks(buckets: DataFrame, comps: DataFrame, carried: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Entries (GROUP, block, id, comp, carried) of buckets (key, id) with several components, once per group of two blocks that they meet in."""
    entries = joined(buckets, comps, ["id"], "left").withColumn("comp", F.coalesce("comp", "id"))
    held = entries.groupBy("key", "comp").count().groupBy("key").agg(
        F.max_by("comp", F.struct("count", "comp")).alias("_largest"), F.max("count").alias("most"), F.sum("count").alias("total")
    ).where("total > most")
    # Blocks 0 to others - 1 hold what is outside the largest component, the blocks after them the largest component.
    held = held.select(
        "key", "_largest", F.ceil((F.col("total") - F.col("most")) / block).alias("_others"), F.ceil(F.col("most") / block).alias("_own")
    )
    placed = joined(entries, stored(held, "mixed_buckets"), ["key"], "inner").withColumn("block", F.expr(
        "IF(comp = _largest, _others + pmod(xxhash64(id), _own), pmod(xxhash64(id), _others))"
    ))
    partner = F.explode(F.expr("sequence(0L, IF(comp = _largest, _others, _others + _own) - 1)")).alias("partner")
    return placed.select("key", "id", "comp", "block", *carried, partner).select(
        "key", F.least("block", "partner").alias("p"), F.greatest("block", "partner").alias("q"), "block", "id", "comp", *carried
    )


def overlaps(x: np.ndarray, elements: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """How many elements ``x`` shares with each of ``n`` sets, given all their elements in order with the set of each."""
    start, end = np.searchsorted(elements, x, "left"), np.searchsorted(elements, x, "right")
    counts = end - start
    at = np.repeat(start - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    return np.bincount(owners[at], minlength=n)


def merging_links(entries: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between entries of different components, by full sets; in each group only those that merge components.

    A set that differs little from the one before takes over its answers: the overlaps change only by the elements that
    one of both has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            i, j, _ = sides(batch)
            sets = [np.frombuffer(e, np.uint64) for e in batch.column("elements").to_pylist()]
            ids, comp = batch.column("id").to_pylist(), batch.column("comp").to_numpy().copy()
            i = i[np.argsort(comp[i], kind="stable")]  # similar sets after each other
            size = np.array([len(s) for s in sets])
            together = np.concatenate([sets[k] for k in j]) if len(j) else np.zeros(0, np.uint64)
            order = np.argsort(together, kind="stable")
            together, owners = together[order], np.repeat(np.arange(len(j)), size[j])[order]
            a, b, last, both = [], [], None, None
            for x in i.tolist():
                more = sets[x] if last is None else np.setdiff1d(sets[x], sets[last], assume_unique=True)
                if last is not None and 4 * len(more) < size[x] and 4 * (size[last] - size[x] + len(more)) < size[x]:
                    less = np.setdiff1d(sets[last], sets[x], assume_unique=True)
                    both = both + overlaps(more, together, owners, len(j)) - overlaps(less, together, owners, len(j))
                else:
                    both = overlaps(sets[x], together, owners, len(j))
                last = x
                for y in j[(100 * both >= percent * (size[x] + size[j] - both)) & (comp[j] != comp[x])].tolist():
                    if comp[x] != comp[y]:
                        a.append(ids[x])
                        b.append(ids[y])
                        comp[comp == comp[y]] = comp[x]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    columns = [*GROUP, "block", "id", "comp", "elements"]
    ordered = entries.join(elements, "id").select(*columns).repartition(*GROUP).sortWithinPartitions(*GROUP)
    return ordered.mapInArrow(run, "a long, b long")


def once(entries: DataFrame, key: list[str], also: list[str]) -> DataFrame:
    """``entries`` of one of all groups (``key``) that have the same ids (and ``also`` columns), told by count and two 64-bit hashes."""
    same = entries.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id", *also)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id", *also)).alias("y")
    ).groupBy("n", "x", "y").agg(F.min(F.struct(*key)).alias("one")).select("one.*")
    return joined(entries, stored(same, "distinct_groups"), key, "inner")
