"""Near-duplicate documents: MinHash bands, sequential Bayesian verification of candidates, exact check of survivors.

Two documents link when 100 * |A and B| >= 80 * |A or B| for their sets of two-word shingles (64-bit hashes of them).

1. *Signatures.* Equal sets are one class (by a 128-bit digest); one document stands for it. A set's signature holds, for
   each of ``BANDS * ROWS`` hash functions, the least hash of its shingles; of it 8 bits are kept. Sets that agree in all
   ``ROWS`` values of a band are candidates: a pair at similarity 0.8 misses all bands with probability 1.2e-7.
2. *Sequential verification.* A candidate pair's signatures are compared ``BATCH`` values at a time. With a uniform prior, m of
   n equal values leave the similarity s the posterior Beta(m + 1, n - m + 1); the pair is dropped as soon as
   P(s >= 0.8) < ``MISS``. Equal low bits of different values only raise m, so they drop nothing. Survivors are verified on full sets.
3. *Stars first.* In each bucket of a band every set meets the bucket's least id: one pair an entry. Verified links give
   components, and what is in one component needs no more pairs.
4. *Between components.* Buckets that still hold several components are cut into blocks of about ``BLOCK`` entries; every entry
   outside the bucket's largest component meets every entry of other components, block against block inside the tasks.
   Entries with a partner that passes the verification of 2 get their full sets, in the same blocks, and meet there again,
   exactly; of the links found, a block reports those that merge components. So no candidate is skipped, no pairs are
   made as rows, and no task holds more than two blocks.

Buckets of different bands that hold the same sets, and blocks with the same entries, are compared once.

Defined cases: a document without words (null text too) has an empty set, is linked with nothing and is its own component;
with one word, the word is the set. Rows that repeat a doc_id with different texts are different sets whose components may
have one name. A null doc_id names a component only if no other id does; ``kept`` is true where doc_id and component_id are
equal or both null, so of rows that repeat the least doc_id all are kept. An empty table gives no rows. Columns beside
``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binwright.llm.blocks import BLOCK, GROUP, full_sets, groups, in_blocks, merging_links, once, sides
from binwright.llm.common import doc_key, id_and_text, joined, ship, stored
from binwright.llm.jaccard import components, shingles

PERCENT = 80
SHINGLE = 2
BANDS = 40
ROWS = 5
BATCH = 40  # values of a signature that are compared before the next decision
MISS = 1e-6  # probability of a link below which a pair is dropped
SEED = 20_011


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed hash functions x -> (x ^ a) * b."""
    numbers = np.random.default_rng(SEED).integers(0, 2**63, (2, n), dtype=np.uint64)
    return numbers[0], numbers[1] * np.uint64(2) + np.uint64(1)


def least_hashes(elements: np.ndarray, a: np.ndarray, b: np.ndarray, portion: int = 1024) -> np.ndarray:
    """The least hash of the elements under each function."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), portion):
        np.minimum(out, ((elements[at : at + portion][None, :] ^ a[:, None]) * b[:, None]).min(1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One hash per band of its values."""
    rows = least.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in rows.T:
        out = (out * np.uint64(0x9E3779B97F4A7C15) + column) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def least_matches(n: int, percent: int, miss: float) -> int:
    """The fewest of ``n`` equal values with which P(similarity >= percent / 100) >= miss, a uniform prior given.

    That posterior probability is P(X <= m) for X binomial with n + 1 trials and that similarity.
    """
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def plausible(x: np.ndarray, y: np.ndarray, percent: int, miss: float = MISS) -> np.ndarray:
    """Which pairs of signatures (rows of ``x`` and ``y``) survive the sequential verification."""
    alive, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
    for at in range(0, x.shape[1], BATCH):
        equal[alive] += (x[alive, at : at + BATCH] == y[alive, at : at + BATCH]).sum(1)
        seen = min(at + BATCH, x.shape[1])
        alive = alive[equal[alive] >= least_matches(seen, percent, miss)]
    out = np.zeros(len(x), bool)
    out[alive] = True
    return out


def signed_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, n, digest of the set, signature (one byte a value) and band keys; the last two null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _functions(BANDS * ROWS)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, shingle) for t in part.column("text").to_pylist()]
                least = [least_hashes(s, a, b) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([None if m is None else (m >> np.uint64(56)).astype(np.uint8).tobytes() for m in least], pa.binary()),
                    pa.array([None if m is None else band_keys(m) for m in least], pa.list_(pa.int64())),
                ], ["doc_id", "text_key", "n", "digest", "signature", "keys"])

    return rows.mapInArrow(run, "doc_id long, text_key long, n long, digest binary, signature binary, keys array<long>")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _sizes_allow(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _plausible_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) that survive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = _sizes_allow(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
            batch = batch.filter(pa.array(ok))
            if batch.num_rows:
                ok = plausible(_signatures(batch.column("s_a")), _signatures(batch.column("s_b")), percent)
                yield batch.filter(pa.array(ok)).select(["a", "b"])

    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def star_links(stars: DataFrame, members: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link, of ``stars`` (a, b: the head), by full sets. A head's pairs are cut into blocks of about BLOCK, each
    of which gets the head's set once."""
    cuts = stars.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"))
    placed = stars.join(cuts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("cuts")).alias("part"), "a")
    placed = stored(placed, "placed_stars")
    heads = placed.select("b", "part").distinct().select("b", "part", F.lit(0).alias("kind"), F.col("b").alias("id"))
    both = stored(heads.unionByName(placed.select("b", "part", F.lit(1).alias("kind"), F.col("a").alias("id"))), "star_sets")
    columns = ["b", "part", "kind", "id", "elements"]
    ordered = both.join(full_sets(both, members, rows, partial(shingles, shingle=shingle)), "id").select(*columns).repartition("b", "part").sortWithinPartitions("b", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            a, b = [], []
            for at, kind, of, elements in zip(*(batch.column(c).to_pylist() for c in ("b", "kind", "id", "elements")), strict=True):
                x = np.frombuffer(elements, np.uint64)
                if kind == 0:
                    head = x
                    continue
                both = len(np.intersect1d(x, head, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(head) - both):
                    a.append(of)
                    b.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def _open_entries(copies: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The entries of ``copies`` that have a plausible partner of another component in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            i, j, same = sides(batch)
            comp, n = (batch.column(c).to_numpy() for c in ("comp", "n"))
            x, y = np.nonzero((comp[i][:, None] != comp[j][None, :]) & _sizes_allow(n[i][:, None], n[j][None, :], percent))
            x, y = i[x], j[y]
            if same:
                x, y = x[x < y], y[x < y]
            signature = _signatures(batch.column("signature"))
            ok = plausible(signature[x], signature[y], percent)
            some = np.unique(np.concatenate((x[ok], y[ok])))
            if len(some):
                yield batch.take(pa.array(some)).select([*GROUP, "block", "id", "comp"])

    columns = [*GROUP, "block", "id", "comp", "n", "signature"]
    ordered = copies.join(sets.select("id", "n", "signature"), "id").select(*columns).repartition(*GROUP).sortWithinPartitions(*GROUP)
    return ordered.mapInArrow(run, "key long, p long, q long, block long, id long, comp long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and kept, per row of ``docs``.

    ``BANDS`` and ``ROWS`` are chosen for a ``percent`` of 80 or more.
    """
    ship(docs.sparkSession)
    rows = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    signed = stored(signed_sets(rows, shingle), "signed_sets")
    sets = signed.where("n > 0").withColumn("doc_key", doc_key()).groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_key", "text_key")).alias("at"), F.first("n").alias("n"),
        F.first("signature").alias("signature"), F.first("keys").alias("keys"),
    ).select("digest", "doc_id", "at.*", "n", "signature", "keys", F.coalesce("doc_id", F.xxhash64("digest")).alias("id"))
    sets = stored(sets, "sets")
    # Ids that several sets have (repeated or null doc_ids) are replaced by a hash of the set.
    shared = sets.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("several"))
    if not shared.isEmpty():
        new = F.when(F.col("several"), F.xxhash64("digest", "id")).otherwise(F.col("id"))
        sets = stored(sets.join(stored(shared, "shared_ids"), "id", "left").withColumn("id", new).drop("several"), "sets")
    members = sets.select("id", "doc_key", "text_key")  # where the text of a set is

    entries = sets.select(F.explode("keys").alias("key"), "id")
    held = stored(entries.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("key", "head"), "heads")
    buckets = stored(once(joined(entries, held, ["key"], "inner"), ["key"], []), "buckets")
    stars = buckets.where("id != head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    stars = stored(_plausible_pairs(stars, sets, percent), "star_pairs")
    first = stored(star_links(stars, members, rows, shingle, percent), "star_links")
    comps = stored(components(first), "components")

    copies = in_blocks(buckets.select("key", "id"), comps, block=BLOCK)
    rest = stored(once(stored(_open_entries(copies, sets, percent), "open_entries"), GROUP, ["block"]), "open_entries")
    if not rest.isEmpty():
        more = stored(merging_links(rest, full_sets(rest, members, rows, partial(shingles, shingle=shingle)), percent), "merging_links")
        comps = stored(components(first.unionByName(more)), "components")

    named = sets.select("digest", "id", F.col("doc_id").alias("least")).join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = named.join(names, "comp").select("digest", "component_id")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(classes, "digest", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
