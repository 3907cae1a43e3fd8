"""From the count table to packed rows of selected cells: a pruned scan, then one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binwright.operators.dims import fits_broadcast, join_dimension
from binwright.session import written

ID_BLOCK = 100_000  # cell ids per block when ranges of ids are looked for
MOST_BLOCKS = 100_000
ID_RANGES = 32  # ranges of cell ids that a scan is limited to, at most
CELLS_PER_BLOCK = 10_000  # cells whose counts share one copy of their ingest's feature positions
SPARSE = 8  # an ingest's feature ids may span this many times their number; beyond, positions are not used

_ENTRIES = "array<struct<feature_id:bigint,raw_counts:bigint>>"


def id_ranges(cells: DataFrame, most: int = ID_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges of ids that hold all cells, parted at the widest gaps between blocks of ids.

    Blocks that hold cells come to the driver, one row per ID_BLOCK ids; beyond MOST_BLOCKS of them there is one range.
    """
    block = F.call_function("div", F.col("id"), F.lit(ID_BLOCK)).alias("block")
    bounds = [F.min("id").alias("low"), F.max("id").alias("high")]
    held = sorted((r["low"], r["high"]) for r in cells.groupBy(block).agg(*bounds).limit(MOST_BLOCKS + 1).collect())
    if len(held) > MOST_BLOCKS:
        held = [tuple(cells.agg(*bounds).first())]
    wide = [i for i in range(1, len(held)) if held[i][0] - held[i - 1][1] > ID_BLOCK]
    cuts = [0, *sorted(sorted(wide, key=lambda i: held[i - 1][1] - held[i][0])[: most - 1]), len(held)]
    return [(held[a][0], held[b - 1][1]) for a, b in zip(cuts, cuts[1:]) if a < b]


def pruned_counts(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """The counts that can belong to the cells, told by ingest and by ranges of cell ids.

    With ``ingest_id`` on both sides, partitions of other ingests are not read (the selected ingests are joined to the
    partition column, so the scan is pruned at run time). Ranges of ids are plain predicates that reach the files, which are sorted by them.
    A superset: whoever uses it still joins with the cells.
    """
    ranges = id_ranges(cells)
    if not ranges:
        return counts.limit(0)
    near: Column = F.lit(False)
    for low, high in ranges:
        near = near | F.col("cell_id").between(low, high)
    found = counts.filter(near)
    if "ingest_id" not in counts.columns or "ingest_id" not in cells.columns:
        return found
    selected = cells.groupBy("ingest_id").agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    # The filter is always true; it tells the optimizer that this side is selective.
    selected = written(selected, "selected_ingests").filter("_low <= _high").select("ingest_id")
    return join_dimension(found, selected, "ingest_id", "left_semi", salt_on="cell_id")


def pack_entries(counts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its counts as an array, sorted by feature."""
    entry = F.struct("feature_id", F.col("raw_count").alias("raw_counts"))
    return counts.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("feature_data"))


def feature_positions(source_features: DataFrame, mapping: DataFrame) -> DataFrame | None:
    """``(ingest_id, first_id, targets)``: for each place in an ingest's block of feature ids, the extract ids it maps to.

    One array per ingest, as long as its feature axis. None where ids of an ingest are no block, so that arrays would be mostly empty.
    """
    span = source_features.groupBy("ingest_id").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n")
    )
    span = written(span, "feature_spans")
    if not span.filter(F.col("last_id") - F.col("first_id") >= SPARSE * F.col("n")).isEmpty():
        return None
    placed = join_dimension(source_features.select(F.col("id").alias("feature_id"), "ingest_id"), mapping, "feature_id", salt_on="feature_id")
    targets = placed.groupBy("ingest_id", "feature_id").agg(F.collect_list("extract_feature_id").alias("ids"))
    # Every place of the block has an entry, most of them empty.
    places = span.select("ingest_id", "first_id", F.posexplode(F.sequence("first_id", "last_id")).alias("place", "feature_id"))
    filled = places.join(targets, ["ingest_id", "feature_id"], "left").groupBy("ingest_id", "first_id").agg(
        F.sort_array(F.collect_list(F.struct("place", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids")))).alias("placed")
    )
    return filled.select("ingest_id", "first_id", F.col("placed.ids").alias("targets"))


def pack_by_position(counts: DataFrame, cells: DataFrame, positions: DataFrame, carried: list[str]) -> DataFrame:
    """Packed counts of the cells with features renumbered after packing: the counts move once.

    Counts, cells and copies of the positions are dealt by ingest and block of cell ids. So a block's counts meet their cells
    and their ingest's positions without a second exchange, and an ingest of any size is spread over many tasks. ``counts``
    must carry ``ingest_id``.
    """
    block = lambda c: F.call_function("div", F.col(c), F.lit(CELLS_PER_BLOCK)).alias("_block")
    none = F.lit(None)
    known = cells.select("ingest_id", block("id"), F.col("id").alias("cell_id"), F.struct(*carried).alias("_cell"))
    left = known.select("*", none.cast("bigint").alias("feature_id"), none.cast("bigint").alias("raw_count"))
    right = counts.select(
        "ingest_id", block("cell_id"), "cell_id", none.cast(known.schema["_cell"].dataType).alias("_cell"), "feature_id", "raw_count"
    )
    dealt = ["ingest_id", "_block"]
    entry = F.when(F.col("feature_id").isNotNull(), F.struct("feature_id", F.col("raw_count").alias("raw_counts")))
    packed = left.unionByName(right).repartition(*dealt).groupBy(*dealt, "cell_id").agg(
        F.first("_cell", ignorenulls=True).alias("_cell"), F.collect_list(entry).alias("entries")
    ).filter(F.col("_cell").isNotNull() & (F.size("entries") > 0))
    copies = known.select(*dealt).distinct().join(positions, "ingest_id").repartition(*dealt)
    met = packed.join(copies.hint("merge"), dealt)
    renumbered = F.expr(
        "flatten(transform(entries, e -> transform(coalesce(get(targets, int(e.feature_id - first_id)), array()),"
        " t -> struct(t AS feature_id, e.raw_counts AS raw_counts))))"
    )
    rows = met.select(*[F.col(f"_cell.{c}").alias(c) for c in carried], "cell_id", F.sort_array(renumbered).cast(_ENTRIES).alias("feature_data"))
    return rows.filter(F.size("feature_data") > 0)


def pack_selected(counts: DataFrame, cells: DataFrame, source_features: DataFrame, mapping: DataFrame,
                  carried: list[str], fits: bool | None = None) -> DataFrame:
    """``(*carried, cell_id, feature_data)`` of the selected cells, features by their extract ids, in one exchange of counts.

    A map of features that may be broadcast is applied where the counts are read, so that fewer move. A larger one is turned
    into positions per ingest, which are looked up in the packed rows. ``cells`` is read several times: pass a written table.
    """
    near = pruned_counts(counts, cells)
    fits = fits_broadcast(mapping) if fits is None else fits
    by_ingest = all("ingest_id" in t.columns for t in (counts, cells, source_features))
    positions = feature_positions(source_features, mapping) if not fits and by_ingest else None
    if positions is not None:
        return pack_by_position(near, cells, positions, carried)
    mapped = join_dimension(near, mapping, "feature_id", salt_on="cell_id", fits=fits).select(
        "cell_id", F.col("extract_feature_id").alias("feature_id"), "raw_count"
    )
    bins = cells.select(F.col("id").alias("cell_id"), *carried)
    return pack_entries(mapped.join(bins, "cell_id"), [*carried, "cell_id"])
