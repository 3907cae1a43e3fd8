"""Joins of a big table with a dimension whose size is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 * 2**20
ROW_BYTES = 32  # of a row's header, beside its columns
HOT_ROWS = 4_000_000  # rows of a key that one task joins
MOST_HEAVY = 2_000  # keys that are looked at, at most
MOST_SALTS = 4_096
TASK_ROWS = 500_000  # rows that one task holds in memory at a time, about
WORD = 64  # positions in a mask


def _bytes(field: T.StructField) -> Column:
    """About what a value takes in a broadcast table."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)) + 16
    return F.lit(16)


def fits_broadcast(dim: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``dim`` has at most ``rows`` rows and about ``BROADCAST_BYTES`` bytes."""
    size = sum((_bytes(f) for f in dim.schema.fields), F.lit(ROW_BYTES)).cast("bigint")
    found = dim.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return found["n"] <= rows and found["size"] <= BROADCAST_BYTES


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt by ``keys`` into as many tasks as its rows need, however few tasks read it.

    An aggregate on these keys then holds about ``TASK_ROWS`` rows in a task, instead of all that a task of a small file makes from it.
    """
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)), *keys)


def with_word(df: DataFrame, column: str) -> DataFrame:
    """Adds ``_word`` and ``_bit``: the place of a position in masks of ``WORD`` positions; none for NULL and negative ones."""
    position = F.when(F.col(column) >= 0, F.col(column).cast("bigint"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (position % WORD).cast("int"))
    return df.withColumns({"_word": F.call_function("div", position, F.lit(WORD)), "_bit": bit})


def heavy_keys(big: DataFrame, keys: list[str]) -> dict[int, int]:
    """Hash of each key that holds more than ``HOT_ROWS`` rows of ``big``, and into how many parts it is cut.

    A frequent-items sketch names every key that may hold 1/``MOST_HEAVY`` of the rows (at most that many of them);
    these alone are counted. Both passes read the key columns only.
    """
    hashed = big.select(F.xxhash64(*keys).alias("_key"))
    named = hashed.stat.freqItems(["_key"], 1 / MOST_HEAVY).first()[0] or []
    if not named:
        return {}
    counted = hashed.filter(F.col("_key").isin(named)).groupBy("_key").count().filter(F.col("count") > HOT_ROWS).collect()
    return {r["_key"]: min(MOST_SALTS, -(-r["count"] // HOT_ROWS)) for r in counted}


def _salts(keys: list[str], heavy: dict[int, int]) -> Column:
    """Parts of a row's key: its own number if it is heavy, else one."""
    if not heavy:
        return F.lit(1)
    parts = F.create_map(*[F.lit(v) for pair in heavy.items() for v in pair])
    return F.coalesce(F.try_element_at(parts, F.xxhash64(*keys)), F.lit(1))


def join_dimension(big: DataFrame, dim: DataFrame, on: str | list[str], how: str = "inner",
                   salt_on: str | list[str] | None = None, rows: int = BROADCAST_ROWS,
                   fits: bool | None = None) -> DataFrame:
    """``big`` joined with ``dim``, which holds few rows per key.

    A dimension of at most ``rows`` rows and ``BROADCAST_BYTES`` bytes is broadcast, so the big side never moves. A larger one is
    joined by shuffle on the key plus a salt, never by a broadcast that Spark would choose by the size of the files, which says
    nothing of what is made from them. Only keys that hold many rows of the big side are cut, each into as
    many parts as its rows need: the dimension's rows of these keys are copied, all others are not. The salt is a pure
    function of ``salt_on`` (never random, so a retried task routes its rows the same way). ``fits`` passes the outcome of an
    earlier check of the same dimension. ``how`` may be inner, left, left_semi or left_anti; the big side is on the left.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(dim, rows) if fits is None else fits:
        return big.join(F.broadcast(dim), keys, how)
    heavy = heavy_keys(big, keys)
    if not heavy:
        return big.join(dim.hint("merge"), keys, how)
    spread = [salt_on] if isinstance(salt_on, str) else list(salt_on or big.columns)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), _salts(keys, heavy)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), (_salts(keys, heavy) - 1).cast("int"))))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")
