"""Scalar, JSON and array expressions, all built from JVM-side Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_BITS = 60
# Separators of joined keys, fills of missing text, size limit and note of metadata.
KEY_DELIMITER = "##"
LABEL_DELIMITER = "||"
STRING_NULL_FILL = "unknown"
METADATA_VALUE_LIMIT = 2**20
OVERSIZED_NOTE = "Value was removed due to large size: "


def shuffle_hash(value: Column, seed: int = 0) -> Column:
    """Stable 60-bit pseudo-random key of ``value + seed``; another seed gives another order."""
    digest = F.md5((value + F.lit(seed).cast("bigint")).cast("string"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def category_key(columns: list[str], delimiter: str = KEY_DELIMITER) -> Column:
    """Columns joined into one key; NULL in any of them makes the key NULL."""
    if not columns:
        raise ValueError("the list of key columns must not be empty")
    parts = []
    for position, column in enumerate(columns):
        if position:
            parts.append(F.lit(delimiter))
        parts.append(F.col(column).cast("string"))
    return F.concat(*parts)


def group_label(columns: list[str]) -> Column:
    """Readable label of a group whose key columns hold no NULL."""
    return F.concat_ws(LABEL_DELIMITER, *[F.col(c).cast("string") for c in columns])


def json_scalars(json_column: str, keys: list[str]) -> dict[str, Column]:
    """Named keys of a JSON text column as string columns; one parse serves all keys.

    An object or array under a key is not a scalar and gives NULL. Only values that look like one
    are parsed again to tell them from plain text.
    """
    text = F.col(json_column)
    parsed = F.from_json(text, T.StructType([T.StructField(k, T.StringType()) for k in keys]))

    def scalar(key):
        value = parsed.getField(key)
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), f"$['{key}']", "variant"))
        nested = value.rlike(r"^[\[{]") & kind.rlike("^(OBJECT|ARRAY)")
        return F.when(~F.coalesce(nested, F.lit(False)), value)

    return {k: scalar(k) for k in keys}


def leftover_json(columns: list[str]) -> Column:
    """Given columns as one JSON object per row, NULL entries left out."""
    if not columns:
        return F.lit("{}")
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def prune_metadata(metadata: Column, limit: int = METADATA_VALUE_LIMIT, keep: list[str] | None = None) -> Column:
    """JSON text of a ``map<string,string>`` with oversized values replaced by a note.

    ``keep`` then restricts the keys; ``None`` keeps all of them.
    """

    def shorten(_key, value):
        size = F.octet_length(value)
        note = F.concat(F.lit(OVERSIZED_NOTE), size.cast("string"), F.lit(" bytes."))
        return F.when(size > limit, note).otherwise(value)

    pruned = F.transform_values(metadata, shorten)
    if keep is not None:
        wanted = F.array(*[F.lit(k) for k in keep]).cast("array<string>")
        pruned = F.map_filter(pruned, lambda key, _value: F.array_contains(wanted, key))
    return F.to_json(pruned)


def fill_for_extract(column: str, dtype: T.DataType) -> Column:
    """NULL text becomes the empty string, a NULL number becomes NaN, other types stay."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.col(column), F.lit(""))
    if isinstance(dtype, T.NumericType):
        wide = "float" if isinstance(dtype, T.FloatType) else "double"
        return F.coalesce(F.col(column).cast(wide), F.lit(float("nan")).cast(wide))
    return F.col(column)


def category_code(value: Column, categories: Column) -> Column:
    """Position of ``value`` in the shared category array, NULL when it is not one of them."""
    position = F.array_position(categories, value)
    return F.when(position > 0, (position - 1).cast("int"))


def clean_count(value: Column) -> Column:
    """A stored matrix value as integer, truncated toward zero."""
    return value.cast("bigint")


def sparse_indices(entries: Column) -> Column:
    """Column numbers of sorted ``(col_num, value)`` entries."""
    return F.transform(entries, lambda e: e["col_num"].cast("int"))


def sparse_values(entries: Column) -> Column:
    """32-bit values of sorted ``(col_num, value)`` entries."""
    return F.transform(entries, lambda e: e["value"].cast("float"))
