"""Column expressions: no function here starts a job."""

from binwright.functions.columns import (
    category_code,
    category_key,
    clean_count,
    fill_for_extract,
    group_label,
    json_scalars,
    leftover_json,
    prune_metadata,
    shuffle_hash,
    sparse_indices,
    sparse_values,
)

__all__ = [
    "category_code", "category_key", "clean_count", "fill_for_extract", "group_label",
    "json_scalars", "leftover_json", "prune_metadata", "shuffle_hash", "sparse_indices",
    "sparse_values",
]
