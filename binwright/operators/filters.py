"""Filter maps such as ``{"cell_type__in": ["T cell"], "total_mrna_umis__gte": 500}``."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binwright.errors import FilterError

_COMPARISONS = {
    "eq": lambda c, v: c == v,
    "not_eq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
_NUMERIC_ONLY = {"gt", "gte", "lt", "lte"}
_MEMBERSHIP = {"in", "not_in"}
OPERATORS = [*_COMPARISONS, *_MEMBERSHIP]

_ALIAS = re.compile(r"^\w+\.")


def split_key(key: str) -> tuple[str, str]:
    """``"c.cell_type__in"`` -> ``("cell_type", "in")``; no suffix means equality."""
    name = _ALIAS.sub("", key)
    column, found, operator = name.rpartition("__")
    if not found:
        return name, "eq"
    if not column or not operator:
        raise FilterError(f"filter key {key!r} needs a column and an operator")
    return column, operator


def normalize(filters: Mapping | None) -> list[tuple[str, str, object]]:
    """The map as ``(column, operator, value)`` in map order, with lists under eq/not_eq resolved."""
    out = []
    for key, value in (filters or {}).items():
        column, operator = split_key(key)
        if operator not in OPERATORS:
            raise FilterError(f"unknown operator {operator!r} in {key!r}; use one of {', '.join(OPERATORS)}")
        if operator in ("eq", "not_eq") and isinstance(value, (list, tuple)):
            if len(value) == 1:
                value = value[0]
            else:
                operator = "in" if operator == "eq" else "not_in"
        out.append((column, operator, value))
    return out


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _check_value(column: str, operator: str, value) -> type:
    """Type of the value (or of the list items) after the rules of the map are checked."""
    where = f"{column}__{operator}"
    if operator in _MEMBERSHIP:
        if not isinstance(value, (list, tuple)) or not value:
            raise FilterError(f"{where} needs a non-empty list")
        kinds = {type(v) for v in value}
        if len(kinds) != 1 or kinds.pop() not in (str, int, float):
            raise FilterError(f"{where} needs items of one type: str, int or float")
        return type(value[0])
    if operator in _NUMERIC_ONLY and not _is_number(value):
        raise FilterError(f"{where} needs a number")
    if not isinstance(value, (str, bool, int, float)):
        raise FilterError(f"{where} needs a plain value, got {type(value).__name__}")
    return type(value)


def _check_column(schema: T.StructType, column: str, kind: type) -> None:
    if column not in schema.names:
        raise FilterError(f"no column {column!r}; columns are {', '.join(schema.names)}")
    dtype = schema[column].dataType
    fits = {
        str: isinstance(dtype, T.StringType),
        bool: isinstance(dtype, T.BooleanType),
        int: isinstance(dtype, T.NumericType),
        float: isinstance(dtype, T.NumericType),
    }[kind]
    if not fits:
        raise FilterError(f"a {kind.__name__} value does not fit column {column!r} of type {dtype.simpleString()}")


def _condition(column: str, operator: str, value) -> Column:
    c = F.col(column)
    if operator == "in":
        return c.isin(*value)
    if operator == "not_in":
        return ~c.isin(*value)
    return _COMPARISONS[operator](c, F.lit(value))


def _checked(filters: Mapping | None, schema: T.StructType) -> list[tuple[str, str, object]]:
    conditions = normalize(filters)
    for column, operator, value in conditions:
        _check_column(schema, column, _check_value(column, operator, value))
    return conditions


def predicate(filters: Mapping | None, schema: T.StructType) -> Column | None:
    """All conditions ANDed in map order as one Column; ``None`` for an empty map."""
    conditions = [_condition(*c) for c in _checked(filters, schema)]
    return reduce(and_, conditions) if conditions else None


def where(df: DataFrame, filters: Mapping | None) -> DataFrame:
    """Rows of ``df`` that satisfy every condition; NULL never satisfies one.

    The map is checked against the schema before any job starts. A membership list of any length is a hash set
    in the filter, so its length changes neither types, rows nor the order of columns.
    """
    condition = predicate(filters, df.schema)
    return df if condition is None else df.filter(condition)


def in_id_range(df: DataFrame, start: int, end: int, filters: Mapping | None = None,
                group: Mapping | None = None, id_column: str = "id") -> DataFrame:
    """Rows with an id in the inclusive range that satisfy the filters and equal the group's keys."""
    found = df.filter(F.col(id_column).between(start, end))
    equalities = {f"{k}__eq": v for k, v in (group or {}).items()}
    return where(where(found, equalities), filters)
