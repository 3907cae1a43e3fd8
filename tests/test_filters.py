import pytest

from binwright.errors import FilterError
from binwright.operators.filters import in_id_range, normalize, predicate, split_key, where
from binwright.operators.projection import (
    check_column_name,
    keep_existing,
    keep_existing_or_all,
    map_columns,
    ordered_feature_subset,
    select_cell_columns,
    select_columns,
)
from tests.conftest import rows


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(
        [(1, 9, "T cell", True, 10.0), (2, 9, "B cell", False, 20.0), (3, 9, None, None, None), (4, 9, "it's", True, 30.0)],
        "id bigint, ingest_id bigint, cell_type string, is_primary boolean, umis double",
    )


@pytest.mark.parametrize("filters, ids", [
    (None, [1, 2, 3, 4]),
    ({}, [1, 2, 3, 4]),
    ({"cell_type__eq": "T cell"}, [1]),
    ({"cell_type": "it's"}, [4]),
    ({"c.cell_type__not_eq": "T cell"}, [2, 4]),
    ({"cell_type__in": ["T cell", "B cell"]}, [1, 2]),
    ({"cell_type__not_in": ["T cell", "B cell"]}, [4]),
    ({"cell_type__eq": ["T cell"]}, [1]),
    ({"cell_type__eq": ["T cell", "B cell"]}, [1, 2]),
    ({"cell_type__not_eq": ["T cell", "B cell"]}, [4]),
    ({"is_primary__eq": True}, [1, 4]),
    ({"umis__gt": 10}, [2, 4]),
    ({"umis__gte": 10, "umis__lt": 30}, [1, 2]),
    ({"umis__lte": 20.0, "is_primary__not_eq": True}, [2]),
    ({"id__in": (2, 3)}, [2, 3]),
])
def test_where(cells, filters, ids):
    assert [r[0] for r in rows(where(cells, filters), "id")] == ids


@pytest.mark.parametrize("filters", [
    {"cell_type__like": "T%"}, {"nope__eq": 1}, {"cell_type__in": []}, {"cell_type__in": "T cell"},
    {"cell_type__in": ["a", 1]}, {"cell_type__in": [True, False]}, {"umis__gt": "10"}, {"umis__gt": True},
    {"cell_type__eq": None}, {"cell_type__eq": {"a": 1}}, {"__eq": 1}, {"cell_type__": 1}, {"umis__eq": "10"},
    {"cell_type__eq": 5}, {"umis__not_in": []},
])
def test_bad_filters_fail_before_any_job(cells, filters):
    with pytest.raises(FilterError):
        where(cells, filters)


def test_split_key_uses_last_separator():
    assert split_key("c.my__col__in") == ("my__col", "in")
    assert split_key("tissue") == ("tissue", "eq")
    assert normalize({"a__eq": [1, 2]}) == [("a", "in", [1, 2])]


def test_long_list_is_the_same_filter(spark, cells):
    frame = spark.range(20).selectExpr("id AS a", "CAST(id AS BIGINT) AS b", "CAST(id / 10 AS FLOAT) AS f", "CAST(id AS STRING) AS s", "CAST(id AS DECIMAL(9,1)) AS d")
    for column, few in (("b", [1.0, 2.5, 3.0]), ("f", [0.1, 0.2, 0.5]), ("s", ["1", "x"]), ("d", [1.0, 2.5]), ("b", [1, 2**40])):
        pad = [f"y{i}" for i in range(5001)] if column == "s" else [type(few[0])(1000 + i) for i in range(5001)]
        for operator in ("in", "not_in"):
            short, long = (where(frame, {f"{column}__{operator}": v}) for v in (few, few + pad))
            assert long.columns == frame.columns and rows(long) == rows(short)
    assert rows(where(cells, {"cell_type__in": ["T cell", "T cell", "B cell"]}), "id") == [(1,), (2,)]
    assert rows(where(cells, {"cell_type__not_in": ["T cell", "B cell"]}), "id") == [(4,)]
    assert rows(where(cells, {"umis__in": [10, 30]}), "id") == [(1,), (4,)]


def test_predicate_is_none_without_filters(cells):
    assert predicate({}, cells.schema) is None


def test_in_id_range(cells):
    assert rows(in_id_range(cells, 2, 4, {"umis__gt": 1}, {"is_primary": True}), "id") == [(4,)]


def test_projection(cells):
    assert select_cell_columns(cells, ["c.cell_type", "cell_type"]).columns == ["id", "ingest_id", "cell_type"]
    assert select_cell_columns(cells, ["umis", "id"]).columns == ["ingest_id", "umis", "id"]
    assert select_cell_columns(cells, None).columns == ["id", "ingest_id"]
    assert select_columns(cells, []).columns == cells.columns
    with pytest.raises(ValueError):
        check_column_name("a.b.c")
    with pytest.raises(ValueError):
        check_column_name("")


def test_tolerant_pruning(cells):
    assert keep_existing(cells, ["umis", "nope", "id"]).columns == ["id", "umis"]
    assert keep_existing(cells, None).columns == cells.columns
    assert keep_existing_or_all(cells, ["nope"]).columns == cells.columns


def test_map_columns(cells):
    mapped = map_columns(cells.withColumnRenamed("cell_type", "obs_id"), {"index": "label", "umis": "n"}, "obs_id")
    assert set(mapped.columns) == {"id", "ingest_id", "obs_id", "is_primary", "n", "label"}


def test_feature_subset_keeps_request_order(spark):
    features = spark.createDataFrame([(1, "a"), (2, "b"), (7, "b"), (3, "c")], "id bigint, symbol string")
    found = ordered_feature_subset(features, "symbol", ["c", "x", "b"])
    assert rows(found) == [(0, "c", 3), (2, "b", 7)]
