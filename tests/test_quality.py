from collections import Counter

import pytest
from pyspark.sql import functions as F

from binwright.errors import DataValidationError
from binwright.operators import dims
from binwright.operators.joins import expand_to_axis, feature_set_faults
from binwright.operators.quality import (
    count_matrix_validator,
    feature_list_faults,
    feature_matrix_validator,
    file_sizes,
    matrix_faults,
    matrix_profile,
    obs_faults,
    offending_values,
    position_faults,
    raise_on_faults,
    raw_count_check,
    raw_counts_validator,
    repeated_positions,
    string_column_faults,
    validation_report,
)
from binwright.schemas import (
    CELL_INFO,
    FEATURE_INFO,
    INGEST_INFO,
    RAW_MATRIX_COO,
    conform,
    null_counts,
    struct_from_annotations,
)
from binwright.session import scratch_path
from tests.conftest import rows

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def x(spark):
    values = {
        "good": [1.0, 3.0, 0.0, 2.999999999], "nan": [NAN, 1.0], "inf": [INF, -INF], "neg": [-1.0, 2.0],
        "frac": [1.5, 2.25, 3.0], "big": [3e9, 1.0], "edge": [2147483647.0, -2147483648.0],
    }
    rows_ = [(f, i, 0, v) for f, vs in values.items() for i, v in enumerate(vs)] + [("shape", 5, 0, 1.0), ("shape", 0, 9, 1.0)]
    return spark.createDataFrame(rows_, "file string, row_pos bigint, col_pos bigint, value double")


@pytest.fixture(scope="module")
def shapes(spark):
    files = ["good", "nan", "inf", "neg", "frac", "big", "edge", "shape", "empty"]
    return spark.createDataFrame([(f, 5, 3) for f in files], "file string, n_obs bigint, n_vars bigint")


def test_matrix_profile(x, shapes):
    found = {r["file"]: r.asDict() for r in matrix_profile(x, shapes).collect()}

    def counts(file):
        return {k: v for k, v in found[file].items() if k not in ("file", "n_values") and v}

    assert counts("good") == {} and found["good"]["n_values"] == 4
    assert counts("nan") == {"nan": 1, "non_integer": 1}
    assert counts("inf") == {"infinite": 2, "negative": 1, "int32_range": 2}
    assert counts("neg") == {"negative": 1}
    assert counts("frac") == {"non_integer": 2}
    assert counts("big") == {"int32_range": 1}
    assert counts("edge") == {"negative": 1}
    assert counts("shape") == {"shape": 2}
    assert found["empty"]["n_values"] == 0


def test_profiles_pick_their_checks(x, shapes):
    count = {(r["file"], r["check"]): (r["n"], r["sample"]) for r in matrix_faults(x, shapes, "count_matrix").collect()}
    assert count[("frac", "X: non_integer")] == (2, "1.5, 2.25")
    feature = rows(matrix_faults(x, shapes, "feature_matrix"), "file", "check", "n")
    assert feature == [("inf", "X: infinite", 2), ("nan", "X: nan", 1), ("shape", "X: shape", 2)]
    assert rows(matrix_faults(None, shapes, "count_matrix"), "check")[0] == ("X: matrix is missing",)
    with pytest.raises(DataValidationError):
        matrix_faults(x, shapes, "no_such_profile")


def test_null_values_and_files_without_shape(spark, shapes):
    x = spark.createDataFrame(
        [("good", 0, 0, None), ("good", None, 0, 1.0), ("good", 1, 1, 2.0), ("unknown", 0, 0, 1.0)],
        "file string, row_pos bigint, col_pos bigint, value double",
    )
    found = rows(matrix_faults(x, shapes, "count_matrix"), "file", "check", "n", "sample")
    assert found == [("good", "X: null", 1, "NULL"), ("good", "X: shape", 1, "1.0"), ("unknown", "X: shape", 1, "1.0")]


def test_examples_are_limited_before_the_shuffle(spark, shapes):
    many = spark.range(5000).select(
        F.lit("good").alias("file"), F.col("id").alias("row_pos"), F.lit(0).cast("bigint").alias("col_pos"), F.lit(-1.0).alias("value")
    )
    found = offending_values(many, shapes, ["negative"])
    assert [r["row_pos"] for r in found.orderBy("row_pos").collect()] == [0, 1, 2, 3, 4]
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_repeated_positions(spark, x):
    assert rows(repeated_positions(x)) == []
    assert rows(repeated_positions(x.unionByName(x.filter("file = 'neg'")))) == [("neg", 2)]


def test_obs_faults(spark):
    obs = spark.createDataFrame(
        [("f", "1", 1.0, 1, "true"), ("f", "x", 1.5, 2, "no"), ("f", None, None, 0, None), ("g", "300", 2.0, 1, "false")],
        "file string, a string, b double, c int, d string",
    )
    columns = [("a", "int32", True), ("b", "int64", True), ("c", "bool", True), ("d", "bool", True),
               ("missing", "string", False), ("optional", "string", True)]
    assert rows(obs_faults(obs, columns), "file", "check", "column_name", "n") == [
        ("*", "obs: missing column", "missing", 1), ("f", "obs: cannot be cast", "a", 1),
        ("f", "obs: cannot be cast", "b", 1), ("f", "obs: cannot be cast", "c", 1),
    ]
    assert rows(obs_faults(obs, [("a", "int8", True)]), "file", "n") == [("f", 1), ("g", 1)]


def test_string_faults_and_raise(spark):
    df = spark.createDataFrame([("f", "a", 1), ("f", None, 2), ("g", "c", 3)], "file string, s string, n int")
    faults = string_column_faults(df, ["s", "n", "absent"], "obs")
    assert rows(faults, "file", "check", "column_name", "n") == [
        ("*", "obs: missing column", "absent", 1), ("*", "obs: not text", "n", 1), ("f", "obs: NULL values", "s", 1),
    ]
    with pytest.raises(DataValidationError) as error:
        raise_on_faults(faults)
    assert len(error.value.errors) == 3
    raise_on_faults(faults.filter("n > 9"))


def test_feature_sets(spark):
    schema = spark.createDataFrame([(f"g{i}", i) for i in range(8)], "feature_name string, position bigint")
    files = spark.createDataFrame(
        [("a", i, f"g{i}") for i in range(8)] + [("b", 0, "g3"), ("b", 1, "new"), ("c", 0, "other")],
        "file string, col_pos bigint, feature_name string",
    )
    assert rows(feature_set_faults(files, schema)) == [("b", "unknown", 1, ["new"]), ("c", "unknown", 1, ["other"])]
    assert rows(feature_set_faults(files, schema, is_subset=False)) == [
        ("b", "missing", 7, ["g0", "g1", "g2", "g4", "g5"]), ("b", "unknown", 1, ["new"]),
        ("c", "missing", 8, ["g0", "g1", "g2", "g3", "g4"]), ("c", "unknown", 1, ["other"]),
    ]
    scattered = spark.createDataFrame([("d", f"g{i}") for i in (1, 2, 4, 7)] + [("e", f"g{i}") for i in range(7)], "file string, feature_name string")
    assert rows(feature_set_faults(scattered, schema, is_subset=False)) == [
        ("d", "missing", 4, ["g0", "g3", "g5", "g6"]), ("e", "missing", 1, ["g7"])]
    numbers = spark.createDataFrame([("f", 1), ("f", 2)], "file string, feature_name bigint")
    assert rows(feature_set_faults(numbers, schema, is_subset=False)) == [
        ("f", "missing", 8, ["g0", "g1", "g2", "g3", "g4"]), ("f", "not text", 2, ["bigint"]), ("f", "unknown", 2, ["1", "2"])]
    x = spark.createDataFrame([("b", 0, 0, 5.0), ("b", 0, 1, 6.0)], "file string, row_pos bigint, col_pos bigint, value double")
    assert rows(expand_to_axis(x, files, schema)) == [("b", 0, 3, 5.0)]


def test_positions_are_told_apart_by_masks(spark):
    files = {
        "whole": list(range(200)), "gap": [p for p in range(300) if p not in (0, 64, 299 - 100)], "twice": [*range(130), 5, 64, 64],
        "odd": [*range(70), None, None, -1, -64], "none": [None], "minus": [-3], "far": [0, 10**12],
    }
    df = spark.createDataFrame([(f, p) for f, ps in files.items() for p in ps], "file string, col_pos bigint")

    def fault(ps):
        places = {p for p in ps if p is not None and p >= 0}
        return len(ps) - len(places) + max(max([p for p in ps if p is not None], default=-1) + 1 - len(places), 0)

    expected = sorted((f, fault(ps)) for f, ps in files.items() if fault(ps))
    for kind in ("bigint", "int", "double"):
        typed = df.filter("file <> 'far'").withColumn("col_pos", F.col("col_pos").cast(kind))
        assert [(f, int(n)) for f, n in rows(position_faults(typed, "col_pos", "var"), "file", "n")] == [e for e in expected if e[0] != "far"]
    assert rows(position_faults(df, "col_pos", "var"), "file", "n") == expected
    plan = position_faults(df, "col_pos", "var")._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and "distinct" not in plan


def test_positions_of_values_are_dealt_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(dims, "TASK_ROWS", 100)
    x = spark.range(1000).selectExpr("IF(id % 2 = 0, 'a', 'b') AS file", "id % 495 AS row_pos", "IF(id < 990, 1, NULL) AS col_pos").coalesce(1)
    places = [("a" if i % 2 == 0 else "b", i % 495, 1 if i < 990 else None) for i in range(1000)]
    found = repeated_positions(x)
    assert rows(found) == sorted((f, n) for f in "ab" if (n := sum(places.count(p) > 1 for p in set(places) if p[0] == f)))
    twice = x.unionByName(x.filter("row_pos < 7"))
    again = Counter(places + [p for p in places if p[1] < 7])
    assert rows(repeated_positions(twice)) == sorted((f, sum(n > 1 for p, n in again.items() if p[0] == f)) for f in "ab")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "10), REPARTITION_BY_NUM" in plan


def test_feature_sets_of_many_features(spark, monkeypatch):
    monkeypatch.setattr(dims, "TASK_ROWS", 100)
    names = [f"g{i:03}" for i in range(320)]
    schema = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature_name string, position bigint")
    files = {
        "all": names, "first": names[3:], "last": names[:-2], "word": names[:64] + names[128:], "odd": names[1::2],
        "twice": [*names[:63], *names[:63], *names[64:256]], "end": names[:256], "one": names[319:],
        "new": [*names, *[f"x{i:03}" for i in range(250)], "x001"],
    }
    df = spark.createDataFrame([(f, n) for f, ns in files.items() for n in ns], "file string, feature_name string").coalesce(1)
    missing = {f: sorted(set(names) - set(ns)) for f, ns in files.items()}
    expected = [(f, "missing", len(m), m[:5]) for f, m in missing.items() if m]
    expected.append(("new", "unknown", 250, [f"x{i:03}" for i in range(5)]))
    found = feature_set_faults(df, schema, is_subset=False)
    assert rows(found) == sorted(expected)
    assert "hashpartitioning(file" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan


def test_feature_list(spark):
    df = spark.createDataFrame([("a", "s"), ("a", "t"), (None, "u"), ("b", None)], "ensemble_id string, symbol string")
    assert sorted(map(str, feature_list_faults(df).collect())) == sorted([
        "Row(check='repeated id', ensemble_id='a', n=2)", "Row(check='NULL id', ensemble_id=None, n=1)"])
    assert rows(feature_list_faults(df.filter("symbol = 'none'"))) == [("no rows", None, 0)]
    with pytest.raises(DataValidationError):
        feature_list_faults(df.drop("symbol"))


def test_raw_count_check(spark, x, shapes):
    found = {r["file"]: r["is_valid"] for r in raw_count_check(x, shapes).collect()}
    assert found == {"good": True, "nan": False, "inf": False, "neg": True, "frac": False, "big": True, "edge": True,
                     "shape": True, "empty": False}


def test_report(spark, x, shapes):
    gate = shapes.select("file", (F.col("file") != "nan").alias("is_valid"))
    report = validation_report({"x": x, "shapes": shapes}, gate, [
        raw_counts_validator, "binwright.operators.quality.count_matrix_validator", feature_matrix_validator,
    ])
    found = {(r["file"], r["validator"].split(".")[-1]): (r["is_valid"], r["message"]) for r in report.collect()}
    assert len(found) == 9 + 3 * 8
    assert found[("nan", "file_size")] == (False, "File size is too large.") and ("nan", "count_matrix_validator") not in found
    assert found[("empty", "raw_counts_validator")] == (False, "The matrix is empty.")
    assert found[("frac", "count_matrix_validator")] == (False, "2 non_integer")
    assert found[("frac", "feature_matrix_validator")] == (True, None)
    assert count_matrix_validator.__name__ == "count_matrix_validator"


def test_file_sizes(spark):
    path = scratch_path(spark, "files")
    spark.range(10).coalesce(1).write.csv(path)
    sizes = file_sizes(spark, f"{path}/*.csv", 20)
    assert rows(sizes, "n_bytes", "is_valid") == [(20, True)]
    assert rows(file_sizes(spark, f"{path}/*.csv", 19), "is_valid") == [(False,)]


def test_schemas(spark):
    assert (len(CELL_INFO), len(FEATURE_INFO), len(INGEST_INFO), len(RAW_MATRIX_COO)) == (24, 9, 2, 3)
    declared = struct_from_annotations({
        "id": int, "score": float | None, "tag": str | None, "ok": bool, "labels": list[str], "meta": dict, "odd": bytes,
    })
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in declared] == [
        ("id", "bigint", False), ("score", "double", True), ("tag", "string", True), ("ok", "boolean", False),
        ("labels", "array<string>", False), ("meta", "string", False), ("odd", "string", False),
    ]
    df = spark.createDataFrame([("1", "2", "3"), (None, "2", "3")], "cell_id string, feature_id string, raw_count string")
    assert rows(conform(df.limit(1), RAW_MATRIX_COO)) == [(1, 2, 3)]
    assert rows(null_counts(df, RAW_MATRIX_COO)) == [("cell_id", 1), ("feature_id", 0), ("raw_count", 0)]
    with pytest.raises(Exception, match="NULL in required column cell_id"):
        conform(df, RAW_MATRIX_COO).collect()
    with pytest.raises(DataValidationError):
        conform(df.drop("cell_id"), RAW_MATRIX_COO)
