import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from binwright.errors import EmptySelectionError
from binwright.functions import category_key, json_scalars, leftover_json, prune_metadata
from binwright.operators.aggregates import cell_count_of, extract_summary, pack_counts
from binwright.operators.explore import (
    categorical_columns,
    category_lists,
    distinct_counts,
    distinct_values,
    filter_catalogue,
)
from binwright.operators.joins import positions_to_ids, row_and_column_numbers
from binwright.plans.extract import (
    drop_all_null,
    encode_categories,
    extract_bins,
    extract_grouped,
    extract_randomized,
    fill_nulls,
    sparse_blocks,
    union_pieces,
)
from binwright.plans.prepare import ExtractSpec, check_feature_ids, number_features, prepare_extract
from binwright.session import scratch_path, setting
from binwright.sources.sinks import export_csv, read_binned, read_metadata
from binwright.operators.projection import read_bins
from tests.conftest import rows

N_CELLS = 230


@pytest.fixture(scope="module")
def tables(spark):
    """Cells of three ingests, one unknown; two ingests bring their own rows for the same features."""
    n = F.col("id")
    cells = spark.range(N_CELLS).select(
        (n + 1000).alias("id"), (n % 3).alias("ingest_id"),
        F.when(n % 11 != 0, F.concat(F.lit("type_"), (n % 4).cast("string"))).alias("cell_type"),
        F.concat(F.lit("t"), (n % 2).cast("string")).alias("tissue"),
        F.lit(None).cast("string").alias("disease"),
        F.when(n % 5 != 0, n * 1.5).alias("score"),
        F.to_json(F.struct((n % 7).alias("lane"))).alias("metadata_extra"),
    )
    features = spark.range(40).select(
        "id", F.concat(F.lit("ENSG"), (n % 20).cast("string")).alias("ensemble_id"), F.concat(F.lit("g"), n.cast("string")).alias("symbol")
    )
    ingests = spark.createDataFrame([(0,), (1,)], "id bigint")
    counts = spark.range(N_CELLS * 40).select(
        (F.floor(n / 40) + 1000).cast("bigint").alias("cell_id"), (n % 40).alias("feature_id"), (n % 13).alias("raw_count")
    ).filter("raw_count > 0 and feature_id div 20 = cell_id % 2 and cell_id <> 1004")
    return {"cell_info": cells, "ingest_info": ingests, "feature_info": features, "raw_matrix_coo": counts}


@pytest.fixture(scope="module")
def wanted(spark):
    return number_features(spark, [("c", "ENSG3"), ("a", "ENSG17"), ("z", "ENSG0"), ("none", "ENSG999")])


def expected_sums(tables, kept):
    """Per requested feature, the sum over the kept cells."""
    order = {"ENSG3": 0, "ENSG17": 1, "ENSG0": 2}
    out = {}
    for r in tables["raw_matrix_coo"].collect():
        ensemble = f"ENSG{r['feature_id'] % 20}"
        if r["cell_id"] in kept and ensemble in order:
            out[order[ensemble]] = out.get(order[ensemble], 0) + r["raw_count"]
    return out


def block_sums(blocks):
    pairs = blocks.select(F.explode(F.arrays_zip("indices", "values")).alias("e"))
    summed = pairs.groupBy(F.col("e.indices").alias("i")).agg(F.sum(F.col("e.values")).alias("s"))
    return {r["i"]: int(r["s"]) for r in summed.collect()}


@pytest.mark.parametrize("bin_keys", [[], ["cell_type", "tissue"]])
def test_prepare_and_extract_conserve_everything(spark, tables, wanted, bin_keys):
    path = scratch_path(spark, "extract")
    spec = ExtractSpec(bin_size=16, seed=4, filters={"c.id__lt": 1200}, obs_columns=["cell_type", "score", "disease"],
                       bin_keys=bin_keys, metadata_columns=["lane"], partition_size=2)
    metadata = prepare_extract(tables, wanted, path, spec).first()
    kept = {r["id"] for r in tables["cell_info"].collect() if r["ingest_id"] < 2 and r["id"] < 1200}
    assert metadata["total_cells"] == len(kept)
    assert metadata["category_metadata"]["cell_type"] == ["type_0", "type_1", "type_2", "type_3"]
    assert sorted(metadata["category_metadata"]["lane"]) == list("0123456")

    cells = read_binned(spark, f"{path}/cell_info")
    sizes = {r["extract_bin"]: r["count"] for r in cells.groupBy("extract_bin").count().collect()}
    assert sorted(sizes) == list(range(metadata["total_bins"])) and max(sizes.values()) <= 16
    assert sizes[metadata["total_bins"] - 1] == metadata["last_bin_size"]
    if bin_keys:
        # A NULL in any key makes the whole key NULL, and all such cells share the first bins.
        key = category_key(["cell_type", "tissue"])
        mixed = cells.join(tables["cell_info"].select("id", "tissue"), "id").groupBy("extract_bin").agg(
            F.count_distinct(F.coalesce(key, F.lit("NULL"))).alias("k"), F.bool_and(key.isNull()).alias("null_key"))
        assert mixed.filter("k > 1").count() == 0
        assert mixed.filter("null_key").agg(F.max("extract_bin")).first()[0] < mixed.filter("not null_key").agg(F.min("extract_bin")).first()[0]
    else:
        assert all(n == 16 for b, n in sizes.items() if b < metadata["total_bins"] - 1)

    blocks = extract_bins(spark, path, f"{path}/out")
    assert rows(blocks, "id") == [(i,) for i in sorted(kept)]
    assert block_sums(blocks) == expected_sums(tables, kept)
    assert "disease" not in blocks.columns and {"cell_type_code", "lane_code"} <= set(blocks.columns)
    assert blocks.filter("cell_type is null and cell_type_code is not null").count() == 0
    assert blocks.filter("isnan(score)").count() == len([i for i in kept if (i - 1000) % 5 == 0])
    assert blocks.select("n_features").distinct().collect()[0][0] == 4
    assert len(blocks.inputFiles()) == metadata["total_bins"]

    assert extract_bins(spark, path, f"{path}/none", 900, 950, partition_size=2).count() == 0
    some = extract_bins(spark, path, f"{path}/some", 2, 4, partition_size=2)
    assert rows(some.select("extract_bin").distinct()) == [(2,), (3,), (4,)]
    assert rows(some, "id", "row_num") == rows(blocks.filter("extract_bin between 2 and 4"), "id", "row_num")


def test_bin_range_read_prunes_partitions(spark, tables, wanted):
    path = scratch_path(spark, "extract")
    prepare_extract(tables, wanted, path, ExtractSpec(bin_size=8, partition_size=3))
    found = read_bins(read_binned(spark, f"{path}/cell_info"), 4, 7, ["id"], partition_size=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bin_bucket" in plan and "PushedFilters: [IsNotNull(extract_bin)" in plan
    assert found.count() == 32


def test_same_seed_same_bins(spark, tables, wanted):
    bins = []
    for seed in (1, 1, 2):
        path = scratch_path(spark, "extract")
        prepare_extract(tables, wanted, path, ExtractSpec(bin_size=16, seed=seed))
        bins.append(rows(read_binned(spark, f"{path}/cell_info"), "id", "extract_bin"))
    assert bins[0] == bins[1] != bins[2]


def test_prepare_errors(spark, tables, wanted):
    with pytest.raises(ValueError):
        ExtractSpec(bin_size=0)
    with pytest.raises(EmptySelectionError):
        prepare_extract(tables, wanted, scratch_path(spark, "x"), ExtractSpec(bin_size=5, filters={"tissue__eq": "no"}))
    with pytest.raises(ValueError):
        check_feature_ids(wanted.filter("id <> 1"))


def test_grouped_and_randomized_extract(spark, tables):
    cells, counts = tables["cell_info"], tables["raw_matrix_coo"]
    out = scratch_path(spark, "grouped")
    blocks = extract_grouped(cells, counts, tables["feature_info"], out, ["tissue"], 50, obs_columns=["tissue", "nope"],
                             feature_column="symbol", feature_values=["g5", "nope", "g25", "g1"], feature_columns=["symbol"])
    assert rows(blocks.groupBy("extract_bin").agg(F.count_distinct("tissue"))) == [(b, 1) for b in range(6)]
    assert [r["symbol"] for r in spark.read.parquet(f"{out}/features").orderBy("col_num").collect()] == ["g5", "g25", "g1"]
    totals = {r["feature_id"]: r["s"] for r in counts.groupBy("feature_id").agg(F.sum("raw_count").alias("s")).collect()}
    assert block_sums(blocks) == {0: totals[5], 1: totals[25], 2: totals[1]}

    random = extract_randomized(cells, counts, tables["feature_info"], scratch_path(spark, "r"), 32, seed=3)
    assert rows(random, "id") == rows(cells, "id")
    assert block_sums(random) == totals
    sizes = dict(rows(random.groupBy("extract_bin").count()))
    assert sizes == {**{b: 32 for b in range(7)}, 7: 6}
    part = extract_randomized(cells, counts, tables["feature_info"], scratch_path(spark, "r"), 32, seed=3, bins=(2, 5))
    assert rows(part, "id", "extract_bin") == rows(random.filter("extract_bin >= 2 and extract_bin < 5"), "id", "extract_bin")


def test_a_bin_is_one_file(spark, tables):
    """However many tasks write: a join that deals bins by their rows would give each task a file of each bin."""
    cells, counts, features = tables["cell_info"], tables["raw_matrix_coo"], tables["feature_info"]
    out = scratch_path(spark, "one_file")
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):  # small tables would be one task
        runs = [
            extract_grouped(cells, counts, features, f"{out}/g", ["tissue"], 30),
            extract_randomized(cells, counts, features, f"{out}/r", 30, seed=2),
        ]
    for blocks in runs:
        names = [name.split("extract_bin=")[1].split("/")[0] for name in blocks.inputFiles()]
        assert len(names) == blocks.select("extract_bin").distinct().count() == 8
        assert len(set(names)) == len(names)


def test_small_block_exactly(spark):
    cells = spark.createDataFrame(
        [(0, 100, "M", 1.5, None, None), (0, 101, None, None, "x", None)],
        "extract_bin bigint, id bigint, sex string, score double, label string, all_missing string",
    )
    packed = spark.createDataFrame(
        [(0, 100, [(0, 2)]), (0, 101, [(1, 3)])],
        "extract_bin bigint, cell_id bigint, feature_data array<struct<feature_id:bigint,raw_counts:bigint>>",
    )
    codes = spark.createDataFrame([("sex", "M", 0), ("sex", "F", 1)], "column_name string, value string, code int")
    described = drop_all_null(cells, ["sex", "score", "label", "all_missing"])
    described = encode_categories(fill_nulls(described, ["score", "label"]), codes, ["sex"])
    found = [r.asDict() for r in sparse_blocks(described, packed, 2, ["id"]).orderBy("id").collect()]
    assert "all_missing" not in found[0]
    assert [(r["indices"], r["values"], r["n_features"]) for r in found] == [([0], [2.0], 2), ([1], [3.0], 2)]
    assert [(r["sex"], r["sex_code"], r["label"]) for r in found] == [("M", 0, ""), (None, None, "x")]
    assert found[0]["score"] == 1.5 and math.isnan(found[1]["score"])

    with pytest.raises(PySparkException, match="Invalid feature id: 1"):
        sparse_blocks(described, packed, 1, ["id"]).collect()
    with pytest.raises(PySparkException, match="Invalid cell id: 101"):
        sparse_blocks(described.filter("id = 100"), packed, 2, ["id"]).collect()


def test_unknown_ids_fail(spark):
    entries = spark.createDataFrame([(1, 1, 5), (2, 1, 6)], "cell_id bigint, feature_id bigint, value bigint")
    rows_ = spark.createDataFrame([(1, 0), (2, 1)], "cell_id bigint, row_num bigint")
    columns = spark.createDataFrame([(1, 0)], "feature_id bigint, col_num bigint")
    assert rows(row_and_column_numbers(entries, rows_, columns)) == [(0, 0, 5), (1, 0, 6)]
    with pytest.raises(PySparkException, match="Invalid cell id: 2"):
        row_and_column_numbers(entries, rows_.filter("cell_id = 1"), columns).collect()
    with pytest.raises(KeyError):
        positions_to_ids(entries, entries, entries)


def test_long_axis_is_one_row_per_cell(spark):
    counts = spark.range(70_000).select(F.lit(0).alias("extract_bin"), F.lit(7).cast("bigint").alias("cell_id"),
                                     F.col("id").alias("feature_id"), (F.col("id") + 1).alias("raw_count"))
    packed = pack_counts(counts)
    assert sorted(r[0] for r in packed.select(F.size("feature_data")).collect()) == [70_000]
    cells = spark.createDataFrame([(0, 7)], "extract_bin int, id bigint")
    block = sparse_blocks(cells, packed, 70_000, ["id"]).first()
    assert block["indices"] == list(range(70_000)) and block["values"] == [float(v + 1) for v in range(70_000)]


def test_summary_and_fallback_count(spark):
    cells = spark.createDataFrame([(b,) for b in (0, 0, 1, 1, 3)], "extract_bin bigint")
    assert rows(extract_summary(cells)) == [(3, 1, 5)]
    assert rows(extract_summary(cells.filter("extract_bin > 9"))) == [(0, 0, 0)]
    stored = spark.createDataFrame([(3, 4, 0), (0, 0, 0), (3, 4, 99)], "total_bins bigint, last_bin_size bigint, total_cells bigint")
    assert sorted(r["cell_count"] for r in cell_count_of(stored, 10).collect()) == [0, 24, 99]
    assert sorted(r["cell_count"] for r in cell_count_of(stored, None).collect()) == [0, 4, 99]


def test_explore(spark):
    df = spark.createDataFrame(
        [("a", "x", 1, None), ("a", "y", 2, None), (None, "z", 3, None)], "k string, v string, n bigint, empty string"
    )
    assert rows(distinct_counts(df, ["k", "v", "n", "empty"])) == [(1, 3, 3, 0)]
    assert rows(distinct_counts(df, ["k", "v"], approximate=True)) == [(1, 3)]
    assert rows(categorical_columns(df, 1)) == [("empty", 0), ("k", 1)]
    assert [r[0] for r in distinct_values(df, "n").collect()] == ["1", "2", "3"]
    assert rows(category_lists(df, 2)) == [("empty", []), ("k", ["a"])]
    found = {r["column_name"]: (r["field_type"], list(r["operators"]), r["suggest"]) for r in filter_catalogue(df, 1).collect()}
    assert found == {
        "k": ("string", ["in", "not_in"], True), "v": ("string", ["eq", "not_eq", "in", "not_in"], False),
        "n": ("number", ["eq", "gt", "gte", "lt", "lte"], False), "empty": ("string", ["in", "not_in"], True),
    }


def test_scalar_functions(spark):
    df = spark.createDataFrame(
        [(1, "a", None, '{"k": 5, "o": {"x": 1}, "l": [1], "t": "{plain", "n": null}'), (2, "a", "b", "not json")],
        "id bigint, p string, q string, j string",
    )
    assert rows(df.select("id", category_key(["p", "q"]).alias("c"))) == [(1, None), (2, "a##b")]
    keys = ["k", "o", "l", "t", "n"]
    assert rows(df.select("id", *[c.alias(k) for k, c in json_scalars("j", keys).items()])) == [
        (1, "5", None, None, "{plain", None), (2, None, None, None, None, None)
    ]
    assert rows(df.select(leftover_json(["p", "q"]).alias("x"))) == [('{"p":"a","q":"b"}',), ('{"p":"a"}',)]
    assert rows(df.select(leftover_json([]).alias("x"))) == [("{}",), ("{}",)]
    with pytest.raises(ValueError):
        category_key([])
    meta = spark.createDataFrame([({"title": "t", "big": "x" * 50, "drop": "d"},)], "m map<string,string>")
    pruned = meta.select(prune_metadata(F.col("m"), 20, ["title", "big"]).alias("j")).first()["j"]
    assert '"title":"t"' in pruned and "removed due to large size: 50 bytes" in pruned and "drop" not in pruned
    assert meta.select(prune_metadata(F.col("m"), 20, []).alias("j")).first()["j"] == "{}"


def test_union_and_export(spark):
    a = spark.createDataFrame([(1, "x")], "id bigint, a string")
    b = spark.createDataFrame([(2, "y")], "id bigint, b string")
    assert rows(union_pieces([a, b])) == [(1, "x", None), (2, None, "y")]
    with pytest.raises(ValueError):
        union_pieces([])
    path = scratch_path(spark, "csv")
    export_csv(a, path, ["a"])
    assert spark.read.option("header", True).csv(path).columns == ["id"]
    with pytest.raises(ValueError):
        export_csv(a.filter("id > 9"), path)


def test_metadata_document_round_trip(spark, tables, wanted):
    path = scratch_path(spark, "extract")
    spec = ExtractSpec(bin_size=50, filters={"cell_type__in": ["type_1", "type_2"]}, obs_columns=["tissue"])
    prepare_extract(tables, wanted, path, spec)
    row = read_metadata(spark, f"{path}/metadata").first()
    assert row["filters"] == '{"cell_type__in": ["type_1", "type_2"]}' and row["extract_bin_size"] == 50
    assert row["category_metadata"] == {"tissue": ["t0", "t1"]}


def test_two_ranges_keep_each_other(spark, tables):
    from binwright.plans.extract import extract_grouped

    out, whole = scratch_path(spark, "ranges"), scratch_path(spark, "whole")
    run = lambda path, bins: extract_grouped(
        tables["cell_info"], tables["raw_matrix_coo"], tables["feature_info"], path, ["tissue"], 20, bins=bins)
    for bins in ((0, 2), (2, 9999), (0, 2)):
        last = run(out, bins)
    columns = ["extract_bin", "id", "indices", "values"]
    assert rows(spark.read.parquet(f"{out}/bins"), *columns) == rows(run(whole, None), *columns) == rows(last, *columns)
