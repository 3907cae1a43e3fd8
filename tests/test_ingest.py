import json

import pytest
from pyspark.sql import functions as F

from binwright.errors import DataValidationError, IngestError
from binwright.plans.extract import extract_randomized
from binwright.plans.facets import refresh_facets
from binwright.plans.ingest import (
    ArraySchema,
    Batch,
    first_file_axis,
    ingest_batch,
    ingest_partition,
    partition_files,
    plan_partitions,
    read_registry,
    read_store,
    register_batch,
    sanitize,
    validate_and_sanitize,
)
from binwright.session import scratch_path
from binwright.sources import base
from binwright.sources.base import append_staged, read_table
from tests.conftest import rows


def small_batch(spark, file="a", label="A") -> Batch:
    obs = spark.createDataFrame(
        [(file, i, f"cell_{i}", s, q, 77) for i, (s, q) in enumerate([(label, 0.1), (label, 0.9), ("B", 0.8), ("B", 0.2)])],
        "file string, row_pos bigint, obs_id string, sample string, quality double, id bigint",
    )
    var = spark.createDataFrame(
        [(file, i, f"gene_{i}", f"g{i + 1}", c, "ref") for i, c in enumerate(["1", "X", "MT"])],
        "file string, col_pos bigint, var_id string, gene string, chrom string, reference string",
    )
    x = spark.createDataFrame(
        [(file, r, c, v) for r, c, v in [(0, 0, 1.0), (1, 1, 2.7), (2, 2, 3.0), (3, 0, 4.0), (3, 2, 5.0), (0, 1, 0.4)]],
        "file string, row_pos bigint, col_pos bigint, value double",
    )
    uns = spark.createDataFrame([(file, {"title": "T", "large": "x" * 99})], "file string, metadata map<string,string>")
    return Batch(obs, var, x, uns)


MAPS = ({"index": "original_id", "sample": "donor_id"}, {"index": "ensemble_id", "gene": "symbol"})


def union(*batches):
    out = batches[0]
    for b in batches[1:]:
        out = Batch(out.obs.unionByName(b.obs), out.var.unionByName(b.var), out.x.unionByName(b.x), out.uns.unionByName(b.uns))
    return out


def test_ingest_assigns_ids_and_leftovers(spark):
    warehouse = scratch_path(spark, "wh")
    ingest_batch(spark, warehouse, union(small_batch(spark, "b"), small_batch(spark, "a")), *MAPS, tag="t1", metadata_limit=50)
    cells = read_table(spark, warehouse, "cell_info")
    assert rows(cells, "id", "original_id", "ingest_id", "donor_id", "total_mrna_umis", "tag")[:5] == [
        (0, "cell_0", 0, "A", 1, "t1"), (1, "cell_1", 0, "A", 2, "t1"), (2, "cell_2", 0, "B", 3, "t1"),
        (3, "cell_3", 0, "B", 9, "t1"), (4, "cell_0", 1, "A", 1, "t1"),
    ]
    extra = cells.filter("id = 1").first()["metadata_extra"]
    assert json.loads(extra) == {"quality": 0.9}  # an input column named id is overwritten, not kept
    assert rows(read_table(spark, warehouse, "feature_info"), "id", "ensemble_id", "symbol", "ingest_id")[2:4] == [
        (2, "gene_2", "g3", 0), (3, "gene_0", "g1", 1)]
    assert rows(read_table(spark, warehouse, "raw_matrix_coo"))[:5] == [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 0, 4), (3, 2, 5)]
    ingests = {r["id"]: json.loads(r["metadata_extra"]) for r in read_table(spark, warehouse, "ingest_info").collect()}
    assert ingests[0]["title"] == "T" and "removed due to large size: 99 bytes" in ingests[0]["large"]

    ingest_batch(spark, warehouse, small_batch(spark, "c"), *MAPS)
    assert [r["id"] for r in read_table(spark, warehouse, "cell_info").orderBy("id").collect()] == list(range(12))
    assert read_table(spark, warehouse, "raw_matrix_coo").agg(F.max("cell_id"), F.max("feature_id")).first() == (11, 8)


def test_nothing_is_visible_after_a_failure(spark, monkeypatch):
    warehouse = scratch_path(spark, "wh")
    ingest_batch(spark, warehouse, small_batch(spark, "a"), *MAPS)
    write, calls = base._write, []

    def failing(df, path, schema, sort_column, **how):
        calls.append(path)
        if path.endswith("raw_matrix_coo"):
            raise RuntimeError("disk lost")
        write(df, path, schema, sort_column, **how)

    monkeypatch.setattr(base, "_write", failing)
    with pytest.raises(RuntimeError):
        ingest_batch(spark, warehouse, small_batch(spark, "b"), *MAPS)
    assert len(calls) == 4
    assert read_table(spark, warehouse, "cell_info").count() == 4
    assert spark.read.parquet(f"{warehouse}/cell_info").count() == 8  # staged, never committed
    monkeypatch.undo()
    ingest_batch(spark, warehouse, small_batch(spark, "b"), *MAPS)
    assert rows(read_table(spark, warehouse, "cell_info").groupBy("ingest_id").count()) == [(0, 4), (2, 4)]
    assert read_table(spark, warehouse, "cell_info").select("id").distinct().count() == 8


def test_faulty_files_are_isolated(spark):
    warehouse = scratch_path(spark, "wh")
    bad = small_batch(spark, "b")
    bad = Batch(bad.obs, bad.var.withColumn("reference", F.when(F.col("col_pos") > 0, F.col("reference"))), bad.x, bad.uns)
    batch = union(small_batch(spark, "a"), bad, small_batch(spark, "c"))
    with pytest.raises(DataValidationError, match="b: var: NULL values reference"):
        ingest_batch(spark, warehouse, batch, *MAPS)
    assert read_table(spark, warehouse, "cell_info").count() == 0
    with pytest.raises(IngestError) as error:
        ingest_batch(spark, warehouse, batch, *MAPS, partial=True)
    assert rows(error.value.faults, "file", "column_name") == [("b", "reference")]
    assert rows(read_table(spark, warehouse, "cell_info").groupBy("ingest_id").count()) == [(0, 4), (1, 4)]
    with pytest.raises(DataValidationError, match="missing column ensemble_id"):
        ingest_batch(spark, warehouse, small_batch(spark, "d"), MAPS[0], {}, partial=True)


def replaced(batch, **parts):
    return Batch(*[parts.get(n, getattr(batch, n)) for n in ("obs", "var", "x", "uns")])


def test_misplaced_values_fail_their_file(spark):
    first, moved = F.col("row_pos") + F.col("col_pos") == 0, (F.col("row_pos") == 3) & (F.col("col_pos") == 2)
    b, c, d, e, f = (small_batch(spark, name) for name in "bcdef")
    bad = [
        replaced(b, x=b.x.withColumn("row_pos", F.when(moved, 4).otherwise(F.col("row_pos")).cast("bigint"))),
        replaced(c, x=c.x.withColumn("value", F.when(~first, F.col("value")))),
        replaced(d, x=d.x.unionByName(d.x.filter(first))),
        replaced(e, obs=e.obs.withColumn("row_pos", F.when(F.col("row_pos") < 3, F.col("row_pos")).otherwise(5).cast("bigint"))),
        replaced(f, var=f.var.withColumn("col_pos", F.lit(1).cast("bigint"))),
    ]
    batch, warehouse = union(small_batch(spark, "a"), *bad, small_batch(spark, "g")), scratch_path(spark, "wh")
    with pytest.raises(DataValidationError, match="b: X: shape"):
        ingest_batch(spark, warehouse, batch, *MAPS)
    with pytest.raises(IngestError) as error:
        ingest_batch(spark, warehouse, batch, *MAPS, partial=True)
    assert rows(error.value.faults, "file", "check", "n") == [
        ("b", "X: shape", 1), ("c", "X: null", 1), ("d", "X: repeated positions", 1), ("e", "obs: positions", 2), ("f", "var: positions", 3)]
    assert rows(read_table(spark, warehouse, "cell_info").groupBy("ingest_id").count()) == [(0, 4), (1, 4)]
    assert read_table(spark, warehouse, "raw_matrix_coo").count() == 10


def test_values_of_a_file_without_cells(spark):
    batch = small_batch(spark, "a")
    stray = replaced(batch, x=batch.x.unionByName(small_batch(spark, "z").x))
    with pytest.raises(DataValidationError, match="z: X: shape"):
        ingest_batch(spark, scratch_path(spark, "wh"), stray, *MAPS)


def test_array_backend_reports_positions(spark):
    schema, batch = array_inputs(spark)
    bad = Batch(batch.obs, batch.var, batch.x.unionByName(batch.x.filter("file = 'f2' AND row_pos = 7")))
    with pytest.raises(DataValidationError, match="f2: X: repeated positions"):
        validate_and_sanitize(bad, schema)


def test_staged_directory(spark):
    stage, warehouse = scratch_path(spark, "stage"), scratch_path(spark, "wh")
    spark.createDataFrame([(5, "{}")], base.BASE_TABLES["ingest_info"]).write.parquet(f"{stage}/ingest-info.parquet")
    base.conform(
        spark.createDataFrame([(1, "c", 5, "{}")], "id bigint, original_id string, ingest_id bigint, metadata_extra string"),
        base.BASE_TABLES["cell_info"],
    ).write.parquet(f"{stage}/cell-info.parquet")
    base.conform(
        spark.createDataFrame([(2, "e", 5, "{}", "r")], "id bigint, ensemble_id string, ingest_id bigint, metadata_extra string, reference string"),
        base.BASE_TABLES["feature_info"],
    ).write.parquet(f"{stage}/feature-info.parquet")
    spark.createDataFrame([(1, 2, 9)], "a bigint, b bigint, c bigint").write.csv(f"{stage}/raw-counts-000000.csv")
    append_staged(spark, warehouse, stage)
    append_staged(spark, warehouse, stage)  # a rerun changes nothing
    assert rows(read_table(spark, warehouse, "raw_matrix_coo")) == [(1, 2, 9)]
    assert rows(read_table(spark, warehouse, "cell_info"), "id", "ingest_id") == [(1, 5)]


def array_inputs(spark):
    """Three files of 100, 150 and 200 cells that measure different features of one axis."""
    features = spark.createDataFrame(
        [(f"ENSG{i + 1:06d}", i, f"gene_{i + 1}") for i in range(8)], "feature_name string, position bigint, symbol string"
    )
    schema = ArraySchema([("cell_type", "string", False), ("tissue", "string", True), ("donor_id", "string", True)], features)
    parts = []
    for name, n, used, offset, column in (("f1", 100, [1, 2, 3, 4, 5], 0, "tissue"), ("f2", 150, [3, 4, 5, 6, 7], 3, "donor_id"),
                                          ("f3", 200, [1, 3, 5, 7], 5, None)):
        cells = spark.range(n).select(
            F.lit(name).alias("file"), F.col("id").alias("row_pos"), F.concat(F.lit(f"{name}_"), F.col("id").cast("string")).alias("obs_id"),
            F.concat(F.lit("type_"), (F.col("id") % 3).cast("string")).alias("cell_type"),
            (F.lit("liver") if column == "tissue" else F.lit(None).cast("string")).alias("tissue"),
            (F.lit("d1") if column == "donor_id" else F.lit(None).cast("string")).alias("donor_id"), F.lit(1).alias("leftover"),
        )
        var = spark.createDataFrame([(name, p, f"ENSG{u:06d}", "file's own") for p, u in enumerate(used)],
                                    "file string, col_pos bigint, var_id string, note string")
        k = len(used)
        x = spark.range(n * k).select(
            F.lit(name).alias("file"), F.floor(F.col("id") / k).alias("row_pos"), (F.col("id") % k).alias("col_pos"),
            ((F.col("id") + offset) % 7).cast("double").alias("value"),
        )
        parts.append(Batch(cells, var, x))
    batch = Batch(*[a.unionByName(b).unionByName(c) for a, b, c in zip(*[(p.obs, p.var, p.x) for p in parts])])
    return schema, batch


def test_end_to_end_conservation(spark):
    schema, batch = array_inputs(spark)
    store = scratch_path(spark, "store")
    expected = {
        r["var_id"]: int(r["s"]) for r in batch.x.join(batch.var, ["file", "col_pos"]).groupBy("var_id")
        .agg(F.sum("value").alias("s")).collect()
    }
    register_batch(spark, store, batch)
    register_batch(spark, store, batch)  # labels keep their ids
    files = spark.createDataFrame([("f1", 0), ("f2", 1), ("f3", 2)], "file string, position bigint")
    planned, totals = plan_partitions(files, 3, 2)
    assert totals == {"total_files": 3, "num_partitions": 2, "last_partition_size": 1}
    for index in range(2):
        ingest_partition(spark, store, batch.only(partition_files(planned, 3, index, 2)), schema, index)
    ingest_partition(spark, store, batch.only(partition_files(planned, 3, 1, 2)), schema, 1)

    stored = read_store(spark, store, schema)
    assert sorted(r["id"] for r in stored["obs"].collect()) == list(range(450))
    assert rows(stored["obs"].groupBy("tissue", "donor_id").count()) == [
        ("liver", "unknown", 100), ("unknown", "d1", 150), ("unknown", "unknown", 200)]
    assert "leftover" not in stored["obs"].columns
    counts = stored["X"].select("cell_id", "feature_id", F.col("value").cast("bigint").alias("raw_count"))
    out = scratch_path(spark, "out")
    blocks = extract_randomized(stored["obs"], counts, stored["var"], out, 32, seed=8)
    assert blocks.select("extract_bin").distinct().count() == 15
    assert rows(blocks, "id") == [(i,) for i in range(450)]
    axis = spark.read.parquet(f"{out}/features").select("col_num", "feature_name")
    pairs = blocks.select(F.explode(F.arrays_zip("indices", "values")).alias("e"))
    summed = pairs.groupBy(F.col("e.indices").cast("bigint").alias("col_num")).agg(F.sum("e.values").alias("s")).join(axis, "col_num")
    assert {r["feature_name"]: int(r["s"]) for r in summed.collect()} == expected
    assert read_registry(spark, store, "obs").count() == 450
    with pytest.raises(ValueError):
        partition_files(planned.filter("file <> 'f3'"), 3, 1, 2)


def test_validate_and_sanitize(spark):
    schema, batch = array_inputs(spark)
    clean = validate_and_sanitize(batch, schema)
    assert clean.obs.columns == ["file", "row_pos", "obs_id", "cell_type", "tissue", "donor_id"]
    assert clean.var.filter("symbol is null").count() == 0 and "note" not in clean.var.columns
    broken = Batch(batch.obs.drop("cell_type"), batch.var.withColumn("var_id", F.regexp_replace("var_id", "7$", "9")),
                   batch.x.withColumn("value", F.col("value") - 1))
    with pytest.raises(DataValidationError) as error:
        validate_and_sanitize(broken, schema)
    text = str(error.value)
    assert "missing column cell_type" in text and "var: unknown features" in text and "X: negative" in text

    full = first_file_axis(batch.only(batch.obs.select("file").filter("file = 'f3'").distinct()), schema)
    assert rows(full.x.select("col_pos").distinct()) == [(0,), (2,), (4,), (6,)]
    assert full.x.count() == 800 and full.var.count() == 8


def test_sanitize_types(spark):
    obs = spark.createDataFrame([("f", 0, "c", "3", None)], "file string, row_pos bigint, obs_id string, n string, t string")
    schema = ArraySchema([("n", "int16", False), ("t", "string", True), ("b", "bool", True), ("f", "float32", True),
                          ("k", "string", False)], spark.createDataFrame([("g", 0)], "feature_name string, position bigint"))
    batch = Batch(obs, spark.createDataFrame([("f", 0, "g")], "file string, col_pos bigint, var_id string"), obs)
    clean = sanitize(batch, schema).obs
    assert [f.dataType.simpleString() for f in clean.schema][3:] == ["smallint", "string", "boolean", "float"]
    assert clean.first().asDict() == {"file": "f", "row_pos": 0, "obs_id": "c", "n": 3, "t": "unknown", "b": None, "f": None}


def test_plan_partitions(spark):
    files = spark.createDataFrame([("a", 0)], "file string, position bigint")
    assert plan_partitions(files, 0, 4)[1] == {"total_files": 0, "num_partitions": 0, "last_partition_size": 0}
    with pytest.raises(ValueError):
        plan_partitions(files, 1, 0)


def test_facets(spark):
    cells = spark.createDataFrame([(1, "a", "u1"), (2, "a", "u2"), (3, None, "u3")], "id bigint, k string, u string")
    found = refresh_facets({"d1": cells, "d2": cells.filter("id = 1")}, scratch_path(spark, "facets"), threshold=2)
    assert rows(found.filter("dataset = 'd1'"), "facet", "value", "n") == [("k", "a", 1), ("total_cells", None, 3)]
    assert found.filter("dataset = 'd2'").count() == 3


def test_second_plan_and_unknown_labels(spark):
    schema, batch = array_inputs(spark)
    store = scratch_path(spark, "store")
    one, two = (batch.only(batch.obs.select("file").filter(F.col("file") == f).distinct()) for f in ("f1", "f2"))
    register_batch(spark, store, one)
    ingest_partition(spark, store, one, schema, 0)
    with pytest.raises(Exception, match="unregistered (obs|var) label"):
        ingest_partition(spark, store, two, schema, 0)
    register_batch(spark, store, two)
    ingest_partition(spark, store, two, schema, 0)  # another plan, whose first partition holds other files
    ingest_partition(spark, store, two, schema, 0)
    assert read_store(spark, store, schema)["obs"].count() == 250
