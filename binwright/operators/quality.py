"""Data-quality jobs: faults are rows, one aggregate per input table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from importlib import import_module

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binwright.errors import DataValidationError
from binwright.operators.dims import BROADCAST_ROWS, dealt, join_dimension, with_word
from binwright.schemas import DTYPES
from binwright.session import freeze

# Limits and tolerances of the matrix checks, examples shown, report messages.
INT32_MIN, INT32_MAX = -(2**31), 2**31 - 1
RELATIVE_TOLERANCE, ABSOLUTE_TOLERANCE = 1e-5, 1e-8
SUM_TOLERANCE = 0.01
EXAMPLES = 5
TOO_LARGE = "File size is too large."

# The checks of each matrix profile; ``null`` is added, as a long table can hold NULL values.
MATRIX_PROFILES = {
    "count_matrix": ["shape", "nan", "infinite", "negative", "non_integer", "int32_range", "null"],
    "feature_matrix": ["shape", "nan", "infinite", "null"],
    "placed": ["shape", "null"],  # what ids are made from, whatever the values mean
}


# -- required text columns ---------------------------------------------------------------------

def required_string_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.StringType) and not f.nullable]


def string_column_faults(df: DataFrame, required: list[str], context: str, key: str = "file") -> DataFrame:
    """``(file, check, column_name, n, sample)`` of required text columns: missing, not text, NULL."""
    spark = df.sparkSession
    absent = [c for c in required if c not in df.columns]
    wrong = [c for c in required if c in df.columns and not isinstance(df.schema[c].dataType, T.StringType)]
    fixed = [("*", f"{context}: missing column", c, 1, None) for c in absent]
    fixed += [("*", f"{context}: not text", c, 1, None) for c in wrong]
    faults = spark.createDataFrame(fixed, "file string, check string, column_name string, n bigint, sample string")
    present = [c for c in required if c in df.columns]
    if not present:
        return faults
    counted = df.groupBy(key).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    nulls = counted.unpivot(key, present, "column_name", "n").filter(F.col("n") > 0)
    return faults.unionByName(
        nulls.select(
            F.col(key).alias("file"), F.lit(f"{context}: NULL values").alias("check"), "column_name", "n",
            F.lit(None).cast("string").alias("sample"),
        )
    )


# -- declared obs columns ----------------------------------------------------------------------

def _not_castable(column: str, source: T.DataType, target: T.DataType) -> Column:
    """A present value that has no exact counterpart in the target type.

    A cast alone is too lenient: it cuts fractions and takes any number as a truth value.
    """
    value = F.col(column)
    bad = value.try_cast(target).isNull()
    if isinstance(source, (T.FloatType, T.DoubleType)) and isinstance(target, T.IntegralType):
        bad = bad | (value != F.rint(value))
    if isinstance(source, T.NumericType) and isinstance(target, T.BooleanType):
        bad = bad | ~value.isin(0, 1)
    return value.isNotNull() & bad


def obs_faults(obs: DataFrame, columns: list[tuple[str, str, bool]], key: str = "file") -> DataFrame:
    """Faults of declared ``(name, dtype, nullable)`` obs columns, all columns in one aggregate.

    A missing required column is a fault, and so is a value that cannot be cast; NULL is castable.
    """
    absent = [c for c, _, nullable in columns if c not in obs.columns and not nullable]
    fixed = obs.sparkSession.createDataFrame(
        [("*", "obs: missing column", c, 1, None) for c in absent],
        "file string, check string, column_name string, n bigint, sample string",
    )
    present = [(c, DTYPES[d]) for c, d, _ in columns if c in obs.columns]
    if not present:
        return fixed
    counted = obs.groupBy(key).agg(*[
        F.count_if(_not_castable(c, obs.schema[c].dataType, t)).alias(c) for c, t in present
    ])
    bad = counted.unpivot(key, [c for c, _ in present], "column_name", "n").filter(F.col("n") > 0)
    return fixed.unionByName(
        bad.select(F.col(key).alias("file"), F.lit("obs: cannot be cast").alias("check"), "column_name", "n",
                   F.lit(None).cast("string").alias("sample"))
    )


# -- matrix values -----------------------------------------------------------------------------

def _matrix_checks(value: Column, row: Column, col: Column, n_obs: Column, n_vars: Column) -> dict[str, Column]:
    v = value.cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    nearest = F.rint(v)
    off = F.abs(v - nearest) > F.lit(ABSOLUTE_TOLERANCE) + F.lit(RELATIVE_TOLERANCE) * F.abs(nearest)
    inside = (row >= 0) & (row < n_obs) & (col >= 0) & (col < n_vars)
    return {
        "shape": ~F.coalesce(inside, F.lit(False)),  # also where a position is NULL or the file has no shape
        "nan": F.isnan(v),
        "infinite": F.abs(v) == F.lit(float("inf")),
        "negative": ~F.isnan(v) & (v < 0),
        "non_integer": F.isnan(v) | (finite & off),
        "int32_range": ~F.isnan(v) & ((v < INT32_MIN) | (v > INT32_MAX)),
        "null": v.isNull(),
    }


def _with_shape(x: DataFrame, shapes: DataFrame) -> DataFrame:
    return join_dimension(x, shapes.select("file", "n_obs", "n_vars"), "file", "left", salt_on=["row_pos", "col_pos"])


def matrix_profile(x: DataFrame, shapes: DataFrame) -> DataFrame:
    """Every matrix check counted per file in one pass; a file of any size is combined map-side.

    ``x`` holds ``(file, row_pos, col_pos, value)``, ``shapes`` ``(file, n_obs, n_vars)``. Files
    without a stored value have ``n_values`` 0; values of a file without a shape are all outside it.
    """
    checks = _matrix_checks(*[F.col(c) for c in ("value", "row_pos", "col_pos", "n_obs", "n_vars")])
    counted = _with_shape(x, shapes).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_values"),
        *[F.count_if(condition).alias(name) for name, condition in checks.items()],
    )
    names = ["n_values", *checks]
    return shapes.select("file").join(counted, "file", "full").select(
        "file", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def matrix_faults(x: DataFrame | None, shapes: DataFrame, profile: str) -> DataFrame:
    """Fault rows of the checks that belong to ``profile``, with up to five offending values each."""
    if profile not in MATRIX_PROFILES:
        raise DataValidationError(f"X: unknown validation type {profile!r}")
    if x is None:
        return shapes.select(
            "file", F.lit("X: matrix is missing").alias("check"), F.lit(None).cast("string").alias("column_name"),
            F.lit(1).cast("bigint").alias("n"), F.lit(None).cast("string").alias("sample"),
        )
    wanted = MATRIX_PROFILES[profile]
    profiled = freeze(matrix_profile(x, shapes))
    counted = profiled.unpivot("file", wanted, "check", "n").filter(F.col("n") > 0)
    faulty = counted.select("file").distinct()
    n_faulty = faulty.count()
    no_sample = F.lit(None).cast("string").alias("sample")
    if n_faulty:
        # Only files with a fault are read once more for examples; clean input costs one pass.
        suspects = join_dimension(x, faulty, "file", "left_semi", salt_on=["row_pos", "col_pos"], fits=n_faulty <= BROADCAST_ROWS)
        samples = offending_values(suspects, shapes, wanted).groupBy("file", "check").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "value"))), lambda e: e["value"]), ", ")
            .alias("sample")
        )
        counted, no_sample = counted.join(samples, ["file", "check"], "left"), F.col("sample")
    return counted.select(
        "file", F.concat(F.lit("X: "), "check").alias("check"), F.lit(None).cast("string").alias("column_name"),
        "n", no_sample,
    )


def offending_values(x: DataFrame, shapes: DataFrame, wanted: list[str]) -> DataFrame:
    """First five offenders per file and check, by position; the limit is applied before the shuffle."""
    checks = _matrix_checks(*[F.col(c) for c in ("value", "row_pos", "col_pos", "n_obs", "n_vars")])
    hit = F.array_compact(F.array(*[F.when(checks[name], F.lit(name)) for name in wanted]))
    offenders = _with_shape(x, shapes).select(
        "file", "row_pos", "col_pos", F.coalesce(F.col("value").cast("string"), F.lit("NULL")).alias("value"),
        F.explode(hit).alias("check"),
    )
    first = Window.partitionBy("file", "check").orderBy("row_pos", "col_pos")
    return offenders.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= EXAMPLES)


def repeated_positions(x: DataFrame) -> DataFrame:
    """``(file, n_repeated)``: positions stored more than once. Few are: rows are dealt before they are counted, not combined first."""
    place = ["file", "row_pos", "col_pos"]
    repeated = dealt(x.select(*place), place).groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return repeated.groupBy("file").agg(F.count(F.lit(1)).alias("n_repeated"))


def position_faults(df: DataFrame, column: str, context: str) -> DataFrame:
    """Files whose positions are not 0 to n - 1, each once: ``n`` counts what is repeated, NULL, negative or left out.

    Whole positions are told apart by the bits of masks, so a task holds a row for each 64 of them rather than each of them.
    """
    if isinstance(df.schema[column].dataType, T.IntegralType):
        words = with_word(df.select("file", column), column).groupBy("file", "_word").agg(
            F.count(F.lit(1)).alias("rows"), F.bit_or("_bit").alias("mask"), F.max(column).alias("last")
        )
        held = [F.sum("rows").alias("rows"), F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)).alias("places")]
        counted = words.groupBy("file").agg(*held, F.coalesce(F.max("last") + 1, F.lit(0)).alias("end"))
    else:
        counted = df.groupBy("file").agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct(F.when(F.col(column) >= 0, F.col(column))).alias("places"),
            F.coalesce(F.max(column) + 1, F.lit(0)).alias("end"),
        )
    surplus, gaps = F.col("rows") - F.col("places"), F.greatest(F.col("end") - F.col("places"), F.lit(0))
    return counted.select(
        "file", F.lit(f"{context}: positions").alias("check"), F.lit(column).alias("column_name"),
        (surplus + gaps).alias("n"), F.lit(None).cast("string").alias("sample"),
    ).filter(F.col("n") > 0)


def repeated_faults(x: DataFrame) -> DataFrame:
    """``repeated_positions`` as fault rows."""
    return repeated_positions(x).select(
        "file", F.lit("X: repeated positions").alias("check"), F.lit(None).cast("string").alias("column_name"),
        F.col("n_repeated").alias("n"), F.lit(None).cast("string").alias("sample"),
    )


def raw_count_check(x: DataFrame, files: DataFrame) -> DataFrame:
    """``(file, n_values, is_valid)``: valid when the file's sum is within 0.01 of a whole number."""
    summed = x.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("double")).alias("s"))
    near = F.abs(F.col("s") - F.rint("s")) <= SUM_TOLERANCE
    return files.select("file").join(summed, "file", "left").select(
        "file", F.coalesce("n", F.lit(0)).alias("n_values"), F.coalesce(near, F.lit(False)).alias("is_valid")
    )


# -- feature lists -----------------------------------------------------------------------------

def feature_list_faults(features: DataFrame) -> DataFrame:
    """``(check, ensemble_id, n)``: no rows, NULL ids and every repeated id of a feature list."""
    missing = [c for c in ("ensemble_id", "symbol") if c not in features.columns]
    if missing:
        raise DataValidationError(f"feature list is missing columns: {', '.join(missing)}")
    counted = features.groupBy("ensemble_id").agg(F.count(F.lit(1)).alias("n"))
    bad = counted.filter(F.col("ensemble_id").isNull() | (F.col("n") > 1)).select(
        F.when(F.col("ensemble_id").isNull(), F.lit("NULL id")).otherwise(F.lit("repeated id")).alias("check"),
        "ensemble_id", "n",
    )
    empty = features.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0).select(
        F.lit("no rows").alias("check"), F.lit(None).cast("string").alias("ensemble_id"), "n"
    )
    return bad.unionByName(empty)


# -- collected validation and reports ----------------------------------------------------------

def collected_faults(obs: DataFrame, x: DataFrame, file_features: DataFrame, shapes: DataFrame,
                     obs_columns: list[tuple[str, str, bool]], schema_features: DataFrame,
                     profile: str = "count_matrix", is_subset: bool = True) -> DataFrame:
    """All faults of obs, features and matrix: ``(file, check, column_name, n, sample)``."""
    from binwright.operators.joins import feature_set_faults

    features = feature_set_faults(file_features, schema_features, is_subset).select(
        "file", F.concat(F.lit("var: "), "fault", F.lit(" features")).alias("check"),
        F.lit(None).cast("string").alias("column_name"), F.col("n_features").alias("n"),
        F.array_join("examples", ", ").alias("sample"),
    )
    return obs_faults(obs, obs_columns).unionByName(features).unionByName(matrix_faults(x, shapes, profile))


def raise_on_faults(faults: DataFrame, shown: int = 100) -> None:
    """Raises one error that lists the faults; the message is bounded, the fault table it carries is not."""
    faults = freeze(faults)
    rows = faults.orderBy("file", "check", "column_name").limit(shown + 1).collect()
    if rows:
        texts = [
            f"{r['file']}: {r['check']}" + (f" {r['column_name']}" if r["column_name"] else "") + f" ({r['n']})"
            + (f", e.g. {r['sample']}" if r["sample"] else "")
            for r in rows[:shown]
        ]
        raise DataValidationError(texts + (["more faults in the fault table"] if len(rows) > shown else []), faults)


def file_sizes(spark, paths: str | list[str], limit: int) -> DataFrame:
    """``(file, n_bytes, is_valid)``: size gate over any number of files; content is never read."""
    listed = spark.read.format("binaryFile").load(paths).select("path", "length")
    return listed.select(
        F.col("path").alias("file"), F.col("length").alias("n_bytes"), (F.col("length") <= limit).alias("is_valid")
    )


Validator = Callable[[Mapping[str, DataFrame]], DataFrame]


def resolve_validator(validator: str | Validator) -> tuple[str, Validator]:
    """A validator by dotted path or as a function: tables in, ``(file, is_valid, message)`` out."""
    if callable(validator):
        return f"{validator.__module__}.{validator.__name__}", validator
    module, _, name = validator.rpartition(".")
    return validator, getattr(import_module(module), name)


def validation_report(tables: Mapping[str, DataFrame], sizes: DataFrame,
                      validators: list[str | Validator]) -> DataFrame:
    """``(file, validator, is_valid, message)``, one row per file and validator.

    ``sizes`` is the ``(file, is_valid)`` outcome of the size gate. A file that fails it is reported
    once and its rows are left out of the tables that the other validators see.
    """
    report = sizes.select(
        "file", F.lit("file_size").alias("validator"), "is_valid",
        F.when(~F.col("is_valid"), F.lit(TOO_LARGE)).alias("message"),
    )
    passed = sizes.filter("is_valid").select("file")
    kept = {
        name: join_dimension(df, passed, "file", "left_semi") if "file" in df.columns else df
        for name, df in tables.items()
    }
    for validator in validators:
        name, check = resolve_validator(validator)
        rows = check(kept)
        report = report.unionByName(rows.select("file", F.lit(name).alias("validator"), "is_valid", "message"))
    return report


# -- ready-made validators ---------------------------------------------------------------------

def raw_counts_validator(tables: Mapping[str, DataFrame]) -> DataFrame:
    checked = raw_count_check(tables["x"], tables["shapes"])
    message = (
        F.when(F.col("n_values") == 0, F.lit("The matrix is empty."))
        .when(~F.col("is_valid"), F.lit("The sum is not close to an integer: not raw counts."))
    )
    return checked.select("file", "is_valid", message.alias("message"))


def count_matrix_validator(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _profile_validator(tables, "count_matrix")


def feature_matrix_validator(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _profile_validator(tables, "feature_matrix")


def _profile_validator(tables: Mapping[str, DataFrame], profile: str) -> DataFrame:
    names = MATRIX_PROFILES[profile]
    parts = [
        F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {n}"))) for n in names
    ]
    profiled = matrix_profile(tables["x"], tables["shapes"])
    message = F.concat_ws(", ", *parts)
    return profiled.select("file", (message == "").alias("is_valid"), F.nullif(message, F.lit("")).alias("message"))
