"""Declared schemas of the base tables and conformance of a DataFrame to a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binwright.errors import DataValidationError


def _required(name: str, dtype: T.DataType) -> T.StructField:
    return T.StructField(name, dtype, nullable=False)


def _optional(name: str, dtype: T.DataType) -> T.StructField:
    return T.StructField(name, dtype, nullable=True)


# The four base tables. JSON columns are strings.
INGEST_INFO = T.StructType([
    _required("id", T.LongType()),
    _optional("metadata_extra", T.StringType()),
])

FEATURE_INFO = T.StructType([
    _required("id", T.LongType()),
    _required("ensemble_id", T.StringType()),
    _optional("symbol", T.StringType()),
    _optional("tag", T.StringType()),
    _required("ingest_id", T.LongType()),
    _required("metadata_extra", T.StringType()),
    _optional("biotype", T.StringType()),
    _optional("is_filtered", T.BooleanType()),
    _required("reference", T.StringType()),
])

CELL_DESCRIPTIVE_COLUMNS = [
    "donor_id", "cell_type", "assay", "development_stage", "tissue", "disease", "organism",
    "self_reported_ethnicity", "sex", "suspension_type",
]

CELL_ONTOLOGY_COLUMNS = [
    f"{c}_ontology_term_id" for c in CELL_DESCRIPTIVE_COLUMNS if c not in ("donor_id", "suspension_type")
]

CELL_INFO = T.StructType(
    [
        _required("id", T.LongType()),
        _required("original_id", T.StringType()),
        _required("ingest_id", T.LongType()),
        _required("metadata_extra", T.StringType()),
        _optional("tag", T.StringType()),
    ]
    + [_optional(c, T.StringType()) for c in CELL_DESCRIPTIVE_COLUMNS]
    + [_optional("total_mrna_umis", T.LongType())]
    + [_optional(c, T.StringType()) for c in CELL_ONTOLOGY_COLUMNS]
)

RAW_MATRIX_COO = T.StructType([
    _required("cell_id", T.LongType()),
    _required("feature_id", T.LongType()),
    _required("raw_count", T.LongType()),
])

BASE_TABLES = {
    "ingest_info": INGEST_INFO,
    "cell_info": CELL_INFO,
    "feature_info": FEATURE_INFO,
    "raw_matrix_coo": RAW_MATRIX_COO,
}

# The requested feature axis of an extract.
EXTRACT_FEATURE_INFO = T.StructType([
    _required("id", T.LongType()),
    _optional("symbol", T.StringType()),
    _required("ensemble_id", T.StringType()),
])

# Declared type name -> Spark type.
DTYPES = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "category": T.StringType(),
}

# Python annotations of a declared record model -> Spark type; anything else is stored as text.
_PYTHON_TYPES = {
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bool: T.BooleanType(),
    dict: T.StringType(),
}


def struct_from_annotations(fields: dict) -> T.StructType:
    """``{"id": int, "tag": str | None, "labels": list[str]}`` -> StructType.

    ``T | None`` is nullable, a list becomes a never-null array, a dict is kept as JSON text.
    """
    import types as pytypes
    import typing

    def spark_type(annotation):
        origin, args = typing.get_origin(annotation), typing.get_args(annotation)
        if origin is list:
            return T.ArrayType(spark_type(args[0]) if args else T.StringType())
        return _PYTHON_TYPES.get(origin or annotation, T.StringType())

    out = []
    for name, annotation in fields.items():
        nullable = False
        if typing.get_origin(annotation) in (typing.Union, pytypes.UnionType):
            members = [a for a in typing.get_args(annotation) if a is not type(None)]
            nullable = len(members) < len(typing.get_args(annotation))
            annotation = members[0] if len(members) == 1 else str
        out.append(T.StructField(name, spark_type(annotation), nullable))
    return T.StructType(out)


def add_missing_fields(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Schema columns absent from ``df`` are added as typed NULLs."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Schema columns only, in schema order, cast; a NULL in a required column fails the job.

    The check is part of the projection, so it costs no pass of its own.
    """
    present = set(df.columns)
    absent = sorted(f.name for f in schema if not f.nullable and f.name not in present)
    if absent:
        raise DataValidationError(f"missing required columns: {', '.join(absent)}")
    out = []
    for field in schema:
        value = F.col(field.name) if field.name in present else F.lit(None)
        value = value.cast(field.dataType)
        if not field.nullable:
            message = F.lit(f"NULL in required column {field.name}")
            value = F.when(value.isNull(), F.raise_error(message).cast(field.dataType)).otherwise(value)
        out.append(value.alias(field.name))
    return df.select(*out)


def null_counts(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``(column_name, n_null)`` of the required columns of ``schema``, one pass over ``df``."""
    required = [f.name for f in schema if not f.nullable and f.name in df.columns]
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counted.unpivot([], required, "column_name", "n_null")
