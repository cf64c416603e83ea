"""Small building blocks for column expressions and tiny result tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")
SMALL_INPUT_BYTES = 256 << 20


def col(name: str) -> Column:
    """Reference a column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def normalize(df: DataFrame) -> DataFrame:
    """Make NaN missing and turn nested values into JSON text.

    NaN would otherwise count as a value; infinities stay. Every operator that
    looks at missing values starts here, so it is idempotent and one projection.
    """
    out = []
    for field in df.schema.fields:
        c = col(field.name)
        if is_float(field.dataType):
            out.append(F.when(~F.isnan(c), c).alias(field.name))
        elif is_nested(field.dataType):
            out.append(F.to_json(c).alias(field.name))
        else:
            out.append(c)
    return df.select(*out)


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INFINITY)), c)


def percent_of(part: Column, whole: Column) -> Column:
    """Share in percent, two decimals, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part / whole * 100.0, 2)).otherwise(F.lit(0.0))


def as_text(c: Column) -> Column:
    return c.cast("string")


def _nullable(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in dtype])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_nullable(dtype.elementType), True)
    if isinstance(dtype, T.MapType):
        return T.MapType(_nullable(dtype.keyType), _nullable(dtype.valueType), True)
    return dtype


def pin(df: DataFrame) -> DataFrame:
    """Evaluate a result whose size is bounded by the column count, once.

    Profiles, findings and model tables have O(columns) rows and feed many later
    steps; holding them as a local relation keeps those steps from rescanning the
    table. Never used on anything that grows with the row count.
    """
    schema = _nullable(df.schema)
    return df.sparkSession.createDataFrame(df.to(schema).toArrow(), schema)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; no job runs for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input to every core; a larger one stays as its reader splits it.

    One row group is one split, so a small file would keep one core busy. Spark sorts the rows before it deals
    them in turns, so a retried task deals them alike, and equal rows are spread like any others. The size is
    the optimizer's estimate: no job runs for it, and only the partitioning depends on it.
    """
    if estimated_bytes(df) > SMALL_INPUT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


@contextmanager
def dealt(df: DataFrame, deal: bool = True) -> Iterator[DataFrame]:
    """``spread`` rows for several scans: a small input is dealt once and kept meanwhile, a larger one is read each time.

    Without ``deal`` the rows are as they come: the caller has dealt them.
    """
    small = deal and estimated_bytes(df) <= SMALL_INPUT_BYTES
    rows = spread(df).persist(StorageLevel.MEMORY_AND_DISK) if small else df
    try:
        yield rows
    finally:
        if small:
            rows.unpersist()
