"""Writing tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import INFINITY, col


def export_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write a whole (filtered, sorted) view as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def _finite(c: Column, dtype: T.DataType) -> Column:
    """Null for non-finite numbers, also inside structs, arrays and maps."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INFINITY)), c)
    if isinstance(dtype, T.StructType):
        parts = [_finite(c[f.name], f.dataType).alias(f.name) for f in dtype]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: _finite(v, dtype.valueType))
    return c


def json_ready(df: DataFrame) -> DataFrame:
    """The table with NaN and infinities turned to null everywhere."""
    return df.select(*[_finite(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def report_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, null fields kept."""
    ready = json_ready(df)
    return ready.select(F.to_json(F.struct(*[col(c) for c in ready.columns]),
                                  {"ignoreNullFields": "false"}).alias("json"))


def export_report_json(tables: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Write each result table as JSON lines under its own folder."""
    for name, df in tables.items():
        json_ready(df).write.mode(mode).option("ignoreNullFields", False).json(f"{path}/{name}")
