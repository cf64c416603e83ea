"""Semantic column types: boolean, identifier, datetime, numerical, categorical."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..functions.columns import is_float, is_nested, is_numeric, is_time
from .cells import DATE_MARKS, cells

# The vocabulary and name cues of the type heuristics.
SEMANTIC_TYPES = ("numerical", "categorical", "datetime", "boolean", "identifier")
BOOLEAN_WORDS = ("true", "false", "t", "f", "yes", "no", "y", "n")
BOOLEAN_PREFIXES = ("is_", "has_", "can_", "should_", "was_", "flag_")
BOOLEAN_SUFFIXES = ("_flag", "_bool")
IDENTIFIER_NAME = r"(^|_)id$|^id(_|$)|uuid|guid|identifier|^pk$|_pk$"
UUID_VALUE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
UUID_SHARE = 0.8

SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("column", T.StringType(), False),
    T.StructField("physical_type", T.StringType(), False),
    T.StructField("semantic_type", T.StringType(), False),
])


@dataclass(frozen=True)
class ColumnKind:
    """What one column was found to be; ``ordinal`` is its place in the table."""
    ordinal: int
    column: str
    physical_type: str
    semantic_type: str
    day_first: bool = False


def boolean_name(name: str) -> bool:
    lowered = name.lower()
    return lowered.startswith(BOOLEAN_PREFIXES) or lowered.endswith(BOOLEAN_SUFFIXES)


def identifier_name(name: str) -> bool:
    return re.search(IDENTIFIER_NAME, name, re.IGNORECASE) is not None


def _evidence(values: DataFrame) -> DataFrame:
    """What the heuristics need to know of each column, combined map-side."""
    w, s = F.col("weight"), F.when(F.col("long_text").isNull(), F.col("s"))
    trimmed = F.trim(s)
    parsed = dates.parse_text(s)
    marker = F.xxhash64("l", "d", "s", "t")

    def weight_of(condition: Column) -> Column:
        return F.sum(F.when(condition, w).otherwise(0))

    return values.groupBy("ordinal").agg(
        F.sum(w).alias("present"),
        F.every(F.coalesce(F.lower(trimmed).isin(*BOOLEAN_WORDS) | (trimmed == ""), F.lit(False))).alias("words"),
        F.some(trimmed != "").alias("filled"),
        F.every(F.coalesce(F.col("l").isin(0, 1), F.col("d").isin(0.0, 1.0), s.isin("0", "1"),
                           F.lit(False))).alias("zero_one"),
        weight_of(trimmed.rlike(UUID_VALUE)).alias("uuids"),
        F.every(F.coalesce(F.col("long_text"), s.rlike(DATE_MARKS))).alias("marked"),
        weight_of(parsed.isNotNull()).alias("dates"),
        weight_of(dates.month_first(s).isNotNull()).alias("month_first"),
        weight_of(dates.day_first(s).isNotNull()).alias("day_first"),
        # by hash: a text minimum would force a sort of all cells
        (F.min(marker) != F.max(marker)).alias("varied"))


def _decide(name: str, dtype: T.DataType, seen, distinct: int | None,
            id_share: float, date_share: float) -> str:
    """First match wins."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    is_text = not (is_numeric(dtype) or is_time(dtype))
    if seen is not None:
        if is_text and seen.words and seen.filled:
            return "boolean"
        if boolean_name(name) and seen.zero_one:
            return "boolean"
        if is_text and seen.uuids / seen.present >= UUID_SHARE:
            return "identifier"
        if identifier_name(name):
            # repeated keys count as well, unless they are fractional numbers
            if distinct is not None:
                if distinct / seen.present >= id_share:
                    return "identifier"
            elif seen.varied or 1 / seen.present >= id_share:
                return "identifier"
    if is_time(dtype):
        return "datetime"
    if is_numeric(dtype):
        return "numerical"
    if seen is not None and seen.marked and seen.dates / seen.present >= date_share:
        return "datetime"
    return "categorical"


def kinds_from(df: DataFrame, values: DataFrame, id_share: float = 0.70,
               date_share: float = 0.90) -> list[ColumnKind]:
    """Classify the columns of ``df`` given its cells or value counts."""
    fields = df.schema.fields
    seen = {r.ordinal: r for r in _evidence(values).collect()}
    fractional = [i for i, f in enumerate(fields)
                  if is_float(f.dataType) and identifier_name(f.name)]
    distinct = {}
    if fractional:
        distinct = {r.ordinal: r.n for r in values.where(F.col("ordinal").isin(fractional))
                    .groupBy("ordinal").agg(F.count_distinct("d").alias("n")).collect()}
    kinds = []
    for i, f in enumerate(fields):
        found = seen.get(i)
        # nested values are judged as what they are, never by their JSON text
        kind = ("categorical" if is_nested(f.dataType) else
                _decide(f.name, f.dataType, found, distinct.get(i), id_share, date_share))
        kinds.append(ColumnKind(i, f.name, f.dataType.simpleString(), kind,
                                found is not None and found.day_first > found.month_first))
    return kinds


def column_kinds(df: DataFrame, id_share: float = 0.70, date_share: float = 0.90) -> list[ColumnKind]:
    """Classify every column in one pass over the table, without a shuffle of rows."""
    judged_by_value = [i for i, f in enumerate(df.schema.fields)
                       if isinstance(f.dataType, T.StringType)
                       or boolean_name(f.name) or identifier_name(f.name)]
    values = cells(df, judged_by_value).withColumn("weight", F.lit(1))
    return kinds_from(df, values, id_share, date_share)


def kinds_table(spark, kinds: list[ColumnKind]) -> DataFrame:
    return spark.createDataFrame(
        [(k.ordinal, k.column, k.physical_type, k.semantic_type) for k in kinds], SCHEMA)


def detect_schema(df: DataFrame, id_uniqueness_threshold: float = 0.70,
                  datetime_match_threshold: float = 0.90) -> DataFrame:
    """(ordinal, column, physical_type, semantic_type) in table order."""
    return kinds_table(df.sparkSession,
                       column_kinds(df, id_uniqueness_threshold, datetime_match_threshold))


def schema_summary(schema: DataFrame) -> DataFrame:
    """(semantic_type, columns) for all five types, zeros included."""
    spark = schema.sparkSession
    types = spark.createDataFrame([(t,) for t in SEMANTIC_TYPES], "semantic_type string")
    found = schema.groupBy("semantic_type").agg(F.count("*").alias("columns"))
    return (types.join(found, "semantic_type", "left")
            .select("semantic_type", F.coalesce("columns", F.lit(0).cast("long")).alias("columns")))


def columns_of_type(schema: DataFrame, semantic_type: str) -> DataFrame:
    return schema.where(F.col("semantic_type") == semantic_type)
