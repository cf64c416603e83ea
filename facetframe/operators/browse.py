"""Searching, sorting and paging a table; filtering result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import INFINITY, as_text, col, is_float, is_nested, is_time, normalize
from ..session import shared_folder
from .profile import iso_text

MAX_PAGE_SIZE = 100


def search(df: DataFrame, needle: str) -> DataFrame:
    """Rows where the text of any column contains the needle, ignoring case."""
    wanted = F.lit(needle.strip().lower())

    def matches(field) -> Column:
        c = col(field.name)
        text = F.to_json(c) if is_nested(field.dataType) else as_text(c)
        return F.coalesce(F.contains(F.lower(text), wanted), F.lit(False))

    return df.where(reduce(lambda a, b: a | b, [matches(f) for f in df.schema.fields]))


def _order(df: DataFrame, column: str, ascending: bool) -> list[Column]:
    key = normalize_key(df, column)
    orderable = {f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()}
    return [key.asc_nulls_last() if ascending else key.desc_nulls_last(),
            *[col(c).asc_nulls_last() for c in df.columns if c != column and c in orderable]]


def sort_by(df: DataFrame, column: str | None, ascending: bool = True) -> DataFrame:
    """Sort by one column, missing values last either way, ties by the other columns.

    An unknown column leaves the table as it is.
    """
    if column is None or column not in df.columns:
        return df
    return df.orderBy(*_order(df, column, ascending))


class OrderIndex:
    """A sorted copy of a table in the shared folder that knows the position of every row.

    The rows are range-partitioned and sorted once; each part is a folder of its own and its rows are counted. A position
    is the rows of the parts before plus the place in the part, so no task numbers the whole table, and a page reads the
    one or two parts it lies in. Only the counts, a row a part, are collected.
    """

    def __init__(self, df: DataFrame, column: str, ascending: bool = True):
        self.columns, spark = df.columns, df.sparkSession
        ranged = df.repartitionByRange(*_order(df, column, ascending)).sortWithinPartitions(*_order(df, column, ascending))
        # the lower 33 bits of the built-in number count the rows of a part
        placed = ranged.withColumns({"__part": F.spark_partition_id(),
                                     "__in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        path = shared_folder(spark, "order-index")
        placed.write.partitionBy("__part").parquet(path)
        self.parts: list[tuple[int, int, int]] = []             # part, first position, rows
        schema = T.StructType([f for f in placed.schema.fields if f.name != "__part"]).add("__part", T.IntegerType())
        self.rows, first = spark.read.schema(schema).parquet(path), 0
        for r in self.rows.groupBy("__part").count().orderBy("__part").collect():
            self.parts.append((r["__part"], first, r["count"]))
            first += r["count"]
        self.total = first

    def numbered(self, name: str = "position") -> DataFrame:
        """All rows with their position, from 0."""
        return self._positions(self.rows, self.parts, name).drop("__part", "__in")

    def _positions(self, rows: DataFrame, parts: list[tuple[int, int, int]], name: str) -> DataFrame:
        spark = rows.sparkSession
        firsts = spark.createDataFrame([(p, f) for p, f, _ in parts], "__of int, __first long")
        return rows.join(F.broadcast(firsts), F.col("__part") == F.col("__of")).withColumn(      # a row a part
            name, F.col("__first") + F.col("__in")).drop("__of", "__first")

    def page(self, number: int = 1, size: int = 50) -> DataFrame:
        """The rows of one 1-based page, in order."""
        if number < 1 or size < 1:
            raise ValueError("page numbers and sizes start at 1")
        low = (number - 1) * size
        met = [p for p in self.parts if p[1] < low + size and p[1] + p[2] > low]
        rows = self.rows.where(F.col("__part").isin([p[0] for p in met]) if met else F.lit(False))
        placed = self._positions(rows, met, "__position").where(F.col("__position").between(low, low + size - 1))
        return placed.orderBy("__position").select(*[col(c) for c in self.columns])


def normalize_key(df: DataFrame, column: str) -> Column:
    c = col(column)
    return F.when(~F.isnan(c), c) if is_float(df.schema[column].dataType) else c


def page(df: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """The rows of one 1-based page of a sorted table."""
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page numbers start at 1 and sizes run from 1 to {MAX_PAGE_SIZE}")
    return df.offset((number - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int = 50) -> DataFrame:
    """(total_rows, total_pages); an empty table still has one page."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_rows") / size)).cast("long")
    return df.agg(F.count("*").alias("total_rows")).withColumn("total_pages", pages)


def clean_cells(df: DataFrame) -> DataFrame:
    """Non-finite numbers become null, moments become ISO text."""
    out = []
    for field in normalize(df).schema.fields:
        c = col(field.name)
        if is_float(field.dataType):
            c = F.when(F.abs(c) != F.lit(INFINITY), c)
        elif is_time(field.dataType):
            c = iso_text(c.cast("timestamp_ntz"))
        out.append(c.alias(field.name))
    return normalize(df).select(*out)


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if not columns:
        raise ValueError("at least one column must stay visible")
    return df.select(*[col(c) for c in columns])


def browse(df: DataFrame, number: int = 1, size: int = 50, sort: str | None = None,
           ascending: bool = True, needle: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, totals): search, then sort, then page."""
    found = search(df, needle) if needle and needle.strip() else df
    return clean_cells(page(sort_by(found, sort, ascending), number, size)), page_totals(found, size)


# Equality filters over result tables.

def issues_by_severity(issues: DataFrame, severity: str) -> DataFrame:
    return issues.where(F.col("severity") == severity.upper())


def issues_by_column(issues: DataFrame, column: str) -> DataFrame:
    return issues.where(F.col("column") == column)


def findings_by_type(findings: DataFrame, finding_type: str) -> DataFrame:
    return findings.where(F.col("finding_type") == finding_type)


def findings_by_importance(findings: DataFrame, importance: str) -> DataFrame:
    return findings.where(F.col("importance") == importance.upper())


def findings_by_column(findings: DataFrame, column: str) -> DataFrame:
    return findings.where(F.array_contains("affected_columns", column))


def insights_by_importance(insights: DataFrame, importance: str) -> DataFrame:
    return insights.where(F.upper("importance") == importance.upper())


def insights_by_category(insights: DataFrame, category: str) -> DataFrame:
    return insights.where(F.lower("category") == category.lower())
