"""Registration of queries, and helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetframe.functions.columns import is_float
from facetframe.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` and its SQL counterpart."""
    def register(run: Callable[[SparkSession, str], DataFrame]):
        def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return run(spark, sf_dir)

        QUERIES[name] = ready
        if sql is not None:
            SQL[name] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every fractional column, so that summation order does not show."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if is_float(f.dataType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
