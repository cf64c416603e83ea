"""Pearson correlation of all pairs of numerical columns, pairwise complete."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_numeric, normalize
from ..functions.tails import p_of_correlation

WIDE_AGG_PAIRS = 45          # beyond, one matrix per task instead of one aggregate per pair


def _numbers(df: DataFrame, columns: list[str] | None, profile: DataFrame | None) -> tuple[DataFrame, list[str]]:
    if columns is None and profile is not None:
        columns = [r.column for r in profile.where(
            "semantic_type = 'numerical' AND unique_count > 1 AND missing_percentage < 100").collect()]
    if columns is None:
        columns = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    columns = sorted(columns)
    return normalize(df.select(*[col(c).cast("double").alias(c) for c in columns])), columns


def _by_aggregates(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = []
    for x, y in combinations(columns, 2):
        a, b = col(x), col(y)
        pairs.append(F.struct(
            F.lit(x).alias("column_x"), F.lit(y).alias("column_y"), F.regr_count(b, a).alias("n"),
            F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"), F.regr_sxy(b, a).alias("sxy")))
    return df.agg(F.array(*pairs).alias("pairs")).select(F.inline("pairs"))


def _by_matrices(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of products as p x p matrices, one row of partial sums per task.

    Missing and infinite values are masked before they are multiplied; pairs of present values with an
    infinity are counted, and a pair of columns that has one is undefined, as it is by aggregates.
    """
    means = df.agg(*[F.coalesce(F.avg(F.when(F.abs(col(c)) != math.inf, col(c))), F.lit(0.0)).alias(str(i))
                     for i, c in enumerate(columns)]).first()
    centre = np.array(list(means), dtype=float)
    upper = np.triu_indices(len(columns), 1)

    def partial_sums(batches):
        total = None
        for batch in batches:
            values = batch.to_numpy(dtype=float) - centre
            finite = np.isfinite(values)
            odd = (~finite & ~np.isnan(values)).astype(float)
            values = np.where(finite, values, 0.0)
            known = finite.astype(float)
            squares = values * values
            parts = np.stack([m[upper] for m in (
                known.T @ known, values.T @ known, known.T @ values,
                squares.T @ known, known.T @ squares, values.T @ values,
                odd.T @ (known + odd) + known.T @ odd)])
            total = parts if total is None else total + parts
        if total is not None:
            yield pd.DataFrame({"sums": [row for row in total.T], "pair": np.arange(total.shape[1])})

    sums = (df.mapInPandas(partial_sums, "sums array<double>, pair int").groupBy("pair")
            .agg(*[F.sum(F.col("sums")[i]).alias(n)
                   for i, n in enumerate(("n", "x", "y", "xx", "yy", "xy", "odd"))]))
    names = df.sparkSession.createDataFrame(
        pd.DataFrame([(i, columns[a], columns[b]) for i, (a, b) in enumerate(zip(*upper))],
                     columns=["pair", "column_x", "column_y"]))
    n = F.nullif(F.col("n"), F.lit(0.0))
    defined = F.col("odd") == 0
    return names.join(sums, "pair").select(
        "column_x", "column_y", (F.col("n") + F.col("odd")).cast("long").alias("n"),
        F.when(defined, F.col("xx") - F.col("x") * F.col("x") / n).alias("sxx"),
        F.when(defined, F.col("yy") - F.col("y") * F.col("y") / n).alias("syy"),
        F.when(defined, F.col("xy") - F.col("x") * F.col("y") / n).alias("sxy"))


def pearson_sums(df: DataFrame, columns: list[str], wide_agg_pairs: int = WIDE_AGG_PAIRS) -> DataFrame:
    """(column_x, column_y, n, sxx, syy, sxy) over the rows where both are present."""
    pairs = len(columns) * (len(columns) - 1) // 2
    return _by_aggregates(df, columns) if pairs <= wide_agg_pairs else _by_matrices(df, columns)


def correlation_strength(abs_r: Column) -> Column:
    return (F.when(abs_r >= 0.7, "very strong").when(abs_r >= 0.5, "strong")
            .when(abs_r >= 0.3, "moderate").otherwise("weak"))


def correlation_importance(abs_r: Column, p: Column, significance: float = 0.05) -> Column:
    return (F.when(p > significance, "LOW").when(abs_r >= 0.7, "HIGH").when(abs_r >= 0.5, "MEDIUM")
            .when(abs_r >= 0.3, "LOW").otherwise("INFO"))


def coefficients(sums: DataFrame) -> DataFrame:
    """Adds ``r``; pairs without three rows, without variation or with an infinity have none."""
    scale = F.sqrt(F.col("sxx")) * F.sqrt(F.col("syy"))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("sxy"), scale)))
    # NaN is above infinity here, so these tests leave it out; least() and greatest() would turn it into 1
    finite = (F.col("sxx") < math.inf) & (F.col("syy") < math.inf) & (F.abs("sxy") < math.inf)
    usable = (F.col("n") >= 3) & (F.col("sxx") > 0) & (F.col("syy") > 0) & finite
    return sums.where(usable).withColumn("r", r)


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, profile: DataFrame | None = None,
                      min_correlation: float = 0.3, max_pairs: int = 50,
                      significance_threshold: float = 0.05,
                      wide_agg_pairs: int = WIDE_AGG_PAIRS) -> DataFrame:
    """The strongest pairs by |r|: (column_x, column_y, coefficient, p_value, sample_size,
    strength, direction, importance)."""
    numbers, columns = _numbers(df, columns, profile)
    if len(columns) < 2:
        numbers, columns = _numbers(df.select(F.lit(None).cast("double").alias("x"),
                                              F.lit(None).cast("double").alias("y")), ["x", "y"], None)
    return correlation_table(pearson_sums(numbers, columns, wide_agg_pairs), min_correlation,
                             max_pairs, significance_threshold)


def correlation_table(sums: DataFrame, min_correlation: float = 0.3, max_pairs: int = 50,
                      significance_threshold: float = 0.05) -> DataFrame:
    """Coefficients, p values and labels of pairwise sums, strongest first."""
    size = F.abs("r")
    strongest = (coefficients(sums).where(size >= min_correlation)
                 .orderBy(F.desc(size), "column_x", "column_y").limit(max_pairs)
                 .withColumn("p", p_of_correlation(F.col("r"), F.col("n"))))
    return strongest.select(
        "column_x", "column_y", F.round("r", 4).alias("coefficient"), F.round("p", 6).alias("p_value"),
        F.col("n").alias("sample_size"), correlation_strength(size).alias("strength"),
        F.when(F.col("r") >= 0, "positive").otherwise("negative").alias("direction"),
        correlation_importance(size, F.col("p"), significance_threshold).alias("importance"))
