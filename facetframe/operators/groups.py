"""Category shares, and numerical columns compared across categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import INFINITY, col, is_numeric, normalize, pin
from ..functions.quantiles import quantiles

MIN_ROWS = 5


def _shares(profile: DataFrame) -> DataFrame:
    filled = F.col("row_count") - F.col("missing_count")
    return (profile.where((F.col("semantic_type") == "categorical") & (filled >= MIN_ROWS))
            .select("column", F.col("categorical.most_frequent").alias("dominant_category"),
                    F.col("categorical.most_frequent_frequency").alias("dominant_count"),
                    filled.alias("total_non_null"), F.col("unique_count").alias("unique_categories"))
            .withColumn("share", F.col("dominant_count") / F.col("total_non_null") * 100.0))


def category_concentration(profile: DataFrame, threshold_pct: float = 50.0) -> DataFrame:
    """Categorical columns whose most frequent value reaches the threshold."""
    return (_shares(profile).where(F.col("share") >= threshold_pct)
            .withColumn("importance", F.when(F.col("share") >= 80.0, "HIGH").otherwise("MEDIUM"))
            .withColumn("share", F.round("share", 2)).withColumnRenamed("share", "dominant_share_pct"))


def category_balance(profile: DataFrame, threshold_pct: float = 50.0) -> DataFrame:
    """Categorical columns with three or more values and none above 35 percent."""
    return (_shares(profile)
            .where((F.col("share") < threshold_pct) & (F.col("unique_categories") >= 3)
                   & (F.col("share") <= 35.0))
            .withColumn("importance", F.lit("INFO"))
            .withColumn("share", F.round("share", 2)).withColumnRenamed("share", "dominant_share_pct"))


def group_columns(profile: DataFrame, max_categorical: int = 5, max_numerical: int = 5) -> tuple[list[str], list[str]]:
    """The first few categorical columns with 2 to 20 values and the first few varying numbers."""
    rows = profile.orderBy("ordinal").select("column", "semantic_type", "unique_count",
                                             "missing_percentage").collect()
    words = [r.column for r in rows if r.semantic_type == "categorical" and 2 <= r.unique_count <= 20]
    numbers = [r.column for r in rows if r.semantic_type == "numerical" and r.unique_count > 1
               and r.missing_percentage < 100.0]
    return words[:max_categorical], numbers[:max_numerical]


def _pair_rows(df: DataFrame, categorical: list[str], numerical: list[str]) -> DataFrame:
    """(categorical_column, numerical_column, group_name, value), pairs with a gap dropped."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("categorical_column"), F.lit(n).alias("numerical_column"),
                 col(c).cast("string").alias("group_name"), col(n).cast("double").alias("value"))
        for c in categorical for n in numerical])
    return (df.select(F.inline(pairs))
            .where(F.col("group_name").isNotNull() & F.col("value").isNotNull()))


def group_summary(df: DataFrame, categorical: list[str] | None = None, numerical: list[str] | None = None,
                  profile: DataFrame | None = None, max_groups: int = 8, digits: int | None = 2) -> DataFrame:
    """Count, mean, median, std, min and max of each number in the largest groups.

    (categorical_column, numerical_column, group_name, count, mean, median, std, min, max).
    ``categorical`` columns are expected to have few values, as the profile selects them.
    All pairs share their passes, and every pass combines map-side: what is shuffled is
    one row per group, or one per group and histogram bucket while medians are searched.
    """
    if profile is not None and (categorical is None or numerical is None):
        words, numbers = group_columns(profile)
        categorical = words if categorical is None else categorical
        numerical = numbers if numerical is None else numerical
    df = normalize(df)
    categorical = [c for c in categorical]
    numerical = [n for n in numerical if is_numeric(df.schema[n].dataType)]
    pair = ["categorical_column", "numerical_column"]
    keys = pair + ["group_name"]
    if not categorical or not numerical:
        return df.sparkSession.createDataFrame(
            [], "categorical_column string, numerical_column string, group_name string, count long, "
                "mean double, median double, std double, min double, max double")
    rows = _pair_rows(df, categorical, numerical)
    finite = F.when(F.abs("value") != F.lit(INFINITY), F.col("value"))
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.min(finite).alias("low"), F.max(finite).alias("high"))
    size = W.partitionBy(*pair)
    largest = size.orderBy(F.desc("count"), F.asc("group_name"))
    top = pin(stats.withColumn("rows", F.sum("count").over(size))
              .withColumn("place", F.row_number().over(largest))
              .where((F.col("rows") >= MIN_ROWS) & (F.col("place") <= max_groups)))
    kept = rows.join(F.broadcast(top.select(*keys)), keys, "left_semi")   # columns x max_groups rows
    weighted = kept.select(*keys, "value", F.lit(1).cast("long").alias("weight"))
    totals = top.select(*keys, F.col("count").alias("total"), F.col("count").alias("inside"), "low", "high")
    medians = (quantiles(weighted, keys, [0.5], totals=totals)
               .withColumnRenamed("quantile", "median").drop("p"))
    several = F.count("*").over(W.partitionBy(*pair)) >= 2
    out = top.join(medians, keys).withColumn("several", several).where("several")
    shown = ["mean", "median", "std", "min", "max"]
    return out.select(*keys, "count", *[
        (F.round(c, digits) if digits is not None else F.col(c)).alias(c) for c in shown])


def group_variation(summary: DataFrame) -> DataFrame:
    """How far group means lie apart: (categorical_column, numerical_column, groups,
    variation_ratio, top_group, top_mean, bottom_group, bottom_mean, importance).

    ``summary`` is ``group_summary(..., digits=None)``. A ratio is only defined when the
    means are positive or change sign; a finding starts at 1.3.
    """
    low, high = F.col("bottom_mean"), F.col("top_mean")
    ratio = (F.when(low > 0, F.round(high / low, 2))
             .when((low < 0) & (high > 0),
                   F.round((high - low) / F.greatest(F.abs(low), F.abs(high)), 2)))
    return (summary.groupBy("categorical_column", "numerical_column").agg(
        F.count("*").alias("groups"),
        F.max("mean").alias("top_mean"), F.min("mean").alias("bottom_mean"),
        # the larger group speaks for equal means, then the smaller name
        F.min_by("group_name", F.struct(-F.col("mean"), -F.col("count"), "group_name")).alias("top_group"),
        F.min_by("group_name", F.struct(F.col("mean"), -F.col("count"), "group_name")).alias("bottom_group"))
        .select("categorical_column", "numerical_column", "groups", ratio.alias("variation_ratio"),
                "top_group", F.round("top_mean", 2).alias("top_mean"), "bottom_group",
                F.round("bottom_mean", 2).alias("bottom_mean"))
        .withColumn("importance", F.when(F.col("variation_ratio") >= 2.0, "HIGH")
                    .when(F.col("variation_ratio") >= 1.3, "MEDIUM")))
