"""Shape of numerical distributions, read from the column profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Border of the most skewed class.
EXTREME_SKEW = 2.0


def skew_class(skew: Column, strong: float = 1.0, moderate: float = 0.5) -> Column:
    side = F.when(skew > 0, "right-skewed").otherwise("left-skewed")
    size = F.abs(skew)
    return (F.when(size >= EXTREME_SKEW, F.concat(F.lit("extremely "), side))
            .when(size >= strong, F.concat(F.lit("strongly "), side))
            .when(size >= moderate, F.concat(F.lit("moderately "), side))
            .otherwise("approximately symmetric"))


def skew_importance(skew: Column, strong: float = 1.0, moderate: float = 0.5) -> Column:
    size = F.abs(skew)
    return (F.when(size >= EXTREME_SKEW, "HIGH").when(size >= strong, "MEDIUM")
            .when(size >= moderate, "LOW").otherwise("INFO"))


def distribution_shape(profile: DataFrame, strong_skew_threshold: float = 1.0,
                       moderate_skew_threshold: float = 0.5) -> DataFrame:
    """(column, mean, median, std, min, max, skewness, kurtosis, skewness_classification, importance)."""
    n = F.col("numerical")
    skew = n["skewness"]
    return (profile.where((F.col("semantic_type") == "numerical") & (F.col("unique_count") > 1)
                          & (n["count"] >= 3) & skew.isNotNull() & (n["std"] != 0))
            .select("column", n["mean"].alias("mean"), n["median"].alias("median"), n["std"].alias("std"),
                    n["min"].alias("min"), n["max"].alias("max"),
                    F.round(skew, 4).alias("skewness"), F.round(n["kurtosis"], 4).alias("kurtosis"),
                    skew_class(skew, strong_skew_threshold, moderate_skew_threshold)
                    .alias("skewness_classification"),
                    skew_importance(skew, strong_skew_threshold, moderate_skew_threshold)
                    .alias("importance")))
