"""One ranked table of findings from the statistical operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pin
from .correlation import correlation_pairs
from .distribution import distribution_shape
from .groups import category_balance, category_concentration, group_summary, group_variation
from .profile import column_profile
from .trend import trends

# Finding types, and importance from first to last.
FINDING_TYPES = ("CORRELATION", "DISTRIBUTION", "CATEGORY", "GROUP_RELATIONSHIP", "TEMPORAL_TREND")
IMPORTANCE = ("HIGH", "MEDIUM", "LOW", "INFO")


def importance_rank(importance: Column) -> Column:
    rank = F.when(importance == IMPORTANCE[0], 1)
    for i, name in enumerate(IMPORTANCE[1:], 2):
        rank = rank.when(importance == name, i)
    return rank.otherwise(99)


def _values(**entries: str | Column) -> Column:
    pairs = [x for k, v in entries.items()
             for x in (F.lit(k), (v if isinstance(v, Column) else F.col(v)).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _finding(rows: DataFrame, finding_id: Column, finding_type: str, title: Column, description: Column,
             columns: list[str], values: Column, measure: str | Column, p_value: Column | None = None) -> DataFrame:
    return rows.select(
        finding_id.alias("finding_id"), F.lit(finding_type).alias("finding_type"), title.alias("title"),
        description.alias("description"), "importance",
        importance_rank(F.col("importance")).alias("importance_rank"),
        F.array(*[F.col(c) for c in columns]).alias("affected_columns"), values.alias("measured_values"),
        (measure if isinstance(measure, Column) else F.lit(measure)).alias("statistical_measure"),
        (F.lit(None).cast("double") if p_value is None else p_value).alias("p_value"))


def correlation_findings(pairs: DataFrame) -> DataFrame:
    return _finding(
        pairs, F.concat_ws("_", F.lit("corr"), "column_x", "column_y"), "CORRELATION",
        F.format_string("'%s' and '%s' move together (%s, %s)", "column_x", "column_y", "strength", "direction"),
        F.format_string("Pearson r = %.2f over %d rows", "coefficient", "sample_size"),
        ["column_x", "column_y"],
        _values(pearson_r="coefficient", abs_pearson_r=F.abs("coefficient"), p_value="p_value",
                sample_size="sample_size", strength="strength", direction="direction"),
        "pearson_correlation", F.col("p_value"))


def distribution_findings(shapes: DataFrame) -> DataFrame:
    return _finding(
        shapes, F.concat_ws("_", F.lit("dist"), "column"), "DISTRIBUTION",
        F.format_string("'%s' is %s", "column", "skewness_classification"),
        F.format_string("skewness %.2f, mean %.2f, median %.2f", "skewness", "mean", "median"),
        ["column"],
        _values(skewness="skewness", kurtosis="kurtosis", mean="mean", median="median", std="std",
                min="min", max="max", classification="skewness_classification"), "skewness")


def category_findings(concentrated: DataFrame, balanced: DataFrame) -> DataFrame:
    def rows(found: DataFrame, prefix: str, title: str, measure: str) -> DataFrame:
        return _finding(
            found, F.concat_ws("_", F.lit(prefix), "column"), "CATEGORY",
            F.format_string(title, "column"),
            F.format_string("'%s' is the most frequent of %d values with %.1f%% of the rows",
                            "dominant_category", "unique_categories", "dominant_share_pct"),
            ["column"],
            _values(dominant_category="dominant_category", dominant_share_pct="dominant_share_pct",
                    dominant_count="dominant_count", total_non_null="total_non_null",
                    unique_categories="unique_categories"), measure)

    return (rows(concentrated, "cat_concentration", "One value prevails in '%s'", "category_concentration")
            .unionByName(rows(balanced, "cat_balanced", "The values of '%s' are balanced", "category_balance")))


def group_findings(variation: DataFrame) -> DataFrame:
    return _finding(
        variation.where(F.col("importance").isNotNull()),
        F.concat_ws("_", F.lit("rel"), "categorical_column", "numerical_column"), "GROUP_RELATIONSHIP",
        F.format_string("'%s' differs between the groups of '%s'", "numerical_column", "categorical_column"),
        F.format_string("mean %.2f in '%s' against %.2f in '%s', a ratio of %s", "top_mean", "top_group",
                        "bottom_mean", "bottom_group", F.col("variation_ratio").cast("string")),
        ["categorical_column", "numerical_column"],
        _values(variation_ratio="variation_ratio", top_group="top_group", top_mean="top_mean",
                bottom_group="bottom_group", bottom_mean="bottom_mean"), "group_mean_variation")


def trend_findings(fits: DataFrame) -> DataFrame:
    return _finding(
        fits.where(F.col("direction") != "stable"),
        F.concat_ws("_", F.lit("trend"), "datetime_column", "numerical_column"), "TEMPORAL_TREND",
        F.format_string("'%s' is %s over '%s'", "numerical_column", "direction", "datetime_column"),
        F.format_string("%d %s periods, slope %.2f, R2 %.2f", "periods_count", "period_frequency", "slope",
                        "r_squared"),
        ["datetime_column", "numerical_column"],
        _values(direction="direction", slope="slope", r_squared="r_squared", p_value="p_value",
                periods_count="periods_count", frequency="period_frequency",
                start_date="start_date", end_date="end_date"),
        "linear_trend", F.col("p_value"))


def merge_findings(parts: list[DataFrame]) -> DataFrame:
    """Union, one row per id, most important first, then by id."""
    together = reduce(lambda a, b: a.unionByName(b), parts)
    return together.dropDuplicates(["finding_id"]).orderBy("importance_rank", "finding_id")


def analyze_statistics(df: DataFrame, profile: DataFrame | None = None, min_correlation: float = 0.3,
                       max_correlation_pairs: int = 50, strong_skew_threshold: float = 1.0,
                       concentration_threshold_pct: float = 50.0,
                       trend_r2_threshold: float = 0.25) -> dict[str, DataFrame]:
    """The tables of every stage and the merged ``findings``; all have few rows."""
    profile = column_profile(df) if profile is None else profile
    pairs = pin(correlation_pairs(df, profile=profile, min_correlation=min_correlation,
                                  max_pairs=max_correlation_pairs))
    shapes = distribution_shape(profile, strong_skew_threshold)
    summary = pin(group_summary(df, profile=profile, digits=None))
    variation = group_variation(summary)
    fits = pin(trends(df, profile, r2_threshold=trend_r2_threshold))
    concentrated = category_concentration(profile, concentration_threshold_pct)
    balanced = category_balance(profile, concentration_threshold_pct)
    findings = pin(merge_findings([
        correlation_findings(pairs), distribution_findings(shapes),
        category_findings(concentrated, balanced), group_findings(variation), trend_findings(fits)]))
    return {"correlations": pairs, "distributions": shapes, "relationships": variation,
            "group_summaries": summary, "trends": fits, "findings": findings}


def findings(df: DataFrame, profile: DataFrame | None = None, **thresholds) -> DataFrame:
    return analyze_statistics(df, profile, **thresholds)["findings"]


def finding_counts(found: DataFrame) -> DataFrame:
    """(finding_type, findings) for all five types, zeros included."""
    types = found.sparkSession.createDataFrame([(t,) for t in FINDING_TYPES], "finding_type string")
    counts = found.groupBy("finding_type").agg(F.count("*").alias("findings"))
    return (types.join(counts, "finding_type", "left")
            .select("finding_type", F.coalesce("findings", F.lit(0).cast("long")).alias("findings")))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows): how many results each stage calculated."""
    parts = [stages[s].agg(F.lit(s).alias("stage"), F.count("*").alias("rows"))
             for s in ("correlations", "distributions", "relationships", "trends")]
    return reduce(lambda a, b: a.unionByName(b), parts)
