"""Quality rules, scores and grades.

A rule is a function ``(profile, table) -> issues`` over the column profile and the
one-row table profile; no rule reads the data. Callers may pass their own list.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pin
from .profile import column_profile, dataset_profile

Rule = Callable[[DataFrame, DataFrame], DataFrame]

# Severities in order of weight, and grade borders.
SEVERITIES = ("CRITICAL", "ERROR", "WARNING", "INFO")
GRADES = ((90.0, "Excellent"), (75.0, "Good"), (60.0, "Fair"), (40.0, "Poor"))
LOWEST_GRADE = "Critical"

ISSUE_COLUMNS = ("rule_id", "severity", "title", "description", "column", "measured_value",
                 "threshold", "impact", "metadata")


def _share(c: Column) -> Column:
    return F.format_string("%.1f%%", c)


def _notes(**entries: Column) -> Column:
    pairs = [x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs)


def _issue(rows: DataFrame, rule_id, severity, title: str, description: Column, column: Column,
           measured: Column, threshold: str | Column, impact: str, metadata: Column) -> DataFrame:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select(
        as_column(rule_id).alias("rule_id"), as_column(severity).alias("severity"),
        F.lit(title).alias("title") if isinstance(title, str) else title.alias("title"),
        description.alias("description"), column.cast("string").alias("column"),
        measured.cast("string").alias("measured_value"), as_column(threshold).alias("threshold"),
        as_column(impact).alias("impact"), metadata.alias("metadata"))


def _no_column() -> Column:
    return F.lit(None).cast("string")


def missingness_issues(profile: DataFrame, table: DataFrame, moderate_pct: float = 5.0,
                       high_pct: float = 20.0, extreme_pct: float = 50.0,
                       dataset_high_pct: float = 20.0) -> DataFrame:
    """The highest tier each column reaches, and one row for a sparse table."""
    pct = F.col("missing_percentage")

    def tier(none, extreme, high, moderate):
        return (F.when(pct >= 100.0, none).when(pct > extreme_pct, extreme)
                .when(pct > high_pct, high).when(pct > moderate_pct, moderate))

    columns = _issue(
        profile.where((pct > moderate_pct) | (pct >= 100.0)),
        tier("ALL_NULL", "EXTREME_MISSINGNESS", "HIGH_MISSINGNESS", "MODERATE_MISSINGNESS"),
        tier("CRITICAL", "ERROR", "WARNING", "INFO"),
        tier("Column without values", "Most values missing", "Many values missing",
             "Some values missing"),
        F.format_string("%s of the values of '%s' are missing", _share(pct), F.col("column")),
        F.col("column"), _share(pct),
        tier("100.0%", f">{extreme_pct}%", f">{high_pct}%", f">{moderate_pct}%"),
        tier("The column carries no information.",
             "Fewer than half of the rows can be used; consider dropping the column.",
             "Results based on the remaining rows may be biased.",
             "The gaps need the usual treatment."),
        _notes(missing_count=F.col("missing_count"), missing_percentage=pct))
    whole = _issue(
        table.where(pct > dataset_high_pct), "DATASET_HIGH_MISSINGNESS", "WARNING",
        "Sparse table", F.format_string("%s of all cells are missing", _share(pct)), _no_column(),
        _share(pct), f">{dataset_high_pct}%", "Analyses across several columns lose many rows.",
        _notes(missing_cells=F.col("missing_cells"), missing_percentage=pct))
    return columns.unionByName(whole)


def duplicate_row_issues(profile: DataFrame, table: DataFrame, warning_pct: float = 5.0,
                         error_pct: float = 20.0, critical_pct: float = 50.0) -> DataFrame:
    pct = F.col("duplicate_percentage")
    severity = (F.when(pct > critical_pct, "CRITICAL").when(pct > error_pct, "ERROR")
                .when(pct > warning_pct, "WARNING").otherwise("INFO"))
    return _issue(
        table.where(F.col("duplicate_rows") > 0), "DUPLICATE_ROWS", severity, "Repeated rows",
        F.format_string("%d rows (%s) repeat an earlier row", F.col("duplicate_rows"), _share(pct)),
        _no_column(), _share(pct), ">0%", "Repeated rows inflate counts and weights.",
        _notes(duplicate_rows=F.col("duplicate_rows"), duplicate_percentage=pct))


def constant_column_issues(profile: DataFrame, table: DataFrame) -> DataFrame:
    flag = F.when(F.col("boolean.true_count") > 0, "True").when(F.col("boolean").isNotNull(), "False")
    value = F.coalesce(F.col("categorical.most_frequent"), F.col("numerical.min").cast("string"),
                       flag, F.lit("constant"))
    constant = profile.where((F.col("row_count") > 1) & (F.col("missing_percentage") < 100.0)
                             & (F.col("unique_count") == 1))
    return _issue(constant, "CONSTANT_COLUMN", "WARNING", "Constant column",
                  F.format_string("'%s' only holds the value '%s'", F.col("column"), value),
                  F.col("column"), F.lit("1"), ">1 unique values",
                  "A column that never varies cannot explain anything.",
                  _notes(dominant_value=value, unique_count=F.lit(1)))


def low_variance_issues(profile: DataFrame, table: DataFrame,
                        dominance_threshold_pct: float = 95.0) -> DataFrame:
    """Categorical and boolean columns that one value dominates."""
    true, false = F.col("boolean.true_count"), F.col("boolean.false_count")
    frequency = F.coalesce(F.col("categorical.most_frequent_frequency"), F.greatest(true, false))
    value = F.coalesce(F.col("categorical.most_frequent"),
                       F.when(true >= false, "True").when(true < false, "False"))
    filled = F.col("row_count") - F.col("missing_count")
    found = (profile.where((F.col("unique_count") > 1) & (F.col("missing_percentage") < 100.0)
                           & (filled > 1))
             .withColumn("dominant_value", value).withColumn("dominant_frequency", frequency)
             .withColumn("dominance", F.round(frequency / filled * 100, 2))
             .where(F.col("dominance") >= dominance_threshold_pct))
    return _issue(found, "LOW_VARIANCE", "WARNING", "One value dominates",
                  F.format_string("%s of '%s' is the value '%s'", _share(F.col("dominance")),
                                  F.col("column"), F.col("dominant_value")),
                  F.col("column"), _share(F.col("dominance")), f">={dominance_threshold_pct}%",
                  "A nearly constant column adds little to an analysis.",
                  _notes(dominant_value=F.col("dominant_value"),
                         dominant_frequency=F.col("dominant_frequency"),
                         dominance_percentage=F.col("dominance"), unique_count=F.col("unique_count")))


def high_cardinality_issues(profile: DataFrame, table: DataFrame,
                            uniqueness_threshold_pct: float = 80.0,
                            min_unique_count: int = 50) -> DataFrame:
    pct = F.col("unique_percentage")
    found = profile.where((F.col("semantic_type") == "categorical")
                          & (F.col("unique_count") >= min_unique_count)
                          & (pct >= uniqueness_threshold_pct))
    return _issue(found, "HIGH_CARDINALITY", "WARNING", "Nearly every category is new",
                  F.format_string("'%s' has %d distinct values (%s of the rows)", F.col("column"),
                                  F.col("unique_count"), _share(pct)),
                  F.col("column"), _share(pct),
                  f">={uniqueness_threshold_pct}% and >={min_unique_count} distinct",
                  "One column per category would be too many.",
                  _notes(unique_count=F.col("unique_count"), unique_percentage=pct))


def identifier_issues(profile: DataFrame, table: DataFrame) -> DataFrame:
    found = profile.where(F.col("semantic_type") == "identifier")
    return _issue(found, "IDENTIFIER_FEATURE", "INFO", "Identifier",
                  F.format_string("'%s' looks like a key and says little by itself", F.col("column")),
                  F.col("column"), F.lit("identifier"), "semantic_type == 'identifier'",
                  "Keys are best left out of feature sets.",
                  _notes(semantic_type=F.col("semantic_type"), unique_count=F.col("unique_count")))


def non_finite_issues(profile: DataFrame, table: DataFrame) -> DataFrame:
    found = profile.where((F.col("semantic_type") == "numerical") & (F.col("infinite_count") > 0))
    return _issue(found, "INVALID_NUMERICAL_VALUES", "ERROR", "Infinite numbers",
                  F.format_string("'%s' holds %d infinite values", F.col("column"),
                                  F.col("infinite_count")),
                  F.col("column"), F.lit("infinity/NaN"), "finite real numbers",
                  "Infinities spread through sums and break models.",
                  _notes(infinite_count=F.col("infinite_count")))


DEFAULT_RULES: tuple[Rule, ...] = (
    missingness_issues, duplicate_row_issues, constant_column_issues, low_variance_issues,
    high_cardinality_issues, identifier_issues, non_finite_issues)


def quality_issues(profile: DataFrame, table: DataFrame,
                   rules: tuple[Rule, ...] | list[Rule] | None = None) -> DataFrame:
    """All issues of all rules. ``functools.partial`` sets a rule's thresholds."""
    rules = DEFAULT_RULES if rules is None else rules
    return reduce(lambda a, b: a.unionByName(b), [rule(profile, table) for rule in rules])


def severity_counts(issues: DataFrame) -> DataFrame:
    """One row: issues in total and per severity."""
    return issues.agg(F.count("*").alias("total_issues"), *[
        F.count_if(F.col("severity") == s).alias(f"{s.lower()}_issues") for s in SEVERITIES])


def grade(score: Column) -> Column:
    ladder = F.when(score >= GRADES[0][0], GRADES[0][1])
    for border, name in GRADES[1:]:
        ladder = ladder.when(score >= border, name)
    return ladder.otherwise(LOWEST_GRADE)


def quality_score(table: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: the deductions, the 0-100 score and its grade."""
    def found(rule_id: str) -> Column:
        return F.count_if(F.col("rule_id") == rule_id)

    counts = issues.agg(
        (found("ALL_NULL") * 15.0 + found("CONSTANT_COLUMN") * 5.0).alias("unusable"),
        (found("INVALID_NUMERICAL_VALUES") * 10.0).alias("invalid"),
        (found("LOW_VARIANCE") * 2.5).alias("dull"))
    deductions = {
        "completeness": F.least(F.lit(35.0), F.col("missing_percentage") / 100.0 * 40.0),
        "uniqueness": F.least(F.lit(25.0), F.col("duplicate_percentage") / 100.0 * 35.0),
        "usability": F.least(F.lit(30.0), F.col("unusable")),
        "validity": F.least(F.lit(10.0), F.col("invalid")),
        "low_info": F.least(F.lit(10.0), F.col("dull"))}
    total = reduce(lambda a, b: a + b, deductions.values())
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100.0 - total, 1)))
    return (table.join(F.broadcast(counts))              # one row each
            .select("dataset_name",
                    *[F.round(c, 1).alias(f"{name}_deduction") for name, c in deductions.items()],
                    score.alias("overall_score"))
            .withColumn("grade", grade(F.col("overall_score"))))


def column_scores(profile: DataFrame, issues: DataFrame) -> DataFrame:
    """(ordinal, column, score), 0-100."""
    penalty = (F.when(F.col("rule_id") == "CONSTANT_COLUMN", 25.0)
               .when(F.col("rule_id") == "LOW_VARIANCE", 10.0)
               .when(F.col("rule_id") == "INVALID_NUMERICAL_VALUES", 30.0)
               .when(F.col("rule_id") == "HIGH_CARDINALITY", 5.0).otherwise(0.0))
    per_column = (issues.where(F.col("column").isNotNull()).groupBy("column")
                  .agg(F.sum(penalty).alias("penalty")))
    pct = F.col("missing_percentage")
    left = 100.0 - F.least(F.lit(50.0), pct * 0.6) - F.coalesce("penalty", F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(left, 1)))
    return (profile.join(F.broadcast(per_column), "column", "left")
            .select("ordinal", "column", F.when(pct >= 100.0, 0.0).otherwise(score).alias("score")))


def quality_report(df: DataFrame, name: str = "dataset",
                   rules: list[Rule] | None = None, profile: DataFrame | None = None,
                   table: DataFrame | None = None) -> dict[str, DataFrame]:
    """``report`` (one row), ``issues`` and ``column_scores``."""
    profile = column_profile(df) if profile is None else profile
    table = dataset_profile(df, profile, name) if table is None else table
    issues = pin(quality_issues(profile, table, rules))
    report = quality_score(table, issues).join(F.broadcast(severity_counts(issues)))
    return {"report": report, "issues": issues, "column_scores": column_scores(profile, issues)}


def with_thresholds(rule: Rule, **thresholds: float) -> Rule:
    """A rule with other thresholds, e.g. ``with_thresholds(low_variance_issues,
    dominance_threshold_pct=80.0)``."""
    return partial(rule, **thresholds)
