import pytest

from facetframe.operators import quality as R
from facetframe.operators.profile import column_profile, dataset_profile


def report(df):
    return R.quality_report(df)


def issues(df):
    return {(r.rule_id, r.severity, r.column) for r in report(df)["issues"].collect()}


@pytest.mark.parametrize("missing, expected", [
    (1, ("MODERATE_MISSINGNESS", "INFO")), (3, ("HIGH_MISSINGNESS", "WARNING")),
    (7, ("EXTREME_MISSINGNESS", "ERROR")), (10, ("ALL_NULL", "CRITICAL"))])
def test_missingness_tiers(spark, missing, expected):
    df = spark.createDataFrame([(None if i < missing else i, i) for i in range(10)], "v int, w int")
    assert (*expected, "v") in issues(df)


@pytest.mark.parametrize("rows, copies, severity", [(24, 1, "INFO"), (18, 2, "WARNING"), (4, 6, "CRITICAL")])
def test_duplicate_tiers(spark, rows, copies, severity):
    values = [(i, "x") for i in range(rows)] + [(0, "x")] * copies
    assert ("DUPLICATE_ROWS", severity, None) in issues(spark.createDataFrame(values, "n int, t string"))


def test_constant_dominated_and_crowded_columns(spark):
    df = spark.createDataFrame([("active", "A" if i < 98 else f"B{i}", f"text {i}", i != 0) for i in range(100)],
                               "const string, category string, description string, flag boolean")
    found = issues(df)
    assert ("CONSTANT_COLUMN", "WARNING", "const") in found
    assert ("LOW_VARIANCE", "WARNING", "category") in found
    assert ("LOW_VARIANCE", "WARNING", "flag") in found
    assert ("HIGH_CARDINALITY", "WARNING", "description") in found


def test_infinite_numbers(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (2.0,)], "v double")
    assert ("INVALID_NUMERICAL_VALUES", "ERROR", "v") in issues(df)
    clean = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert not any(i[0] == "INVALID_NUMERICAL_VALUES" for i in issues(clean))


def test_perfect_table_scores_100(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "feature_a int, feature_b string")
    row = report(df)["report"].first()
    assert (row.overall_score, row.grade, row.total_issues) == (100.0, "Excellent", 0)


def test_bad_table_scores_low(spark):
    df = spark.createDataFrame([(None, 1)] * 20, "empty string, repeated int")
    row = report(df)["report"].first()
    assert row.overall_score < 70
    scores = {r.column: r.score for r in report(df)["column_scores"].collect()}
    assert scores == {"empty": 0.0, "repeated": 75.0}


def test_plots_score(spark, plots):
    out = report(plots)
    row = out["report"].first()
    assert row.overall_score >= 90 and row.grade == "Excellent"
    rules = {r.rule_id for r in out["issues"].collect()}
    assert {"MODERATE_MISSINGNESS", "DUPLICATE_ROWS", "IDENTIFIER_FEATURE"} <= rules
    assert {r.column: r.score for r in out["column_scores"].collect()}["plot_id"] == 100.0


def test_own_rules_replace_the_defaults(spark, plots):
    profile = column_profile(plots)
    table = dataset_profile(plots, profile)
    strict = R.with_thresholds(R.missingness_issues, moderate_pct=50.0)
    assert R.quality_issues(profile, table, [strict]).count() == 0
