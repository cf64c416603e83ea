"""Quality rules, scores and grades on a table with faults derived from orders."""

from pyspark.sql import functions as F

from facetframe.operators import quality as R
from facetframe.operators.profile import column_profile, dataset_profile

from .registry import query, table

# Every rule finds something: gaps of each tier, a constant, a dominated column, copies, infinities.
FAULTY_SQL = """
SELECT o_orderkey // 2 AS pair_id, o_custkey % 100 AS bucket,
  CASE WHEN o_custkey % 10 < 1 THEN NULL ELSE o_orderpriority END AS some_gaps,
  CASE WHEN o_custkey % 10 < 3 THEN NULL ELSE o_orderpriority END AS many_gaps,
  CASE WHEN o_custkey % 10 < 7 THEN NULL ELSE o_orderpriority END AS mostly_gaps,
  NULL::VARCHAR AS nothing, 'fixed' AS constant,
  CASE WHEN o_custkey % 50 = 0 THEN 'rare' ELSE 'usual' END AS dominated,
  o_custkey % 50 > 0 AS is_usual,
  'note ' || o_orderkey AS note,
  CASE WHEN o_custkey % 100 = 0 THEN 'Infinity'::DOUBLE ELSE o_totalprice END AS price FROM orders"""


def faulty(spark, sf):
    key = F.col("o_custkey")
    gap = lambda n: F.when(key % 10 >= n, F.col("o_orderpriority"))
    return table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 2).cast("long").alias("pair_id"), (key % 100).alias("bucket"),
        gap(1).alias("some_gaps"), gap(3).alias("many_gaps"), gap(7).alias("mostly_gaps"),
        F.lit(None).cast("string").alias("nothing"), F.lit("fixed").alias("constant"),
        F.when(key % 50 == 0, "rare").otherwise("usual").alias("dominated"), (key % 50 > 0).alias("is_usual"),
        F.concat(F.lit("note "), F.col("o_orderkey").cast("string")).alias("note"),
        F.when(key % 100 == 0, float("inf")).otherwise(F.col("o_totalprice")).alias("price"))


_COLUMNS = ("pair_id", "bucket", "some_gaps", "many_gaps", "mostly_gaps", "nothing", "constant",
            "dominated", "is_usual", "note", "price")
_KINDS = {"pair_id": "identifier", "bucket": "numerical", "is_usual": "boolean", "price": "numerical"}


def _line(c: str) -> str:
    kind = _KINDS.get(c, "categorical")
    dominant = (f"(SELECT max(n) FROM (SELECT count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c}))"
                if kind in ("categorical", "boolean") else "NULL::BIGINT")
    infinite = f"count_if(isinf({c}))" if c == "price" else "0"
    return f"""SELECT '{c}' AS "column", '{kind}' AS kind, count(*) AS n, count({c}) AS present,
      round((count(*) - count({c})) / count(*) * 100, 2) AS miss, count(DISTINCT {c}) AS uniq,
      round(count(DISTINCT {c}) / count(*) * 100, 2) AS uniq_pct, {dominant} AS dominant, {infinite} AS inf FROM t"""


_ISSUES = f"WITH t AS MATERIALIZED ({FAULTY_SQL}), p AS MATERIALIZED (" + "\nUNION ALL\n".join(
    _line(c) for c in _COLUMNS) + """),
d AS MATERIALIZED (SELECT round(sum(n - present) / sum(n) * 100, 2) AS miss,
  round((max(n) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))) / max(n) * 100, 2) AS dup_pct,
  max(n) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS dup FROM p),
issues AS MATERIALIZED (
SELECT CASE WHEN miss >= 100 THEN 'ALL_NULL' WHEN miss > 50 THEN 'EXTREME_MISSINGNESS'
            WHEN miss > 20 THEN 'HIGH_MISSINGNESS' ELSE 'MODERATE_MISSINGNESS' END AS rule_id,
       CASE WHEN miss >= 100 THEN 'CRITICAL' WHEN miss > 50 THEN 'ERROR' WHEN miss > 20 THEN 'WARNING' ELSE 'INFO' END AS severity,
       "column" FROM p WHERE miss > 5
UNION ALL SELECT 'DATASET_HIGH_MISSINGNESS', 'WARNING', NULL FROM d WHERE miss > 20
UNION ALL SELECT 'DUPLICATE_ROWS', CASE WHEN dup_pct > 50 THEN 'CRITICAL' WHEN dup_pct > 20 THEN 'ERROR'
                                        WHEN dup_pct > 5 THEN 'WARNING' ELSE 'INFO' END, NULL FROM d WHERE dup > 0
UNION ALL SELECT 'CONSTANT_COLUMN', 'WARNING', "column" FROM p WHERE n > 1 AND miss < 100 AND uniq = 1
UNION ALL SELECT 'LOW_VARIANCE', 'WARNING', "column" FROM p
  WHERE uniq > 1 AND miss < 100 AND present > 1 AND round(dominant / present * 100, 2) >= 95
UNION ALL SELECT 'HIGH_CARDINALITY', 'WARNING', "column" FROM p WHERE kind = 'categorical' AND uniq >= 50 AND uniq_pct >= 80
UNION ALL SELECT 'IDENTIFIER_FEATURE', 'INFO', "column" FROM p WHERE kind = 'identifier'
UNION ALL SELECT 'INVALID_NUMERICAL_VALUES', 'ERROR', "column" FROM p WHERE kind = 'numerical' AND inf > 0)
"""


def _tables(spark, sf):
    """Column and table profile of the faulty table, computed for each query."""
    df = faulty(spark, sf)
    profile = column_profile(df)
    return profile, dataset_profile(df, profile)


def _issues(spark, sf):
    return R.quality_issues(*_tables(spark, sf))


def _rule(name: str, rule, where: str):
    @query(name, _ISSUES + f'SELECT rule_id, severity, "column" FROM issues WHERE {where}')
    def _(spark, sf):
        return rule(*_tables(spark, sf)).select("rule_id", "severity", "column")


_rule("missingness_issues", R.missingness_issues, "rule_id LIKE '%MISSINGNESS' OR rule_id = 'ALL_NULL'")
_rule("constant_column_issues", R.constant_column_issues, "rule_id = 'CONSTANT_COLUMN'")
_rule("low_variance_issues", R.low_variance_issues, "rule_id = 'LOW_VARIANCE'")
_rule("high_cardinality_issues", R.high_cardinality_issues, "rule_id = 'HIGH_CARDINALITY'")
_rule("identifier_issues", R.identifier_issues, "rule_id = 'IDENTIFIER_FEATURE'")
_rule("non_finite_issues", R.non_finite_issues, "rule_id = 'INVALID_NUMERICAL_VALUES'")


@query("quality_issues", _ISSUES + 'SELECT rule_id, severity, "column" FROM issues')
def _(spark, sf):
    return _issues(spark, sf).select("rule_id", "severity", "column")


@query("duplicate_row_issues", """
SELECT 'DUPLICATE_ROWS' AS rule_id, CASE WHEN pct > 50 THEN 'CRITICAL' WHEN pct > 20 THEN 'ERROR'
  WHEN pct > 5 THEN 'WARNING' ELSE 'INFO' END AS severity, dup::VARCHAR AS duplicates
FROM (SELECT count(*) - count(DISTINCT (l_returnflag, l_linestatus)) AS dup,
  round((count(*) - count(DISTINCT (l_returnflag, l_linestatus))) / count(*) * 100, 2) AS pct FROM lineitem) WHERE dup > 0""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    profile = column_profile(df)
    found = R.duplicate_row_issues(profile, dataset_profile(df, profile))
    return found.select("rule_id", "severity", F.col("metadata")["duplicate_rows"].alias("duplicates"))


@query("custom_rules", _ISSUES + """
SELECT 'LOW_VARIANCE' AS rule_id, "column" FROM p WHERE uniq > 1 AND miss < 100 AND present > 1
  AND round(dominant / present * 100, 2) >= 15
UNION ALL SELECT 'WIDE_RANGE', "column" FROM p WHERE kind = 'numerical' AND uniq > 1000""")
def _(spark, sf):
    def wide_range(profile, _table):
        found = profile.where("semantic_type = 'numerical' AND unique_count > 1000")
        empty = R.identifier_issues(profile.limit(0), _table)
        return empty.unionByName(found.select(F.lit("WIDE_RANGE").alias("rule_id"), "column"), allowMissingColumns=True)

    rules = [R.with_thresholds(R.low_variance_issues, dominance_threshold_pct=15.0), wide_range]
    return R.quality_issues(*_tables(spark, sf), rules=rules).select("rule_id", "column")


@query("severity_counts", _ISSUES + """
SELECT count(*) AS total_issues, count_if(severity = 'CRITICAL') AS critical_issues, count_if(severity = 'ERROR') AS error_issues,
  count_if(severity = 'WARNING') AS warning_issues, count_if(severity = 'INFO') AS info_issues FROM issues""")
def _(spark, sf):
    return R.severity_counts(_issues(spark, sf))


_SCORE = _ISSUES + """, c AS (SELECT count_if(rule_id = 'ALL_NULL') * 15.0 + count_if(rule_id = 'CONSTANT_COLUMN') * 5.0 AS unusable,
  count_if(rule_id = 'INVALID_NUMERICAL_VALUES') * 10.0 AS invalid, count_if(rule_id = 'LOW_VARIANCE') * 2.5 AS dull FROM issues),
x AS (SELECT least(35.0, miss / 100 * 40)::DOUBLE AS a, least(25.0, dup_pct / 100 * 35)::DOUBLE AS b,
  least(30.0, unusable)::DOUBLE AS e, least(10.0, invalid)::DOUBLE AS f, least(10.0, dull)::DOUBLE AS g FROM d, c),
s AS (SELECT *, greatest(0, least(100, round(100 - (a + b + e + f + g), 1)))::DOUBLE AS overall_score FROM x)
"""


@query("quality_score", _SCORE + """
SELECT round(a, 1) AS completeness_deduction, round(b, 1) AS uniqueness_deduction, round(e, 1) AS usability_deduction,
  round(f, 1) AS validity_deduction, round(g, 1) AS low_info_deduction, overall_score FROM s""")
def _(spark, sf):
    profile, whole = _tables(spark, sf)
    return R.quality_score(whole, R.quality_issues(profile, whole)).drop("dataset_name", "grade")


@query("grade", _SCORE + """
SELECT CASE WHEN overall_score >= 90 THEN 'Excellent' WHEN overall_score >= 75 THEN 'Good' WHEN overall_score >= 60 THEN 'Fair'
  WHEN overall_score >= 40 THEN 'Poor' ELSE 'Critical' END AS grade FROM s""")
def _(spark, sf):
    profile, whole = _tables(spark, sf)
    return R.quality_score(whole, R.quality_issues(profile, whole)).select("grade")


@query("column_scores", _ISSUES + """
SELECT p."column", CASE WHEN miss >= 100 THEN 0.0 ELSE greatest(0, least(100, round(100 - least(50, miss * 0.6) - coalesce(sum(
  CASE rule_id WHEN 'CONSTANT_COLUMN' THEN 25 WHEN 'LOW_VARIANCE' THEN 10 WHEN 'INVALID_NUMERICAL_VALUES' THEN 30
       WHEN 'HIGH_CARDINALITY' THEN 5 ELSE 0 END), 0), 1))) END::DOUBLE AS score
FROM p LEFT JOIN issues i ON i."column" = p."column" GROUP BY p."column", miss""")
def _(spark, sf):
    profile, whole = _tables(spark, sf)
    return R.column_scores(profile, R.quality_issues(profile, whole)).drop("ordinal")


@query("quality_report", _SCORE + """
SELECT overall_score, (SELECT count(*) FROM issues) AS total_issues FROM s""")
def _(spark, sf):
    return R.quality_report(faulty(spark, sf))["report"].select("overall_score", "total_issues")
