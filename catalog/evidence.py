"""Overview, key findings, evidence tables and parsed model answers."""

from pyspark.sql import functions as F

from facetframe.operators import browse as B
from facetframe.operators import evidence as V
from facetframe.operators import quality as R
from facetframe.operators import responses as L
from facetframe.operators.profile import column_profile, dataset_profile

from . import findings as find
from . import models as mod
from . import quality as qual
from .registry import query, rounded, table, union_all


@query("overview", qual._SCORE + """
SELECT n AS row_count, 11::BIGINT AS column_count, (SELECT sum(n - present)::BIGINT FROM p) AS missing_cells,
  d.miss AS missing_percentage, d.dup AS duplicate_rows, dup_pct AS duplicate_percentage, overall_score,
  (SELECT count(*) FROM issues) AS total_issues, (SELECT count_if(severity = 'CRITICAL') FROM issues) AS critical_issues,
  (SELECT count_if(kind = 'categorical') FROM p) AS categorical_columns
FROM s, d, (SELECT max(n) AS n FROM p)""")
def _(spark, sf):
    df = qual.faulty(spark, sf)
    profile = column_profile(df)
    whole = dataset_profile(df, profile)
    report = R.quality_report(df, profile=profile, table=whole)["report"]
    return V.overview(whole, report).select(
        "row_count", "column_count", "missing_cells", "missing_percentage", "duplicate_rows", "duplicate_percentage",
        "overall_score", "total_issues", "critical_issues", "categorical_columns")


@query("overview_models", mod._EVALUATION + """
SELECT (SELECT count(*) FROM region) AS row_count, max(value) FILTER (metric = 'anomaly_count') AS anomalies_found,
  max(value) FILTER (metric = 'cluster_count') AS clusters_found,
  round(max(value) FILTER (metric = 'pca_cumulative_variance'), 5) AS pca_variance_explained FROM ev""")
def _(spark, sf):
    df = table(spark, sf, "region")
    profile = column_profile(df)
    whole = dataset_profile(df, profile)
    report = R.quality_report(df, profile=profile, table=whole)["report"]
    return rounded(V.overview(whole, report, mod.given_models(spark, sf)).select(
        "row_count", "anomalies_found", "clusters_found", "pca_variance_explained"), 5)


_RANK = "CASE importance WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


@query("key_findings", find._FINDINGS + f"""
SELECT 'statistics' AS stage, place::INTEGER AS place, finding_id, importance
FROM (SELECT *, row_number() OVER (ORDER BY {_RANK}, finding_id) AS place FROM f) WHERE place <= 4""")
def _(spark, sf):
    found = find.drift_findings(spark, sf)["findings"]
    return V.key_findings(found).select("stage", "place", "finding_id", "importance")


@query("evidence_columns_and_issues", qual._ISSUES + """
SELECT 'column' AS section, row_number() OVER ()::INTEGER AS place, c AS id, NULL::VARCHAR AS importance
FROM (SELECT unnest(['pair_id','bucket','some_gaps','many_gaps','mostly_gaps','nothing','constant','dominated','is_usual','note','price']) AS c)
UNION ALL
SELECT 'issue', place, rule_id, severity FROM (SELECT *, row_number() OVER (ORDER BY
  CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 3 ELSE 4 END, rule_id, "column" NULLS LAST)::INTEGER AS place FROM issues)
WHERE place <= 10""")
def _(spark, sf):
    profile, whole = qual._tables(spark, sf)
    issues = R.quality_issues(profile, whole)
    return V.evidence_context(profile, issues).select("section", "place", "id", "importance")


@query("evidence_findings", find._FINDINGS + f"""
SELECT 'finding' AS section, place, finding_id AS id, importance FROM (
  SELECT *, row_number() OVER (ORDER BY {_RANK}, finding_id)::INTEGER AS place FROM f) WHERE place <= 15
UNION ALL
SELECT 'ml_finding', place, id, importance FROM (VALUES (1, 'ML_PCA_VARIANCE', 'HIGH')) v(place, id, importance) WHERE false""")
def _(spark, sf):
    found = find.drift_findings(spark, sf)["findings"]
    profile = column_profile(table(spark, sf, "region"))
    return V.evidence_context(profile, findings=found).where("section = 'finding'").select(
        "section", "place", "id", "importance")


# Model answers, written from the documents in the shapes models answer in.

_KIND = "doc_id % 6"


def answers(spark, sf):
    """One answer per document: plain, fenced, wrapped in prose, broken, without a summary, wrong list."""
    kind = F.col("doc_id") % 6
    insight = F.format_string(
        '{"insight_id": "I%d", "title": "Length of %d", "importance": "high", "category": "Shape",'
        ' "affected_columns": ["n_chars", "lang"], "evidence": {"n": %d}, "caveats": null}',
        "doc_id", "doc_id", "n_chars")
    body = F.concat(F.lit('{"executive_summary": " About '), "source", F.lit('.", "insights": ['), insight,
                    F.lit(', {"summary": "second"}, 7], "recommendations": [{"title": "Trim", "action_type": "CLEANING",'
                          ' "supporting_evidence": "I1"}, {}], "warnings": ["short text", 3]}'))
    text = (F.when(kind == 0, body)
            .when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
            .when(kind == 2, F.concat(F.lit("My answer: "), body, F.lit(" - as asked")))
            .when(kind == 3, F.concat(F.lit('{"executive_summary": '), "source"))
            .when(kind == 4, F.lit('{"insights": []}'))
            .otherwise(F.lit('{"executive_summary": "x", "insights": "none"}')))
    return table(spark, sf, "documents").select("doc_id", text.alias("response"))


@query("parse_responses", """
SELECT doc_id, CASE WHEN doc_id % 6 < 3 THEN 'About ' || source || '.' END AS executive_summary,
  CASE doc_id % 6 WHEN 3 THEN 'the answer is not valid JSON' WHEN 4 THEN 'executive_summary is missing'
                  WHEN 5 THEN 'insights is not a list' END AS error FROM documents""")
def _(spark, sf):
    return L.parse_responses(answers(spark, sf)).select("doc_id", "executive_summary", "error")


@query("response_insights", """
SELECT doc_id, 'I' || doc_id AS insight_id, 'Length of ' || doc_id AS title, 'Length of ' || doc_id AS summary,
  'HIGH' AS importance, 'shape' AS category, 'n_chars,lang' AS affected_columns, '{"n":' || n_chars || '}' AS evidence, NULL::VARCHAR AS caveats
FROM documents WHERE doc_id % 6 < 3
UNION ALL SELECT doc_id, 'INSIGHT_02', 'Untitled Insight', 'second', 'INFO', 'general', '', '{}', NULL FROM documents WHERE doc_id % 6 < 3""")
def _(spark, sf):
    found = L.insights(L.parse_responses(answers(spark, sf)))
    return found.withColumn("affected_columns", F.concat_ws(",", "affected_columns")).drop("explanation")


@query("response_recommendations", """
SELECT doc_id, 'REC_01' AS recommendation_id, 'Trim' AS title, 'Trim' AS description, 'cleaning' AS action_type, 'I1' AS supporting_evidence,
  'medium' AS priority FROM documents WHERE doc_id % 6 < 3
UNION ALL SELECT doc_id, 'REC_02', 'Technical Recommendation', 'Technical Recommendation', 'investigation', '', 'medium'
FROM documents WHERE doc_id % 6 < 3""")
def _(spark, sf):
    found = L.recommendations(L.parse_responses(answers(spark, sf)))
    return found.withColumn("supporting_evidence", F.concat_ws(",", "supporting_evidence"))


@query("response_warnings", """
SELECT doc_id, w AS warning FROM documents, (VALUES ('short text'), ('3')) v(w) WHERE doc_id % 6 < 3""")
def _(spark, sf):
    return L.warnings(L.parse_responses(answers(spark, sf)))


@query("failed_responses", union_all([
    f"SELECT doc_id, '{e}' AS error FROM documents WHERE {_KIND} = {k}"
    for k, e in ((3, "the answer is not valid JSON"), (4, "executive_summary is missing"), (5, "insights is not a list"))]))
def _(spark, sf):
    return L.failed_responses(L.parse_responses(answers(spark, sf)))


@query("insights_by_importance", "SELECT doc_id, 'I' || doc_id AS insight_id FROM documents WHERE doc_id % 6 < 3")
def _(spark, sf):
    found = L.insights(L.parse_responses(answers(spark, sf)))
    return B.insights_by_importance(found, "High").select("doc_id", "insight_id")


@query("insights_by_category", "SELECT doc_id, 'INSIGHT_02' AS insight_id FROM documents WHERE doc_id % 6 < 3")
def _(spark, sf):
    found = L.insights(L.parse_responses(answers(spark, sf)))
    return B.insights_by_category(found, "GENERAL").select("doc_id", "insight_id")
