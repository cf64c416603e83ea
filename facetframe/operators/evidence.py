"""Overview, key findings and the bounded evidence table built from all results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .findings import importance_rank
from .quality import SEVERITIES

STAGE_FINDINGS = 4


def overview(table: DataFrame, report: DataFrame, evaluation: DataFrame | None = None) -> DataFrame:
    """One row: size, health, gaps, duplicates, model figures, columns per type."""
    out = table.join(F.broadcast(report.select(
        "dataset_name", "overall_score", "grade", "total_issues", "critical_issues", "error_issues",
        "warning_issues")), "dataset_name")
    if evaluation is not None:
        names = {"anomaly_count": "anomalies_found", "anomaly_percentage": "anomaly_percentage",
                 "cluster_count": "clusters_found", "pca_cumulative_variance": "pca_variance_explained"}
        models = (evaluation.groupBy().pivot("metric", list(names)).agg(F.first("value"))
                  .select(*[F.col(k).alias(v) for k, v in names.items()])
                  .withColumn("pca_variance_explained", F.coalesce("pca_variance_explained", F.lit(0.0))))
        out = out.join(F.broadcast(models))               # one row each
    return out


def key_findings(findings: DataFrame, ml_findings: DataFrame | None = None, per_stage: int = STAGE_FINDINGS) -> DataFrame:
    """(stage, place, finding_id, finding_type, importance, title) of the first findings of each stage."""
    shown = ["finding_id", "finding_type", "importance", "title"]
    parts = [findings.select(F.lit("statistics").alias("stage"), *shown)]
    if ml_findings is not None:
        parts.append(ml_findings.select(F.lit("ml").alias("stage"), *shown))
    together = reduce(lambda a, b: a.unionByName(b), parts)
    order = W.partitionBy("stage").orderBy(importance_rank(F.col("importance")), "finding_id")
    return (together.withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= per_stage).select("stage", "place", *shown))


def evidence_context(profile: DataFrame, issues: DataFrame | None = None, findings: DataFrame | None = None,
                     ml_findings: DataFrame | None = None, max_columns: int = 20, max_issues: int = 10,
                     max_findings: int = 15) -> DataFrame:
    """(section, place, id, importance, columns, evidence): aggregates only, never rows.

    The first columns, the most severe issues, the most important findings and all model
    findings. The limits are what the table is for.
    """
    def section(name: str, rows: DataFrame, order: list, limit: int | None, **parts) -> DataFrame:
        placed = rows.withColumn("place", F.row_number().over(W.orderBy(*order)))   # O(columns) rows
        placed = placed if limit is None else placed.where(F.col("place") <= limit)
        return placed.select(F.lit(name).alias("section"), "place", *[v.alias(k) for k, v in parts.items()])

    names = F.concat_ws(",", "affected_columns") if findings is not None or ml_findings is not None else None
    out = [section("column", profile, ["ordinal"], max_columns, id=F.col("column"),
                   importance=F.lit(None).cast("string"), columns=F.col("column"),
                   evidence=F.to_json(F.struct("semantic_type", "missing_percentage", "unique_count")))]
    if issues is not None:
        severity = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
        out.append(section("issue", issues, [severity, "rule_id", F.asc_nulls_last("column")], max_issues,
                           id=F.col("rule_id"), importance=F.col("severity"),
                           columns=F.coalesce("column", F.lit("")), evidence=F.col("measured_value")))
    for name, found, limit in (("finding", findings, max_findings), ("ml_finding", ml_findings, None)):
        if found is not None:
            out.append(section(name, found, [importance_rank(F.col("importance")), "finding_id"], limit,
                               id=F.col("finding_id"), importance=F.col("importance"), columns=names,
                               evidence=F.to_json("measured_values")))
    return reduce(lambda a, b: a.unionByName(b), out)
