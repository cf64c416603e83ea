"""Figures, findings and chart tables of the unsupervised models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import INFINITY, col
from .cluster import NOISE

# Borders of the importance levels.
HIGH_ANOMALY_PCT = 5.0
HIGH_SILHOUETTE = 0.45
HIGH_TOP2_VARIANCE = 0.60


def _metric(rows: DataFrame, name: str, value: Column, reason: str | None = None) -> DataFrame:
    v = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    return rows.select(F.lit(name).alias("metric"), v.alias("value"),
                       F.when(v.isNull(), F.lit(reason)).alias("reason"))


def ml_evaluation(anomaly: DataFrame, clusters: DataFrame, silhouette: DataFrame,
                  explained: DataFrame, inertia: float | None = None) -> DataFrame:
    """(metric, value, reason): the reason tells why a value is undefined.

    ``anomaly`` is a score summary, ``clusters`` the cluster sizes, ``explained`` the PCA table.
    """
    noise = F.col("cluster") == NOISE
    table = clusters.agg(F.count_if(~noise).alias("clusters"),
                         F.sum(F.when(noise, F.col("size")).otherwise(0)).alias("noise"),
                         F.sum("size").alias("rows"))
    inertia_table = clusters.sparkSession.createDataFrame([(inertia,)], "inertia double")
    first_two = F.sum(F.when(F.col("component").isin("PC1", "PC2"), F.col("explained_variance_ratio")))
    components = explained.agg(first_two.alias("top2"), F.max("cumulative").alias("all"))
    parts = [
        _metric(anomaly, "anomaly_count", F.col("n_anomalies"), "no anomaly scores"),
        _metric(anomaly, "anomaly_percentage", F.col("anomaly_percentage"), "no anomaly scores"),
        _metric(anomaly, "anomaly_mean_score", F.col("mean"), "no anomaly scores"),
        _metric(table, "cluster_count", F.col("clusters"), "no clusters"),
        _metric(silhouette, "cluster_silhouette", F.col("silhouette"),
                "undefined with fewer than two clusters"),
        _metric(inertia_table, "cluster_inertia", F.col("inertia"), "only defined for k-means"),
        _metric(table, "noise_percentage", F.try_divide(F.col("noise") * 100.0, F.col("rows")), "no rows"),
        _metric(components, "pca_variance_top2", F.col("top2"), "no components"),
        _metric(components, "pca_cumulative_variance", F.col("all"), "no components")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _ml_finding(rows: DataFrame, finding_id: str, finding_type: str, importance: Column, title: Column,
                values: dict[str, Column], columns: Column) -> DataFrame:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(
        F.lit(finding_id).alias("finding_id"), F.lit(finding_type).alias("finding_type"),
        title.alias("title"), importance.alias("importance"), columns.alias("affected_columns"),
        F.create_map(*pairs).alias("measured_values"))


def _names(ranked: DataFrame | None, order: str, n: int = 3) -> list[str]:
    if ranked is None:
        return []
    return [r.feature for r in ranked.orderBy(F.desc(order), "feature").limit(n).collect()]


def ml_findings(evaluation: DataFrame, anomaly_algorithm: str = "isolation_forest",
                cluster_algorithm: str = "kmeans", contribution: DataFrame | None = None,
                separation: DataFrame | None = None, loadings: DataFrame | None = None) -> DataFrame:
    """Up to three findings: anomalies, clusters, explained variance."""
    wide = evaluation.groupBy().pivot("metric", [
        "anomaly_count", "anomaly_percentage", "anomaly_mean_score", "cluster_count",
        "cluster_silhouette", "pca_variance_top2", "pca_cumulative_variance"]).agg(F.first("value"))
    array = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    pct, sil, top2 = F.col("anomaly_percentage"), F.col("cluster_silhouette"), F.col("pca_variance_top2")
    pc1 = None if loadings is None else (
        loadings.where("component = 'PC1'").select("feature", F.abs("loading").alias("size")))
    return reduce(lambda a, b: a.unionByName(b), [
        _ml_finding(wide.where(F.col("anomaly_count") > 0), f"ML_ANOMALY_{anomaly_algorithm.upper()}",
                    "anomaly", F.when(pct >= HIGH_ANOMALY_PCT, "HIGH").otherwise("MEDIUM"),
                    F.format_string("%.1f%% of the rows are outliers", pct),
                    {"n_anomalies": F.col("anomaly_count").cast("long"), "anomaly_percentage": pct,
                     "mean_score": F.col("anomaly_mean_score"), "algorithm": F.lit(anomaly_algorithm)},
                    array(_names(contribution, "contribution"))),
        _ml_finding(wide.where(F.col("cluster_count") > 1), f"ML_CLUSTER_{cluster_algorithm.upper()}",
                    "cluster", F.when(sil >= HIGH_SILHOUETTE, "HIGH").otherwise("MEDIUM"),
                    F.format_string("The rows form %d clusters", F.col("cluster_count").cast("long")),
                    {"n_clusters": F.col("cluster_count").cast("long"), "silhouette_score": sil},
                    array(_names(separation, "separation_score"))),
        _ml_finding(wide.where(top2.isNotNull()), "ML_PCA_VARIANCE", "pca",
                    F.when(top2 >= HIGH_TOP2_VARIANCE, "HIGH").otherwise("INFO"),
                    F.format_string("Two components hold %.1f%% of the variance", top2 * 100),
                    {"top2_variance": top2, "cumulative_variance": F.col("pca_cumulative_variance")},
                    array(_names(pc1, "size")))])


def ml_points(projected: DataFrame, flagged: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, pc..., is_anomaly, anomaly_score, cluster): the row results joined on the key."""
    pcs = [c for c in projected.columns if c.startswith("pc") and c[2:].isdigit()]
    return (projected.select(col(key), *pcs)
            .join(flagged.select(col(key), "is_anomaly", "anomaly_score"), key, "left")
            .join(labels.select(col(key), "cluster"), key, "left"))


# Chart tables.

def scree_table(explained: DataFrame) -> DataFrame:
    return explained.select("component", "explained_variance_ratio", "cumulative")


def cluster_bars(sizes: DataFrame) -> DataFrame:
    """(label, size, proportion)."""
    label = F.when(F.col("cluster") == NOISE, "Noise").otherwise(
        F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    return sizes.select(label.alias("label"), "size", "proportion")


def cluster_means(profile: DataFrame) -> DataFrame:
    """(label, feature, mean) from a cluster profile."""
    label = F.when(F.col("cluster") == NOISE, "Noise").otherwise(
        F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    return profile.select(label.alias("label"), "feature", "mean")


def score_histogram(flagged: DataFrame, bins: int = 20, column: str = "anomaly_score") -> DataFrame:
    """(bin, low, high, rows): fixed bins over [0, 1], empty bins left out."""
    place = F.least(F.floor(col(column) * bins), F.lit(bins - 1)).cast("int")
    finite = (col(column).isNotNull()) & (F.abs(col(column)) != F.lit(INFINITY))
    return (flagged.where(finite).groupBy(place.alias("bin")).agg(F.count("*").alias("rows"))
            .select("bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), "rows"))
