"""The whole cascade over one table: profile, quality, findings, models, evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..functions.columns import pin
from ..operators import anomaly, cluster, density, evaluate, evidence, features, reduce
from ..operators.findings import analyze_statistics
from ..operators.profile import column_profile, dataset_profile
from ..operators.quality import quality_report


@dataclass(frozen=True)
class ModelConfig:
    """Which models run, and how."""
    anomaly: str = "isolation_forest"        # or local_outlier_factor
    contamination: float = 0.05
    n_estimators: int = 100
    n_neighbors: int = 20
    clustering: str = "kmeans"               # or dbscan
    n_clusters: int | None = 3               # None: chosen by silhouette
    eps: float = 0.5
    min_samples: int = 5
    metric: str = "euclidean"                # of local_outlier_factor and dbscan
    n_init: int = 10
    n_components: int = 2
    scaling: str | None = "standard"
    numeric_imputation: str = "median"
    max_categories: int = 50
    random_state: int = 42


def analyze_models(df: DataFrame, key: str, config: ModelConfig | None = None,
                   profile: DataFrame | None = None) -> dict[str, DataFrame]:
    """Features, outliers, clusters, components and what they say; ``key`` names the rows."""
    config = config or ModelConfig()
    spark = df.sparkSession
    model = features.fit_features(df.drop(key), profile, config.numeric_imputation, config.scaling,
                                  config.max_categories)
    names = model.feature_names
    if not names:
        raise ValueError("no column is usable as a feature")
    ready = model.transform(df, keep=[key]).persist(StorageLevel.MEMORY_AND_DISK)
    if config.anomaly == "isolation_forest":
        flagged = anomaly.isolation_forest(ready, names, key, config.contamination,
                                           config.n_estimators, config.random_state)
        contribution = anomaly.anomaly_contribution(flagged, names)
    else:
        flagged = anomaly.local_outlier_factor(ready, names, key, config.n_neighbors, config.contamination,
                                               metric=config.metric)
        contribution = None
    choice, inertia = None, None
    if config.clustering == "kmeans":
        k = config.n_clusters
        if k is None:
            choice = pin(cluster.auto_k(ready, names, random_state=config.random_state, n_init=config.n_init))
            k = choice.where("selected").first().k
        fitted = cluster.kmeans(ready, names, k, config.random_state, config.n_init)
        labels, inertia = fitted.labels, fitted.inertia
    else:
        labels = ready.join(density.dbscan(ready, names, key, config.eps, config.min_samples,
                                           metric=config.metric), key)
    silhouette = cluster.silhouette(labels, names, key)
    sizes = pin(cluster.cluster_sizes(labels))
    separation = pin(cluster.distinguishing_features(labels, names))
    components = reduce.pca(ready, names, config.n_components)
    explained = components.explained(spark)
    loadings = components.loading_table(spark)
    summary = pin(anomaly.score_summary(flagged))
    evaluation = pin(evaluate.ml_evaluation(summary, sizes, silhouette, explained, inertia))
    found = pin(evaluate.ml_findings(evaluation, config.anomaly, config.clustering, contribution,
                                     separation, loadings))
    original = df.join(labels.select(key, "cluster"), key)
    out = {
        "preprocessing": model.summary(spark), "anomaly_summary": summary, "cluster_sizes": sizes,
        "cluster_profile": cluster.cluster_profile(labels, names),
        "cluster_categories": cluster.cluster_categories(original.drop(key)),
        "distinguishing_features": separation, "explained": explained, "loadings": loadings,
        "top_loadings": reduce.top_loadings(loadings), "evaluation": evaluation, "ml_findings": found,
        "score_histogram": evaluate.score_histogram(flagged)}
    if components.completed:
        out["points"] = evaluate.ml_points(components.projected, flagged, labels, key)
    if contribution is not None:
        out["contribution"] = contribution
    if choice is not None:
        out["auto_k"] = choice
    return out


def analyze(df: DataFrame, key: str | None = None, name: str = "dataset",
            config: ModelConfig | None = None, **thresholds) -> dict[str, DataFrame]:
    """Every result table of the cascade. Models need a ``key`` column and are skipped without one."""
    profile = column_profile(df)
    table = dataset_profile(df, profile, name)
    out = {"column_profile": profile, "dataset_profile": table}
    out |= quality_report(df, name, profile=profile, table=table)
    out |= analyze_statistics(df, profile, **thresholds)
    ml = None
    if key is not None:
        models = analyze_models(df, key, config, profile)
        out |= models
        ml = models["ml_findings"]
    out["overview"] = evidence.overview(table, out["report"], out.get("evaluation"))
    out["key_findings"] = evidence.key_findings(out["findings"], ml)
    out["evidence"] = evidence.evidence_context(profile, out["issues"], out["findings"], ml)
    return out
