"""Profiling, quality checks and pattern discovery for any DataFrame, as Spark jobs."""

from .operators.anomaly import (anomaly_contribution, isolation_forest, local_outlier_factor,
                                normalize_scores, score_summary)
from .operators.browse import OrderIndex, browse, clean_cells, page, page_totals, search, select_columns, sort_by
from .operators.cluster import (auto_k, cluster_categories, cluster_profile, cluster_sizes,
                                distinguishing_features, kmeans, silhouette)
from .operators.correlation import correlation_pairs
from .operators.density import dbscan
from .operators.distribution import distribution_shape
from .operators.evidence import evidence_context, key_findings, overview
from .operators.features import FeatureModel, feature_roles, fit_features
from .operators.findings import analyze_statistics, finding_counts, findings
from .operators.groups import (category_balance, category_concentration, group_summary,
                               group_variation)
from .operators.profile import (boolean_stats, categorical_stats, column_profile, common_stats,
                                dataset_profile, datetime_stats, duplicate_rows, identifier_stats,
                                numerical_stats, top_values)
from .operators.quality import column_scores, quality_issues, quality_report, quality_score
from .operators.reduce import pca
from .operators.responses import parse_responses
from .operators.semantic import detect_schema, schema_summary
from .operators.trend import period_means, trend_fit, trends
from .plans.analyze import ModelConfig, analyze, analyze_models
from .sources.readers import dataset_metadata, detect_format, load, load_tolerant
from .sources.writers import export_csv, export_report_json, report_json
