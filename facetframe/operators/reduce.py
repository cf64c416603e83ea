"""Principal components."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import col
from .features import assemble

TOP_FEATURES = 5


@dataclass(frozen=True)
class PCAResult:
    """Model figures (features x components) and the projected rows."""
    features: list[str]
    ratios: list[float]
    loadings: list[list[float]]         # one list of weights per component
    projected: DataFrame | None         # the rows with pc1..pck
    error: str | None = None

    @property
    def completed(self) -> bool:
        return self.error is None

    def explained(self, spark) -> DataFrame:
        """(component, explained_variance_ratio, cumulative)."""
        total, rows = 0.0, []
        for i, ratio in enumerate(self.ratios):
            total += ratio
            rows.append((f"PC{i + 1}", ratio, total))
        return spark.createDataFrame(rows, "component string, explained_variance_ratio double, cumulative double")

    def loading_table(self, spark) -> DataFrame:
        """(component, feature, loading)."""
        rows = [(f"PC{i + 1}", f, float(v)) for i, c in enumerate(self.loadings)
                for f, v in zip(self.features, c)]
        return spark.createDataFrame(rows, "component string, feature string, loading double")


def pca(df: DataFrame, features: list[str], k: int = 2) -> PCAResult:
    """Project centred features on the k directions of largest variance.

    The sign of a component is fixed: its largest weight is positive.
    """
    rows = df.limit(max(2, k)).count()
    if not features or rows == 0:
        return PCAResult(features, [], [], None, "the feature table is empty")
    if rows < 2:
        return PCAResult(features, [], [], None, "at least two rows are needed")
    k = min(k, len(features), rows)
    means = df.agg(*[F.avg(col(f)) for f in features]).first()
    centred = df.select(*[(col(f) - F.lit(m)).alias(f) for f, m in zip(features, means)])
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(assemble(centred, features))
    weights = model.pc.toArray().T
    loadings = []
    for component in weights:
        largest = max(range(len(component)), key=lambda i: (abs(component[i]), -i))
        loadings.append([float(v) for v in (component if component[largest] >= 0 else -component)])
    projected = df.withColumns({
        f"pc{c + 1}": sum(((col(f) - F.lit(m)) * F.lit(w) for f, m, w in
                           zip(features[1:], means[1:], component[1:])),
                          (col(features[0]) - F.lit(means[0])) * F.lit(component[0]))
        for c, component in enumerate(loadings)})
    return PCAResult(features, [float(v) for v in model.explainedVariance.toArray()], loadings, projected)


def top_loadings(loadings: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """(component, place, feature, loading, abs_loading): the strongest features of each component."""
    size = F.abs("loading")
    place = F.row_number().over(W.partitionBy("component").orderBy(F.desc(size), "feature"))
    return (loadings.withColumn("place", place).where(F.col("place") <= top)
            .select("component", "place", "feature", "loading", size.alias("abs_loading")))
