"""k-means, the choice of k, silhouettes, and descriptions of clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_text, col, is_nested, is_numeric, normalize, pin
from ..functions.quantiles import quantiles
from .centroids import Points, Run, nearest_centre, points_of
from .features import assemble, tall
from .metric_space import GROUP_ROWS, GROUPS, TILE, matrix, meet_groups, pair_gaps, rough_squares
from .neighbors import MEASURED

NOISE = -1
SILHOUETTE_METRIC = "squared_euclidean"
SILHOUETTE_CHUNK = 2_000
SILHOUETTE_TILE = 512         # rows measured at a time against TILE others
SUMS = 4_000_000              # sums of a group: its rows times all clusters
PROFILED_FEATURES = 25
PROFILED_CATEGORIES = 5
TOP_FEATURES = 5


class KMeansResult:
    """Labelled rows with the model figures. Clusters are numbered by size, largest first."""

    def __init__(self, labels: DataFrame, k: int, inertia: float, centres: list[list[float]]):
        self.labels, self.k, self.inertia, self.centres = labels, k, inertia, centres

    def centre_table(self, features: list[str]) -> DataFrame:
        """(cluster, feature, centre)."""
        rows = [(c, f, float(v)) for c, centre in enumerate(self.centres) for f, v in zip(features, centre)]
        return self.labels.sparkSession.createDataFrame(rows, "cluster int, feature string, centre double")


def kmeans(df: DataFrame, features: list[str], n_clusters: int = 3, random_state: int = 42,
           n_init: int = 10, max_iter: int = 300) -> KMeansResult:
    """The best of ``n_init`` k-means runs by inertia; adds ``cluster`` to the rows."""
    with points_of(df, features) as points:
        rows = points.rows
        k = max(1, min(n_clusters, rows))
        if k > 1:
            best = _best(points.fit([(k, random_state + i) for i in range(n_init)], max_iter))
            return _labelled(df, features, points, best)
    centre = [[r for r in df.agg(*[F.avg(col(f)) for f in features]).first()]]
    return KMeansResult(df.withColumn("cluster", F.lit(0)), k, 0.0 if rows < 2 else _inertia(df, features, centre[0]), centre)


def _best(runs: list[Run]) -> Run:
    return min(runs, key=lambda r: r.inertia)


def _labelled(df: DataFrame, features: list[str], points: Points, run: Run) -> KMeansResult:
    """The rows with their clusters, numbered by size; the vectors are assembled anew."""
    centres = [[float(v) for v in c] for c in run.centres]
    order = sorted(range(len(centres)), key=lambda i: (-run.sizes[i], centres[i]))
    labels = nearest_centre(df, features, run.centres[order], points.shift, "cluster")
    return KMeansResult(labels, len(centres), run.inertia, [centres[i] for i in order])


def _inertia(df: DataFrame, features: list[str], centre: list[float]) -> float:
    squares = [(col(f) - F.lit(c)) * (col(f) - F.lit(c)) for f, c in zip(features, centre)]
    return float(df.agg(F.sum(sum(squares[1:], squares[0]))).first()[0] or 0.0)


def auto_k(df: DataFrame, features: list[str], min_k: int = 2, max_k: int = 8, random_state: int = 42,
           n_init: int = 10, max_iter: int = 300, metric: str = SILHOUETTE_METRIC) -> DataFrame:
    """(k, inertia, silhouette, metric, selected): the first k with the highest silhouette."""
    schema = "k int, inertia double, silhouette double, metric string, selected boolean"
    with points_of(df, features) as points:
        highest = min(max_k, points.rows - 1)
        lowest = min(min_k, highest)
        ks = list(range(lowest, highest + 1)) if lowest < highest else []
        # all runs of all k move in the same scans
        wanted = [(k, random_state + i) for k in ks for i in range(n_init)]
        runs = points.fit(wanted, max_iter) if wanted else []
        best_of = [_best([r for r, (of, _) in zip(runs, wanted) if of == k]) for k in ks]
        if metric == "euclidean":
            scores = [silhouette(_labelled(df, features, points, r).labels, features, metric=metric).first().silhouette for r in best_of]
        else:
            scores = points.silhouettes(best_of) if ks else []
    tried = [(k, r.inertia, score, metric) for k, r, score in zip(ks, best_of, scores)]
    if not tried:
        return df.sparkSession.createDataFrame([(max(1, lowest), None, None, None, True)], schema)
    best = max(tried, key=lambda t: (t[2] if t[2] is not None else -1.0, -t[0]))[0]
    return df.sparkSession.createDataFrame([(*t, t[0] == best) for t in tried], schema)


def elbow(table: DataFrame) -> DataFrame:
    """The k after which inertia stops dropping fastest: largest second difference."""
    w = W.orderBy("k")                                    # one row per tried k
    bend = (F.lag("inertia").over(w) - F.col("inertia")) - (F.col("inertia") - F.lead("inertia").over(w))
    return (table.withColumn("bend", bend).where(F.col("bend").isNotNull())
            .orderBy(F.desc("bend"), "k").limit(1).select("k", "inertia", "bend"))


def _measured(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of two bounded matrices; those that cancellation could touch are measured one by one."""
    squares, error = rough_squares(a, b)
    i, j = np.nonzero(squares <= 1e9 * error[:, None])
    np.sqrt(np.maximum(squares, 0.0, out=squares), out=squares)
    for s in range(0, len(i), MEASURED):
        x, y = i[s:s + MEASURED], j[s:s + MEASURED]
        squares[x, y] = pair_gaps(a[x], b[y])
    return squares


class _Clustered:
    """The rows of a group in a task, ordered by cluster, and for each the sums of its distances to other clusters."""

    def __init__(self, table: pa.Table):
        cluster = table["cluster"].to_numpy()
        order = np.argsort(cluster, kind="stable")
        self.points, self.names = matrix(table["point"])[order], table["row"].take(pa.array(order))
        self.labels, self.places = np.unique(cluster[order], return_inverse=True)
        self.totals: np.ndarray | None = None

    def add(self, at: int, gaps: np.ndarray, other: _Clustered, other_at: int) -> None:
        """Adds the distances of rows from ``at`` to the rows of ``other`` from ``other_at``."""
        if self.totals is None:
            self.totals = np.zeros((len(self.points), len(other.labels)))
        met = other.places[other_at:other_at + gaps.shape[1]]
        starts = np.flatnonzero(np.r_[True, met[1:] != met[:-1]])
        self.totals[at:at + len(gaps), met[starts]] += np.add.reduceat(gaps, starts, axis=1)

    def table(self, other: _Clustered) -> pa.Table:
        """(row, cluster, other, total)."""
        width = len(other.labels) if self.totals is not None else 0
        rows = np.repeat(np.arange(len(self.points)), width)
        totals = self.totals.ravel() if width else np.zeros(0)
        return pa.table({"row": self.names.take(pa.array(rows)), "cluster": pa.array(self.labels[self.places[rows]], pa.int32()),
                         "other": pa.array(np.tile(other.labels, len(rows) // max(width, 1)), pa.int32()), "total": pa.array(totals)})


def _exact_sums(df: DataFrame, features: list[str]) -> DataFrame:
    """(row, cluster, other, total): distance of each row to all rows of each cluster, summed.

    Euclidean silhouettes need every distance; they are summed inside tasks that each hold
    two bounded groups, and only one figure per row and cluster leaves a task. A row travels once
    for each group; there are more than GROUPS only where these or their sums would get too large.
    """
    rows = df.select(F.xxhash64(*[col(f) for f in features]).alias("h"), "row", "cluster",
                     F.array(*[col(f).cast("double") for f in features]).alias("point"))
    n, clusters = rows.agg(F.count("*"), F.count_distinct("cluster")).first()
    groups = max(1, min(GROUPS, -(-n // SILHOUETTE_CHUNK)), -(-n // GROUP_ROWS), -(-n * clusters // SUMS))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row", "h"), F.lit(groups)).cast("int")).drop("h")
    pairs = df.sparkSession.range(groups).select(
        F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.col("id").cast("int"), F.lit(groups - 1))).alias("b"))
    kind = dict(dealt.dtypes)["row"]

    def sums(one: pa.Table, other: pa.Table | None) -> pa.Table:
        a = _Clustered(one)
        b = a if other is None else _Clustered(other)
        for i in range(0, len(a.points), SILHOUETTE_TILE):
            for j in range(0, len(b.points), TILE):
                gaps = _measured(a.points[i:i + SILHOUETTE_TILE], b.points[j:j + TILE])
                a.add(i, gaps, b, j)
                if b is not a:
                    b.add(j, gaps.T, a, i)
        return pa.concat_tables([a.table(b)] if b is a else [a.table(b), b.table(a)])

    partial = meet_groups(dealt, dealt, pairs, sums, f"row {kind}, cluster int, other int, total double")
    return partial.groupBy("row", "cluster", "other").agg(F.sum("total").alias("total"))


def silhouette_exact(df: DataFrame, features: list[str], key: str) -> DataFrame:
    """Mean Euclidean silhouette: one row (silhouette, metric). Work grows with rows squared."""
    rows = df.select(col(key).alias("row"), F.col("cluster").cast("int").alias("cluster"),
                     *[col(f) for f in features])
    sizes = rows.groupBy(F.col("cluster").alias("other")).agg(F.count("*").alias("size"))
    sums = _exact_sums(rows, features).join(F.broadcast(sizes), "other")   # one row per cluster
    own = F.col("other") == F.col("cluster")
    per_row = sums.groupBy("row", "cluster").agg(
        F.max(F.when(own, F.col("size"))).alias("size"),
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"))
    width = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    value = F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce(width, F.lit(0.0)))
    return per_row.agg(F.avg(F.when(F.col("b").isNotNull(), value)).alias("silhouette")) \
        .withColumn("metric", F.lit("euclidean"))


def silhouette(df: DataFrame, features: list[str], key: str | None = None,
               metric: str = SILHOUETTE_METRIC) -> DataFrame:
    """One row (silhouette, metric); null unless 2 <= clusters < rows. Noise rows are left out.

    By default of squared Euclidean distances at every size, which is linear in the rows;
    ``metric="euclidean"`` asks for plain distances, whose work grows with the rows squared.
    """
    kept = df.where(F.col("cluster") != NOISE)
    n, k = kept.agg(F.count("*"), F.count_distinct("cluster")).first()
    if not 2 <= k < n:
        return df.sparkSession.createDataFrame([(None, metric)], "silhouette double, metric string")
    if metric == "euclidean":
        if key is None:
            # rows are only told apart, so any stable name will do; copies get numbers
            named = W.partitionBy(*[col(f) for f in features]).orderBy("cluster")
            kept = kept.withColumn("_row", F.struct(F.xxhash64(*[col(f) for f in features]),
                                                    F.row_number().over(named)).cast("string"))
            key = "_row"
        return silhouette_exact(kept, features, key)
    vectors = assemble(kept, features, "_vector").withColumn("prediction", F.col("cluster").cast("double"))
    score = ClusteringEvaluator(featuresCol="_vector", predictionCol="prediction",
                                distanceMeasure="squaredEuclidean").evaluate(vectors)
    return df.sparkSession.createDataFrame([(float(score), metric)], "silhouette double, metric string")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """(cluster, size, proportion, is_noise)."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    share = F.col("size") / F.sum("size").over(W.partitionBy(F.lit(0)))     # one row per cluster
    return sizes.select("cluster", "size", share.alias("proportion"),
                        (F.col("cluster") == NOISE).alias("is_noise"))


def cluster_profile(labels: DataFrame, features: list[str], max_features: int = PROFILED_FEATURES) -> DataFrame:
    """(cluster, feature, size, proportion, mean, median, std, min, max) of the first features."""
    shown = features[:max_features]
    values = tall(labels, shown, ["cluster"])
    stats = values.groupBy("cluster", "feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    weighted = values.select("cluster", "feature", "value", F.lit(1).cast("long").alias("weight"))
    medians = (quantiles(weighted, ["cluster", "feature"], [0.5])
               .select("cluster", "feature", F.col("quantile").alias("median")))
    return (stats.join(medians, ["cluster", "feature"])
            .join(F.broadcast(cluster_sizes(labels).drop("is_noise")), "cluster")
            .select("cluster", "feature", "size", "proportion", "mean", "median", "std", "min", "max"))


def cluster_categories(labels: DataFrame, columns: list[str] | None = None,
                       max_columns: int = PROFILED_CATEGORIES) -> DataFrame:
    """(cluster, column, dominant_category, count, frequency) of the first non-numeric columns."""
    if columns is None:
        columns = [f.name for f in labels.schema.fields
                   if not is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType)
                   and not is_nested(f.dataType)][:max_columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), as_text(col(c)).alias("value")) for c in columns])
    counts = (normalize(labels).select("cluster", F.inline(pairs)).where(F.col("value").isNotNull())
              .groupBy("cluster", "column", "value").agg(F.count("*").alias("count")))
    group = W.partitionBy("cluster", "column")
    # totals from the same counts, so the rows are shuffled once
    totals = counts.groupBy("cluster", "column").agg(F.sum("count").alias("total"))
    top = (counts.withColumn("place", F.row_number().over(group.orderBy(F.desc("count"), F.asc("value"))))
           .where("place = 1"))
    return top.join(totals, ["cluster", "column"]).select(
        "cluster", "column", F.col("value").alias("dominant_category"), "count",
        (F.col("count") / F.col("total")).alias("frequency"))


def distinguishing_features(labels: DataFrame, features: list[str], top: int | None = TOP_FEATURES) -> DataFrame:
    """(feature, separation_score): spread of cluster means over the spread of all rows."""
    values = tall(labels, features, ["cluster"])
    groups = pin(values.groupBy("feature", "cluster").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var")))
    # spread of all rows from the per-cluster figures: within plus between
    overall = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    square = F.sum(F.col("n") * (F.col("var") + F.col("mean") * F.col("mean"))) / F.sum("n")
    all_rows = groups.groupBy("feature").agg(
        F.sqrt(F.greatest(square - overall * overall, F.lit(0.0))).alias("std"))
    between = (groups.where(F.col("cluster") != NOISE).groupBy("feature")
               .agg(F.var_pop("mean").alias("between"), F.count("*").alias("clusters")).where("clusters > 1"))
    scale = F.col("std") + 1e-6
    ranked = (between.join(all_rows, "feature")
              .select("feature", (F.col("between") / (scale * scale)).alias("separation_score"))
              .orderBy(F.desc("separation_score"), "feature"))
    return ranked if top is None else ranked.limit(top)
