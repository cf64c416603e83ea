"""Outliers, clusters, components and their figures, on the embeddings."""

from pyspark.sql import functions as F

from facetframe.operators import anomaly as A
from facetframe.operators import cluster as C
from facetframe.operators import density as D
from facetframe.operators import evaluate as E
from facetframe.operators import reduce as R
from facetframe.operators.features import expand_array
from facetframe.operators.neighbors import nearest_neighbors

from .registry import query, rounded, table

WIDTH = 64
NAMES = [f"feature_{i}" for i in range(WIDTH)]

# Squared distances of all pairs; the scalar form keeps the double precision of the features.
_POINTS = "p AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_DISTANCES = _POINTS + """,
dist AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM p a, p b WHERE a.id <> b.id)"""


def vectors(spark, sf):
    return expand_array(table(spark, sf, "embeddings"), "embedding", WIDTH)[0]


def labelled(spark, sf):
    """The embeddings with their label as a given clustering."""
    return vectors(spark, sf).withColumn("cluster", F.col("label"))


def flagged(spark, sf):
    """The embeddings with a given score: rows of label 0 are called outliers."""
    return vectors(spark, sf).withColumns({"raw_score": F.col("feature_0"), "is_anomaly": F.col("label") == 0})


@query("isolation_forest")
def _(spark, sf):
    return A.isolation_forest(vectors(spark, sf), NAMES, "vec_id").select(
        "vec_id", "raw_score", "is_anomaly", "anomaly_score")


@query("isolation_forest_share", """
SELECT floor(count(*) * 0.05)::BIGINT AS flagged, count(*) AS rows FROM orders""")
def _(spark, sf):
    # the contamination share of the rows is flagged, however many of them have equal scores
    scored = A.isolation_forest(table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("customer")),
        ["o_totalprice", "customer"], "o_orderkey", n_estimators=50, whole_share=True)
    return scored.agg(F.count_if("is_anomaly").alias("flagged"), F.count("*").alias("rows"))


@query("nearest_neighbors", f"WITH {_DISTANCES}\n" + """
SELECT a AS place, b AS neighbor, round(d, 6) AS distance FROM dist
QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5""")
def _(spark, sf):
    _, near = nearest_neighbors(vectors(spark, sf), NAMES, "vec_id", 5)
    return rounded(near.select("place", "neighbor", "distance"), 6)


@query("nearest_neighbors_in_blocks", f"WITH {_DISTANCES}\n" + """
SELECT a AS place, b AS neighbor, round(d, 6) AS distance FROM dist
QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5""")
def _(spark, sf):
    # small blocks force the search across blocks
    _, near = nearest_neighbors(vectors(spark, sf), NAMES, "vec_id", 5, block_rows=64)
    return rounded(near.select("place", "neighbor", "distance"), 6)


_LOF = """
near AS MATERIALIZED (SELECT a, b, d FROM dist QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 20),
reach AS (SELECT a, max(d) AS k FROM near GROUP BY 1),
lrd AS MATERIALIZED (SELECT n.a, 1 / (avg(greatest(n.d, r.k)) + 1e-10) AS lrd FROM near n JOIN reach r ON r.a = n.b GROUP BY 1),
lof AS (SELECT n.a, -avg(o.lrd) / any_value(m.lrd) AS s FROM near n JOIN lrd o ON o.a = n.b JOIN lrd m ON m.a = n.a GROUP BY 1),
x AS (SELECT quantile_cont(s, 0.05) AS border, min(s) AS low, max(s) AS high FROM lof)
SELECT a AS vec_id, round(s, 6) AS raw_score, s < border AS is_anomaly, round((high - s) / (high - low), 6) AS anomaly_score FROM lof, x"""


@query("local_outlier_factor", f"WITH {_DISTANCES},\n" + _LOF)
def _(spark, sf):
    return rounded(A.local_outlier_factor(vectors(spark, sf), NAMES, "vec_id"), 6)


@query("local_outlier_factor_cosine", f"""WITH {_POINTS},
dist AS MATERIALIZED (SELECT a.id AS a, b.id AS b, list_cosine_distance(a.v, b.v) AS d FROM p a, p b WHERE a.id <> b.id),""" + _LOF)
def _(spark, sf):
    return rounded(A.local_outlier_factor(vectors(spark, sf), NAMES, "vec_id", metric="cosine"), 6)


@query("nearest_neighbors_manhattan", f"""WITH {_POINTS},
l AS (SELECT id, i, v[i] AS x FROM p, range(1, 65) r(i)),
dist AS (SELECT a.id AS a, b.id AS b, sum(abs(a.x - b.x)) AS d FROM l a JOIN l b ON a.i = b.i AND a.id <> b.id GROUP BY 1, 2)
SELECT a AS place, b AS neighbor, round(d, 6) AS distance FROM dist
QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5""")
def _(spark, sf):
    _, near = nearest_neighbors(vectors(spark, sf), NAMES, "vec_id", 5, metric="manhattan")
    return rounded(near.select("place", "neighbor", "distance"), 6)


@query("normalize_scores", f"""WITH {_POINTS}
SELECT id AS vec_id, round((max(v[1]) OVER () - v[1]) / (max(v[1]) OVER () - min(v[1]) OVER ()), 6) AS anomaly_score FROM p""")
def _(spark, sf):
    return rounded(A.normalize_scores(vectors(spark, sf), "feature_0").select("vec_id", "anomaly_score"), 6)


@query("score_summary", f"""WITH {_POINTS}, s AS (SELECT v[1] AS raw, label = 0 AS odd,
  (max(v[1]) OVER () - v[1]) / (max(v[1]) OVER () - min(v[1]) OVER ()) AS score FROM p)
SELECT count(*) AS rows, count_if(odd) AS n_anomalies, round(count_if(odd) / count(*) * 100, 6) AS anomaly_percentage,
  round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean, round(median(score), 6) AS median,
  round(min(raw), 6) AS raw_min, round(max(raw), 6) AS raw_max FROM s""")
def _(spark, sf):
    return rounded(A.score_summary(A.normalize_scores(flagged(spark, sf), "raw_score")), 6)


_LONG = _POINTS + ", l AS (SELECT id, label, 'feature_' || (i - 1) AS feature, v[i] AS x FROM p, range(1, 65) r(i))"


@query("anomaly_contribution", f"""WITH {_LONG},
m AS (SELECT feature, avg(x) AS mean, stddev_pop(x) + 1e-6 AS w FROM l WHERE label <> 0 GROUP BY 1),
d AS (SELECT feature, avg(abs(x - mean) / w) AS away FROM l JOIN m USING (feature) WHERE label = 0 GROUP BY 1)
SELECT feature, round(away / sum(away) OVER (), 6) AS contribution FROM d""")
def _(spark, sf):
    return rounded(A.anomaly_contribution(flagged(spark, sf), NAMES), 6)


@query("kmeans")
def _(spark, sf):
    return C.kmeans(vectors(spark, sf), NAMES, 3).labels.select("vec_id", "cluster")


@query("kmeans_separated", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS cluster
FROM (SELECT *, 0 AS z FROM orders)""")
def _(spark, sf):
    # four far places, so the best clustering is known whatever the start
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    place = F.when(level <= 3, level).otherwise(4)
    df = table(spark, sf, "orders").select(
        "o_orderkey", (place * 1000 + F.col("o_totalprice") / 1e6).alias("x"),
        (place * place * 500 + F.col("o_custkey") / 1e5).alias("y"), place.alias("place"))
    labels = C.kmeans(df, ["x", "y"], 4, n_init=5).labels
    # numbered by place instead of size to compare with the known grouping
    first = labels.groupBy("cluster").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    return (labels.join(F.broadcast(first), "cluster")
            .select("o_orderkey", F.when(F.col("a") == F.col("b"), F.col("a") - 1).otherwise(-1).alias("cluster")))


@query("auto_k")
def _(spark, sf):
    # every k from 2 to 8, the best of ten runs for each
    return C.auto_k(vectors(spark, sf), NAMES)


@query("elbow")
def _(spark, sf):
    return C.elbow(C.auto_k(vectors(spark, sf), NAMES, max_k=6, n_init=2, metric="squared_euclidean"))


@query("elbow_of_orders", """
WITH t AS (SELECT l_linenumber AS k, round(sum(l_extendedprice), 2) AS inertia FROM lineitem GROUP BY 1),
b AS (SELECT k, inertia, (lag(inertia) OVER w - inertia) - (inertia - lead(inertia) OVER w) AS bend FROM t WINDOW w AS (ORDER BY k))
SELECT k, round(inertia, 2) AS inertia, round(bend, 2) AS bend FROM b WHERE bend IS NOT NULL ORDER BY b.bend DESC, k LIMIT 1""")
def _(spark, sf):
    # money by line number falls like an inertia: fewer orders have more lines
    falling = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("inertia"))
    return rounded(C.elbow(falling), 2)


_SILHOUETTE = """
t AS (SELECT d.a, pa.label AS own, pb.label AS other, sum({gap}) AS total FROM dist d
  JOIN p pa ON pa.id = d.a JOIN p pb ON pb.id = d.b GROUP BY ALL),
n AS (SELECT label, count(*) AS n FROM p GROUP BY 1),
s AS (SELECT a, own, max(CASE WHEN own = other THEN total / (n - 1) END) AS x, min(CASE WHEN own <> other THEN total / n END) AS y,
  any_value(CASE WHEN own = other THEN n END) AS size FROM t JOIN n ON n.label = t.other GROUP BY 1, 2)
SELECT round(avg(CASE WHEN size IS NULL OR size = 1 THEN 0 ELSE (y - x) / greatest(x, y) END), 6) AS silhouette, '{metric}' AS metric FROM s"""


@query("silhouette", f"WITH {_DISTANCES}," + _SILHOUETTE.format(gap="d", metric="euclidean"))
def _(spark, sf):
    return rounded(C.silhouette(labelled(spark, sf), NAMES, "vec_id", "euclidean"), 6)


@query("silhouette_squared", f"WITH {_DISTANCES}," + _SILHOUETTE.format(gap="d * d", metric="squared_euclidean"))
def _(spark, sf):
    return rounded(C.silhouette(labelled(spark, sf), NAMES, "vec_id", "squared_euclidean"), 6)


# DBSCAN in SQL: core rows, reachability by recursion, border rows to the first cluster.
def _dbscan_sql(points: str, near: str, key: str, core: int) -> str:
    return f"""WITH RECURSIVE {points},
pairs AS MATERIALIZED ({near}),
core AS MATERIALIZED (SELECT a FROM pairs GROUP BY a HAVING count(*) >= {core}),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
walk(a, b) AS (SELECT a, a FROM core UNION SELECT w.a, l.b FROM walk w JOIN links l ON l.a = w.b),
roots AS (SELECT a, min(b) AS root FROM walk GROUP BY a),
numbers AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM roots)),
labels AS (SELECT a, cluster FROM roots JOIN numbers USING (root)),
border AS (SELECT p.a, min(l.cluster) AS cluster FROM pairs p JOIN labels l ON l.a = p.b WHERE p.a NOT IN (SELECT a FROM core) GROUP BY 1)
SELECT q.id AS {key}, coalesce(l.cluster, b.cluster, -1)::INTEGER AS cluster, l.a IS NOT NULL AS is_core
FROM p q LEFT JOIN labels l ON l.a = q.id LEFT JOIN border b ON b.a = q.id"""


@query("dbscan", _dbscan_sql(
    _POINTS, "SELECT a.id AS a, b.id AS b FROM p a, p b WHERE list_distance(a.v, b.v) <= 0.8", "vec_id", 5))
def _(spark, sf):
    return D.dbscan(vectors(spark, sf), NAMES, "vec_id", 0.8, 5)


@query("dbscan_plane", _dbscan_sql(
    """p AS MATERIALIZED (SELECT s_suppkey AS id, s_acctbal / 500 AS x, s_nationkey::DOUBLE AS y FROM supplier)""",
    "SELECT a.id AS a, b.id AS b FROM p a, p b WHERE sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) <= 2.5", "s_suppkey", 6))
def _(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 500).alias("x"),
                                             F.col("s_nationkey").cast("double").alias("y"))
    return D.dbscan(df, ["x", "y"], "s_suppkey", 2.5, 6)


@query("dbscan_cosine", _dbscan_sql(
    _POINTS, "SELECT a.id AS a, b.id AS b FROM p a, p b WHERE list_cosine_distance(a.v, b.v) <= 0.66", "vec_id", 4))
def _(spark, sf):
    return D.dbscan(vectors(spark, sf), NAMES, "vec_id", 0.66, 4, metric="cosine")


@query("dbscan_plane_chebyshev", _dbscan_sql(
    """p AS MATERIALIZED (SELECT s_suppkey AS id, s_acctbal / 500 AS x, s_nationkey::DOUBLE AS y FROM supplier)""",
    "SELECT a.id AS a, b.id AS b FROM p a, p b WHERE greatest(abs(a.x - b.x), abs(a.y - b.y)) <= 1.5", "s_suppkey", 6))
def _(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 500).alias("x"),
                                             F.col("s_nationkey").cast("double").alias("y"))
    return D.dbscan(df, ["x", "y"], "s_suppkey", 1.5, 6, metric="chebyshev")


@query("dbscan_crowded", """
SELECT count(*) AS rows, count(DISTINCT l_quantity) AS n_clusters, 0::BIGINT AS noise_count FROM lineitem""")
def _(spark, sf):
    # few places with very many copies each: every place is its own cluster
    df = table(spark, sf, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").cast("string")
        .alias("row"), "l_quantity")
    return D.noise_summary(D.dbscan(df, ["l_quantity"], "row", 0.5, 5)).drop("noise_percentage")


@query("cluster_sizes", """
SELECT label AS cluster, count(*) AS size, round(count(*) / sum(count(*)) OVER (), 6) AS proportion, label = -1 AS is_noise
FROM embeddings GROUP BY 1""")
def _(spark, sf):
    return rounded(C.cluster_sizes(labelled(spark, sf)), 6)


@query("cluster_profile", f"""WITH {_LONG}
SELECT label AS cluster, feature, count(*) AS size, round(count(*) / (SELECT count(*) FROM p), 6) AS proportion, round(avg(x), 6) AS mean,
  round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max
FROM l WHERE feature IN ({", ".join(f"'{n}'" for n in NAMES[:25])}) GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(C.cluster_profile(labelled(spark, sf), NAMES), 6)


@query("cluster_categories", """
SELECT cluster, c AS "column", value AS dominant_category, n AS count, round(n / total, 6) AS frequency FROM (
  SELECT *, sum(n) OVER (PARTITION BY cluster, c) AS total, row_number() OVER (PARTITION BY cluster, c ORDER BY n DESC, value) AS place
  FROM (SELECT l_linenumber AS cluster, 'l_returnflag' AS c, nullif(l_returnflag, 'A') AS value, count(*) AS n FROM lineitem GROUP BY 1, 2, 3
        UNION ALL SELECT l_linenumber, 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 1, 2, 3)
  WHERE value IS NOT NULL) WHERE place = 1""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("cluster"), "l_quantity",
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus")
    return rounded(C.cluster_categories(df), 6)


@query("distinguishing_features", f"""WITH {_LONG},
m AS (SELECT feature, label, avg(x) AS mean FROM l GROUP BY 1, 2),
s AS (SELECT feature, var_pop(mean) AS between_var FROM m GROUP BY 1), w AS (SELECT feature, stddev_pop(x) + 1e-6 AS std FROM l GROUP BY 1)
SELECT feature, round(between_var / (std * std), 6) AS separation_score FROM s JOIN w USING (feature) ORDER BY between_var / (std * std) DESC LIMIT 5""")
def _(spark, sf):
    return rounded(C.distinguishing_features(labelled(spark, sf), NAMES), 6)


@query("pca")
def _(spark, sf):
    return R.pca(vectors(spark, sf), NAMES, 2).projected.select("vec_id", "pc1", "pc2")


# For two features the components have a closed form.
_PLANE = """v AS (SELECT var_samp(l_quantity) AS a, var_samp(l_discount * 100) AS b, covar_samp(l_quantity, l_discount * 100) AS c,
  avg(l_quantity) AS ma, avg(l_discount * 100) AS mb FROM lineitem),
e AS (SELECT *, (a + b) / 2 + sqrt(((a - b) / 2) ^ 2 + c * c) AS l1, (a + b) / 2 - sqrt(((a - b) / 2) ^ 2 + c * c) AS l2 FROM v),
u AS (SELECT *, (l1 - b) / sqrt((l1 - b) ^ 2 + c * c) AS wx, c / sqrt((l1 - b) ^ 2 + c * c) AS wy FROM e)"""


def plane(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), (F.col("l_discount") * 100).alias("discount"))


@query("pca_explained", f"""WITH {_PLANE}
SELECT 'PC1' AS component, round(l1 / (l1 + l2), 6) AS explained_variance_ratio, round(l1 / (l1 + l2), 6) AS cumulative FROM u
UNION ALL SELECT 'PC2', round(l2 / (l1 + l2), 6), 1.0 FROM u""")
def _(spark, sf):
    return rounded(R.pca(plane(spark, sf), ["quantity", "discount"]).explained(spark), 6)


@query("pca_loadings", f"""WITH {_PLANE}
SELECT 'PC1' AS component, 'quantity' AS feature, round(wx, 6) AS loading FROM u UNION ALL SELECT 'PC1', 'discount', round(wy, 6) FROM u
UNION ALL SELECT 'PC2', 'quantity', round(-wy, 6) FROM u UNION ALL SELECT 'PC2', 'discount', round(wx, 6) FROM u""")
def _(spark, sf):
    return rounded(R.pca(plane(spark, sf), ["quantity", "discount"]).loading_table(spark), 6)


@query("pca_projection", f"""WITH {_PLANE}
SELECT l_orderkey, l_linenumber, round((l_quantity - ma) * wx + (l_discount * 100 - mb) * wy, 4) + 0.0 AS pc1 FROM lineitem, u""")
def _(spark, sf):
    return rounded(R.pca(plane(spark, sf), ["quantity", "discount"], 1).projected, 4).select(
        "l_orderkey", "l_linenumber", "pc1")


@query("top_loadings")
def _(spark, sf):
    return R.top_loadings(R.pca(vectors(spark, sf), NAMES, 2).loading_table(spark))


def given_models(spark, sf):
    """Evaluation of a given clustering (labels), given flags, and the plane's components."""
    summary = A.score_summary(A.normalize_scores(flagged(spark, sf), "raw_score"))
    sizes = C.cluster_sizes(labelled(spark, sf))
    silhouette = C.silhouette(labelled(spark, sf), NAMES, "vec_id", "squared_euclidean")
    explained = R.pca(plane(spark, sf), ["quantity", "discount"], 1).explained(spark)
    return E.ml_evaluation(summary, sizes, silhouette, explained)


_EVALUATION = f"""WITH {_DISTANCES}, {_PLANE}, sil AS (WITH {_SILHOUETTE.format(gap="d * d", metric="x")}),
scores AS (SELECT (max(v[1]) OVER () - v[1]) / (max(v[1]) OVER () - min(v[1]) OVER ()) AS s, label = 0 AS odd FROM p),
ev AS (SELECT 'anomaly_count' AS metric, count_if(odd)::DOUBLE AS value, NULL::VARCHAR AS reason FROM scores
UNION ALL SELECT 'anomaly_percentage', count_if(odd) / count(*) * 100, NULL FROM scores
UNION ALL SELECT 'anomaly_mean_score', avg(s), NULL FROM scores
UNION ALL SELECT 'cluster_count', count(DISTINCT label), NULL FROM p
UNION ALL SELECT 'cluster_silhouette', silhouette, NULL FROM sil
UNION ALL SELECT 'cluster_inertia', NULL, 'only defined for k-means'
UNION ALL SELECT 'noise_percentage', 0.0, NULL
UNION ALL SELECT 'pca_variance_top2', l1 / (l1 + l2), NULL FROM u
UNION ALL SELECT 'pca_cumulative_variance', l1 / (l1 + l2), NULL FROM u)
"""


@query("ml_evaluation", _EVALUATION + "SELECT metric, round(value, 5) AS value, reason FROM ev")
def _(spark, sf):
    return rounded(given_models(spark, sf), 5)


@query("ml_findings", _EVALUATION + """
SELECT 'ML_ANOMALY_ISOLATION_FOREST' AS finding_id, CASE WHEN value >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS importance
FROM ev WHERE metric = 'anomaly_percentage' AND value > 0
UNION ALL SELECT 'ML_CLUSTER_KMEANS', CASE WHEN value >= 0.45 THEN 'HIGH' ELSE 'MEDIUM' END FROM ev WHERE metric = 'cluster_silhouette'
UNION ALL SELECT 'ML_PCA_VARIANCE', CASE WHEN value >= 0.6 THEN 'HIGH' ELSE 'INFO' END FROM ev WHERE metric = 'pca_variance_top2'""")
def _(spark, sf):
    return E.ml_findings(given_models(spark, sf)).select("finding_id", "importance")


@query("ml_points", f"""WITH {_POINTS}
SELECT id AS vec_id, round(v[1] + v[2], 6) AS pc1, label = 0 AS is_anomaly,
  round((max(v[1]) OVER () - v[1]) / (max(v[1]) OVER () - min(v[1]) OVER ()), 6) AS anomaly_score, label AS cluster FROM p""")
def _(spark, sf):
    projected = vectors(spark, sf).withColumn("pc1", F.col("feature_0") + F.col("feature_1"))
    scored = A.normalize_scores(flagged(spark, sf), "raw_score")
    return rounded(E.ml_points(projected, scored, labelled(spark, sf), "vec_id"), 6)


@query("scree_table", f"""WITH {_PLANE}
SELECT 'PC1' AS component, round(l1 / (l1 + l2), 6) AS explained_variance_ratio, round(l1 / (l1 + l2), 6) AS cumulative FROM u""")
def _(spark, sf):
    return rounded(E.scree_table(R.pca(plane(spark, sf), ["quantity", "discount"], 1).explained(spark)), 6)


@query("cluster_bars", """
SELECT 'Cluster ' || label AS label, count(*) AS size, round(count(*) / sum(count(*)) OVER (), 6) AS proportion FROM embeddings GROUP BY label""")
def _(spark, sf):
    return rounded(E.cluster_bars(C.cluster_sizes(labelled(spark, sf))), 6)


@query("cluster_means", f"""WITH {_LONG}
SELECT 'Cluster ' || label AS label, feature, round(avg(x), 6) AS mean FROM l WHERE feature IN ('feature_0', 'feature_1', 'feature_2') GROUP BY l.label, 2""")
def _(spark, sf):
    return rounded(E.cluster_means(C.cluster_profile(labelled(spark, sf), NAMES, 3)), 6)


@query("score_histogram", f"""WITH {_POINTS},
s AS (SELECT (max(v[1]) OVER () - v[1]) / (max(v[1]) OVER () - min(v[1]) OVER ()) AS s FROM p)
SELECT least(floor(s * 20), 19)::INTEGER AS bin, round(least(floor(s * 20), 19) / 20, 6) AS low,
  round((least(floor(s * 20), 19) + 1) / 20, 6) AS high, count(*) AS rows FROM s GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rounded(E.score_histogram(A.normalize_scores(flagged(spark, sf), "raw_score")), 6)
