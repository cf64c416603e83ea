import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetframe.operators import anomaly as A
from facetframe.operators import cluster as C
from facetframe.operators import density as D
from facetframe.operators import evaluate as E
from facetframe.operators import neighbors as N
from facetframe.operators import reduce as R
from facetframe.plans.analyze import ModelConfig, analyze
from facetframe.session import cut_lineage


def frame(spark, x, names="abcdefgh"):
    return spark.createDataFrame(pd.DataFrame(x, columns=list(names[:x.shape[1]])).assign(id=np.arange(len(x))))


def gaps(x, metric="euclidean"):
    apart = np.abs(x[:, None] - x[None])
    if metric == "manhattan":
        return apart.sum(-1)
    if metric == "chebyshev":
        return apart.max(-1)
    if metric == "cosine":
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return 1 - unit @ unit.T
    return np.sqrt((apart ** 2).sum(-1))


@pytest.fixture(scope="module")
def copies():
    """Points with thirty copies of one place, a third of a small neighbourhood."""
    x = np.round(np.random.default_rng(1).normal(size=(150, 3)), 2)
    x[50:80] = x[0]
    return x


@pytest.fixture(scope="module")
def outliers():
    rng = np.random.default_rng(7)
    return np.vstack([rng.normal(size=(50, 4)), rng.uniform(10, 15, size=(5, 4))])


@pytest.mark.parametrize("block_rows", [None, 30])
def test_neighbors_match_brute_force(spark, copies, block_rows):
    d = gaps(copies)
    np.fill_diagonal(d, np.inf)
    keys, near = N.nearest_neighbors(frame(spark, copies), list("abc"), "id", 6, block_rows)
    got = near.toPandas().groupby("place").agg(d=("distance", "max"), n=("copies", "sum"))
    places = keys.toPandas().set_index("id")["place"]
    assert (got["n"] == 6).all()
    assert got.loc[places.sort_index(), "d"].to_numpy() == pytest.approx(np.sort(d, axis=1)[:, 5])


def lof(x, k, metric="euclidean"):
    d = gaps(x, metric)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    reach = np.take_along_axis(d, order, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, order, 1), reach[order]).mean(axis=1) + 1e-10)
    return -lrd[order].mean(axis=1) / lrd


def test_local_outlier_factor_matches_brute_force(spark, outliers):
    got = A.local_outlier_factor(frame(spark, outliers), list("abcd"), "id", 10, 0.1, block_rows=40).toPandas().sort_values("id")
    assert got["raw_score"].to_numpy() == pytest.approx(lof(outliers, 10))
    assert got["is_anomaly"].any() and got["anomaly_score"].between(0, 1).all()


@pytest.mark.parametrize("metric", ["manhattan", "chebyshev", "cosine"])
def test_local_outlier_factor_in_other_metrics(spark, outliers, metric):
    got = A.local_outlier_factor(frame(spark, outliers), list("abcd"), "id", 7, 0.1, 8, metric).toPandas().sort_values("id")
    assert got["raw_score"].to_numpy() == pytest.approx(lof(outliers, 7, metric), rel=1e-6)


def test_clustered_places_meet_few_others(spark):
    # forty clusters in thirty dimensions: most pairs are excluded by the pivots
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 30))[rng.integers(0, 40, 1200)] + rng.normal(scale=0.03, size=(1200, 30))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, v array<double>")
    df = df.select("id", *[df.v[i].alias(f"f{i}") for i in range(30)])
    names = [f"f{i}" for i in range(30)]
    _, places = N.collapse(df, names, "id")
    blocks = N.Blocks(places, "euclidean", 32)
    visits = N._visits(blocks, cut_lineage(N._own(blocks, 5)), 5)
    sizes = blocks.placed.groupBy(blocks.placed.block.alias("near_block")).count()
    pairs = visits.join(sizes, "near_block").agg({"count": "sum"}).first()[0]
    assert pairs < 1200 * 1200 / 4
    _, near = N.nearest_neighbors(df, names, "id", 5, 32)
    d = gaps(x)
    np.fill_diagonal(d, np.inf)
    got = near.toPandas().groupby("place")["distance"].max()
    assert got.to_numpy() == pytest.approx(np.sort(d, axis=1)[:, 4])


def test_metric_space_edges(spark):
    with pytest.raises(ValueError):
        N.nearest_neighbors(frame(spark, np.zeros((3, 2))), ["a", "b"], "id", 1, metric="angle")
    # rows without direction are alike and at distance 1 from all others
    x = np.array([[0.0, 0.0], [0.0, -0.0], [2.0, 0.0], [1.0, 0.0], [0.0, 3.0]])
    keys, near = N.nearest_neighbors(frame(spark, x), ["a", "b"], "id", 4, metric="cosine")
    got = {(r.place, r.neighbor): (round(r.distance, 9), r.copies) for r in near.collect()}
    assert got[(0, 0)] == (0.0, 1) and got[(0, 2)] == (1.0, 2) and got[(2, 4)] == (1.0, 1)
    # fewer rows than neighbours, and none at all
    _, few = N.nearest_neighbors(frame(spark, x[2:]), ["a", "b"], "id", 9)
    assert few.agg({"copies": "sum"}).first()[0] == 6
    assert N.nearest_neighbors(frame(spark, x).limit(0), ["a", "b"], "id", 2)[1].count() == 0
    none = D.dbscan(frame(spark, x).limit(0), ["a", "b"], "id", metric="manhattan")
    assert none.count() == 0


def dbscan(x, eps, least, metric="euclidean"):
    near = gaps(x, metric) <= eps
    core = near.sum(axis=1) >= least
    labels, cluster = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        stack, labels[i] = [i], cluster
        while stack:
            for j in np.flatnonzero(near[stack.pop()]):
                if labels[j] < 0:
                    labels[j] = cluster
                    if core[j]:
                        stack.append(j)
        cluster += 1
    return labels, core


@pytest.mark.parametrize("eps, least, block_rows", [(0.4, 5, 512), (0.7, 8, 20)])
def test_dbscan_matches_brute_force(spark, copies, eps, least, block_rows):
    got = D.dbscan(frame(spark, copies), list("abc"), "id", eps, least, block_rows).toPandas().sort_values("id")
    labels, core = dbscan(copies, eps, least)
    assert (got["cluster"].to_numpy() == labels).all()
    assert (got["is_core"].to_numpy() == core).all()


@pytest.mark.parametrize("metric, eps, least, block_rows, grid", [
    ("euclidean", 0.7, 8, 20, 0), ("manhattan", 0.9, 6, 20, 4), ("chebyshev", 0.4, 5, 512, 4), ("cosine", 0.021, 4, 16, 4)])
def test_dbscan_by_pivots_matches_brute_force(spark, copies, monkeypatch, metric, eps, least, block_rows, grid):
    monkeypatch.setattr(D, "GRID_WIDTH", grid)
    got = D.dbscan(frame(spark, copies), list("abc"), "id", eps, least, block_rows, metric).toPandas().sort_values("id")
    labels, core = dbscan(copies, eps, least, metric)
    assert (got["cluster"].to_numpy() == labels).all()
    assert (got["is_core"].to_numpy() == core).all()


def test_dbscan_splits_crowded_cells(spark, monkeypatch):
    # more places per cell than one task takes, and dense cells just out of reach of each other
    monkeypatch.setattr(D, "CELL_CHUNK", 8)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.uniform(0, 0.3, (60, 2)), rng.uniform(0, 0.3, (60, 2)) + [0.95, 0], [[0.6, 0.1]]])
    got = D.dbscan(frame(spark, x), ["a", "b"], "id", 0.5, 5).toPandas().sort_values("id")
    labels, _ = dbscan(x, 0.5, 5)
    assert (got["cluster"].to_numpy() == labels).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in D.connected_components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100


def test_isolation_forest(spark, outliers):
    df = frame(spark, outliers)
    runs = [A.isolation_forest(df, list("abcd"), "id", 0.1, 50).toPandas().sort_values("id") for _ in range(2)]
    assert (runs[0]["anomaly_score"].to_numpy() == runs[1]["anomaly_score"].to_numpy()).all()
    assert 0.05 <= runs[0]["is_anomaly"].mean() <= 0.15
    assert runs[0]["anomaly_score"][50:].mean() > runs[0]["anomaly_score"][:50].mean() + 0.3
    assert not A.isolation_forest(df.limit(1), list("abcd"), "id").first().is_anomaly


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(2)
    return np.vstack([rng.normal(c, 0.3, size=(30, 2)) for c in ((0, 0), (5, 5), (0, 6))])


def exact_silhouette(x, labels):
    d, out = gaps(x), []
    for i in range(len(x)):
        own = labels == labels[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_kmeans_and_silhouette(spark, blobs):
    df = frame(spark, blobs)
    fitted = C.kmeans(df, ["a", "b"], 3, n_init=3)
    got = fitted.labels.toPandas().sort_values("id")
    assert [len(set(got["cluster"][i:i + 30])) for i in (0, 30, 60)] == [1, 1, 1]
    assert C.silhouette(fitted.labels, ["a", "b"]).first().metric == "squared_euclidean"
    score = C.silhouette(fitted.labels, ["a", "b"], "id", "euclidean").first()
    assert score.silhouette > 0.6 and score.metric == "euclidean"
    assert score.silhouette == pytest.approx(exact_silhouette(blobs, got["cluster"].to_numpy()))
    assert C.silhouette(fitted.labels, ["a", "b"], metric="euclidean").first().silhouette == pytest.approx(score.silhouette)
    assert C.silhouette(fitted.labels.withColumn("cluster", fitted.labels.cluster * 0), ["a", "b"], "id").first().silhouette is None


def test_auto_k_finds_three(spark, blobs):
    table = C.auto_k(frame(spark, blobs), ["a", "b"], max_k=5, n_init=2)
    assert table.where("selected").first().k == 3
    assert C.elbow(table).first().k == 3


def test_pca(spark):
    x = np.random.default_rng(6).normal(size=(50, 5)) * [5, 3, 1, 1, 1]
    out = R.pca(frame(spark, x), list("abcde"), 2)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert out.ratios == pytest.approx(list(values[:2] / values.sum()))
    got = out.projected.toPandas().sort_values("id")
    assert got["pc1"].mean() == pytest.approx(0, abs=1e-9) and got["pc1"].var() == pytest.approx(values[0])
    assert len(R.pca(frame(spark, x[:10, :3]), list("abc"), 10).ratios) == 3
    assert not R.pca(frame(spark, x[:1]), list("abcde")).completed


def test_undefined_metrics_carry_a_reason(spark):
    summary = spark.createDataFrame([(1, 2.0, 0.5)], "n_anomalies long, anomaly_percentage double, mean double")
    sizes = spark.createDataFrame([(0, 10)], "cluster int, size long")
    silhouette = spark.createDataFrame([(None,)], "silhouette double")
    explained = spark.createDataFrame([("PC1", 0.7, 0.7)], "component string, explained_variance_ratio double, cumulative double")
    table = E.ml_evaluation(summary, sizes, silhouette, explained)
    got = {r.metric: (r.value, r.reason) for r in table.collect()}
    assert got["cluster_silhouette"][0] is None and got["cluster_silhouette"][1]
    assert got["pca_variance_top2"] == (0.7, None)
    found = {r.finding_id: r.importance for r in E.ml_findings(table).collect()}
    assert found == {"ML_ANOMALY_ISOLATION_FOREST": "MEDIUM", "ML_PCA_VARIANCE": "HIGH"}


@pytest.mark.parametrize("config", [
    ModelConfig(n_estimators=20, n_init=2), ModelConfig(anomaly="local_outlier_factor", clustering="dbscan", eps=3.0, metric="manhattan")])
def test_whole_cascade(spark, plots, config):
    keyed = plots.dropDuplicates().rdd.zipWithIndex().map(lambda p: (*p[0], p[1]))
    df = spark.createDataFrame(keyed, "plot_id string, kind string, age int, annual_rent double, place string, "
                                      "opened string, is_leased boolean, row_key long")
    out = analyze(df, key="row_key", config=config)
    assert out["points"].count() == 7
    assert out["overview"].count() == 1
    assert {"column", "issue", "finding"} <= {r.section for r in out["evidence"].collect()}
    assert out["evaluation"].where("metric = 'anomaly_count'").first().value is not None


def test_rows_travel_once_for_each_group(spark):
    # directions that fill space alike: every block is close to every other, whatever the pivots
    x = np.random.default_rng(3).normal(size=(600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = frame(spark, x, "abcdefghijkl").selectExpr("*", "concat('k', 1000 + id) AS name")
    _, places = N.collapse(df, list("abcdefghijkl"), "name")
    blocks = N.Blocks(places, "euclidean", 4)
    sizes = blocks.placed.groupBy("group").count().toPandas()["count"]
    assert len(sizes) == blocks.groups == 16 and sizes.max() - sizes.min() <= 1
    assert blocks.pairs(F.lit(9.0)).count() == 16 * 17 // 2
    # a place met 150 blocks before; now a row is sent to 16 tasks
    _, near = N.nearest_neighbors(df, list("abcdefghijkl"), "name", 5, 4)
    d = gaps(x)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :5]
    got = near.orderBy("place", "distance").toPandas()
    assert got["neighbor"].tolist() == [f"k{1000 + i}" for i in order.ravel()]
    assert got["distance"].to_numpy() == pytest.approx(np.take_along_axis(d, order, 1).ravel())


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_wide_reach_is_narrowed_to_the_nearest(metric):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(90, 5)), rng.normal(size=(700, 5))
    d = np.abs(a[:, None] - b[None]).sum(-1) if metric == "manhattan" else np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    i, j, far = N._in_reach(a, b, np.full(90, np.inf), np.full(700, np.inf), 3, metric)
    assert len(i) <= 3 * (90 + 700) and far == pytest.approx(d[i, j])
    met = set(zip(i.tolist(), j.tolist()))
    assert all((r, c) in met for r in range(90) for c in np.argsort(d[r])[:3])
    assert all((r, c) in met for c in range(700) for r in np.argsort(d[:, c])[:3])


def test_isolation_forest_flags_the_whole_share_of_equal_rows(spark):
    # forty rows in copies of thirty: a border lies among equal scores
    x = np.repeat(np.random.default_rng(6).normal(size=(40, 2)), 30, axis=0)
    got = A.isolation_forest(frame(spark, x), ["a", "b"], "id", 0.05, 20, whole_share=True).toPandas()
    odd = got[got["is_anomaly"]]
    assert len(odd) == 60 and got.loc[~got["is_anomaly"], "raw_score"].min() >= odd["raw_score"].max()
    ten = A.isolation_forest(frame(spark, x), ["a", "b"], "id", 0.01, 20, whole_share=True).toPandas()
    odd = ten[ten["is_anomaly"]].sort_values("id")["id"].tolist()
    assert odd == list(range(odd[0], odd[0] + 12)) and odd[0] % 30 == 0      # 12 of 30 equal rows, by key


def test_silhouette_of_close_rows_over_groups(spark, monkeypatch):
    # rows a millionth apart and far from zero, in several groups of several tiles
    monkeypatch.setattr(C, "SILHOUETTE_CHUNK", 20)
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(scale=1e-6, size=(60, 3)) + 50.0, rng.normal(scale=1e-6, size=(60, 3)) + 50.0 + 2e-6]
    df = frame(spark, x).withColumn("cluster", (F.col("id") % 3).cast("int") + F.when(F.col("id") < 60, 0).otherwise(1))
    labels = np.arange(120) % 3 + (np.arange(120) >= 60)
    d = gaps(x)
    sums = np.stack([d[:, labels == c].sum(axis=1) for c in range(4)], axis=1)
    size = np.bincount(labels)
    own = sums[np.arange(120), labels] / (size[labels] - 1)
    mean = sums / size
    mean[np.arange(120), labels] = np.inf
    other = mean.min(axis=1)
    got = C.silhouette(df, list("abc"), "id", "euclidean").first().silhouette
    assert got == pytest.approx(((other - own) / np.maximum(own, other)).mean(), rel=1e-9)
    assert C._exact_sums(df.select(F.col("id").alias("row"), "cluster", "a", "b", "c"), list("abc")).count() == 120 * 4


def test_runs_of_kmeans_move_in_the_same_scans(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    from facetframe.operators import centroids
    x = np.random.default_rng(8).normal(size=(400, 3)) + [1e4, 0.0, -50.0]
    scans = []
    scan = centroids.Points.scan
    monkeypatch.setattr(centroids.Points, "scan", lambda self, *a: scans.append(1) or scan(self, *a))
    monkeypatch.setattr(centroids, "BLOCK_BYTES", 24 * 50)
    wanted = [(k, s) for k in (2, 4) for s in (42, 43)]
    with centroids.points_of(frame(spark, x).coalesce(1), list("abc")) as points:
        assert points.vectors.rdd.getNumPartitions() == 2                 # the cores of this session, whatever the reader's splits
        given = [KMeans(k=k, seed=s, maxIter=300, tol=1e-4).fit(points.vectors) for k, s in wanted]
        runs = points.fit(wanted, 300)
        # each scan serves all runs: as many as the longest run has steps, and one for the figures
        assert len(scans) <= max(m.summary.numIter for m in given) + 2
        scores = points.silhouettes(runs)
    for run, model in zip(runs, given):
        assert run.centres == pytest.approx(np.array(model.clusterCenters()), abs=1e-6)
        assert sorted(run.sizes) == sorted(model.summary.clusterSizes)
        assert run.inertia == pytest.approx(model.summary.trainingCost, rel=1e-3)
    labels = C._labelled(frame(spark, x), list("abc"), points, runs[0]).labels
    assert [r["count"] for r in labels.groupBy("cluster").count().orderBy("cluster").collect()] == sorted(runs[0].sizes)[::-1]
    assert scores[0] == pytest.approx(C.silhouette(labels, list("abc")).first().silhouette, abs=1e-6)


def test_auto_k_of_equal_rows(spark):
    table = C.auto_k(frame(spark, np.ones((6, 2))), ["a", "b"], max_k=3, n_init=2)
    assert [(r.k, r.inertia, r.silhouette) for r in table.collect()] == [(2, 0.0, None), (3, 0.0, None)]


def test_query_auto_k_tries_every_k_from_ten_starts(spark, tmp_path, monkeypatch):
    from catalog import QUERIES
    from facetframe.operators import centroids
    asked = []
    fit = centroids.Points.fit
    monkeypatch.setattr(centroids.Points, "fit", lambda self, wanted, n: asked.append((wanted, n)) or fit(self, wanted, n))
    # eight far groups, so only a search that goes up to eight finds them
    place = np.repeat(np.arange(8), 6)
    x = 50.0 * np.eye(64)[place] + np.random.default_rng(12).normal(size=(48, 64))
    spark.createDataFrame([(i, v.tolist(), int(p)) for i, (v, p) in enumerate(zip(x, place))],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    table = QUERIES["auto_k"](spark, str(tmp_path)).orderBy("k").collect()
    assert [r.k for r in table] == list(range(2, 9)) and [r.k for r in table if r.selected] == [8]
    assert asked == [([(k, 42 + i) for k in range(2, 9) for i in range(10)], 300)]
