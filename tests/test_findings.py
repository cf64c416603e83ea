import numpy as np
import pandas as pd
import pytest

from facetframe.functions.tails import correlation_p_values, incomplete_beta
from facetframe.operators import correlation as C
from facetframe.operators import findings as A
from facetframe.operators import groups as G
from facetframe.operators import trend as T
from facetframe.operators.distribution import distribution_shape
from facetframe.operators.profile import column_profile


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_p_values():
    # t densities integrated numerically beforehand; |r| = 1 is certain
    assert correlation_p_values([0.5, 1.0, 0.0], [10, 5, 10]) == pytest.approx([0.14111328, 0.0, 1.0], abs=1e-7)
    grid = np.linspace(0.01, 0.99, 25)
    assert incomplete_beta(1.0, 3.0, grid) == pytest.approx(1 - (1 - grid) ** 3, rel=1e-12)
    assert incomplete_beta(0.5, 0.5, grid) == pytest.approx(2 / np.pi * np.arcsin(np.sqrt(grid)), rel=1e-10)


def test_perfect_correlation(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(1, 6)], "x double, y double")
    got = rows(C.correlation_pairs(df))
    assert len(got) == 1
    assert (got[0]["coefficient"], got[0]["strength"], got[0]["importance"], got[0]["p_value"]) == (1.0, "very strong", "HIGH", 0.0)


def test_pairs_use_rows_where_both_are_present(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 6.0), (4.0, None), (5.0, 10.0)], "x double, y double")
    for limit in (0, 45):
        got = rows(C.correlation_pairs(df, wide_agg_pairs=limit))
        assert (got[0]["sample_size"], got[0]["coefficient"]) == (3, 1.0)


def test_constant_columns_and_caps(spark):
    df = spark.createDataFrame([(i, 2 * i, 3 * i, 4 * i, 7) for i in range(6)], "a int, b int, c int, d int, k int")
    for limit in (0, 45):
        assert C.correlation_pairs(df, max_pairs=2, wide_agg_pairs=limit).count() == 2
        assert all("k" not in (r["column_x"], r["column_y"]) for r in rows(C.correlation_pairs(df, wide_agg_pairs=limit)))
    assert C.correlation_pairs(df.select("a")).count() == 0


def test_both_paths_agree_with_numpy(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(rng.normal(1e6, 1, size=(500, 4)), columns=list("abcd"))
    frame["b"] += frame["a"]
    df = spark.createDataFrame(frame)
    r = np.corrcoef(frame["a"], frame["b"])[0, 1]
    for limit in (0, 45):
        got = [x for x in rows(C.correlation_pairs(df, wide_agg_pairs=limit)) if (x["column_x"], x["column_y"]) == ("a", "b")]
        assert got[0]["coefficient"] == pytest.approx(r, abs=1e-4)


def test_skew_classes(spark):
    df = spark.createDataFrame([(v, -v) for v in (4.0, 4.5, 5.0, 5.0, 6.0, 6.5, 7.0, 31.0, 90.0)], "right double, left double")
    got = {r["column"]: r for r in rows(distribution_shape(column_profile(df)))}
    assert got["right"]["skewness"] > 1 and "right-skewed" in got["right"]["skewness_classification"]
    assert got["left"]["skewness"] < -1 and "left-skewed" in got["left"]["skewness_classification"]


def test_category_shares(spark):
    df = spark.createDataFrame([("wool" if i < 28 else "silk" if i < 30 else "jute", "NESW"[i % 4]) for i in range(32)],
                               "fibre string, wind string")
    profile = column_profile(df)
    got = rows(G.category_concentration(profile))
    assert [(r["column"], r["dominant_share_pct"], r["importance"]) for r in got] == [("fibre", 87.5, "HIGH")]
    assert [r["column"] for r in rows(G.category_balance(profile))] == ["wind"]


def test_group_variation(spark):
    df = spark.createDataFrame([("a", 31.0), ("a", 40.0), ("a", 46.0), ("b", 70.0), ("b", 76.0), ("b", None), ("b", 79.0)],
                               "plot string, yield double")
    summary = G.group_summary(df, ["plot"], ["yield"], digits=None)
    assert {r["group_name"]: (r["count"], r["median"]) for r in rows(summary)} == {"a": (3, 40.0), "b": (3, 76.0)}
    got = rows(G.group_variation(summary))[0]
    assert (got["variation_ratio"], got["top_group"], got["importance"]) == (1.92, "b", "MEDIUM")
    assert G.group_summary(df.limit(3), ["plot"], ["yield"]).count() == 0


def test_trend_directions(spark):
    months = [f"2023-{m:02d}-01" for m in range(1, 7)]
    values = [7.5, 8.5, 6.75, 8.0, 7.25, 7.75]
    df = spark.createDataFrame([(d, 1000.0 * (i + 1), v) for i, (d, v) in enumerate(zip(months, values))],
                               "record_date string, revenue double, metric double")
    got = {r["numerical_column"]: r for r in rows(T.trends(df, column_profile(df), r2_threshold=0.5))}
    assert (got["revenue"]["direction"], got["revenue"]["importance"]) == ("increasing", "HIGH")
    # the first of the month lies in weeks of 31 or 28 days, so the line is not exact
    assert got["revenue"]["r_squared"] == pytest.approx(1.0, abs=1e-3)
    assert got["metric"]["direction"] == "stable" and got["metric"]["importance"] is None


def test_findings_are_ranked_and_unique(spark, plots):
    out = A.analyze_statistics(plots)
    got = rows(out["findings"])
    assert [(r["importance_rank"], r["finding_id"]) for r in got] == sorted((r["importance_rank"], r["finding_id"]) for r in got)
    assert len({r["finding_id"] for r in got}) == len(got)
    assert sum(r["findings"] for r in rows(A.finding_counts(out["findings"]))) == len(got)


def test_correlation_with_infinities_and_gaps(spark):
    """Both paths, on one and on several partitions: a pair with an infinity has no coefficient."""
    import math
    from facetframe.operators.correlation import correlation_pairs, pearson_sums
    data = [(float(i), float(i * i % 7), math.inf if i == 3 else 2.0 * i, None if i in (3, 9) else float(-i), 1e9 + i) for i in range(24)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double")
    tables = []
    for limit in (100, 0):
        for parts in (1, 4):
            got = correlation_pairs(df.repartition(parts), min_correlation=0.0, wide_agg_pairs=limit)
            tables.append(sorted((r.column_x, r.column_y, r.coefficient, r.sample_size) for r in got.collect()))
    assert all(t == tables[0] for t in tables)
    pairs = {t[:2]: t[2:] for t in tables[0]}
    assert ("a", "c") not in pairs and ("b", "c") not in pairs and pairs["c", "d"] == (-1.0, 22)
    assert pairs["a", "e"] == (1.0, 24) and pairs["a", "d"] == (-1.0, 22)
    assert pearson_sums(df, list("abcde"), 0).count() == 10
