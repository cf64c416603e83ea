import numpy as np
import pandas as pd
import pytest

from facetframe.operators import extensions as X


def test_rank_correlation_with_ties(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"x": rng.integers(0, 8, 300).astype(float), "y": rng.normal(size=300)})
    frame["z"] = frame["x"] ** 3 + rng.integers(0, 3, 300)
    got = {(r.column_x, r.column_y): r.rho for r in X.spearman_pairs(spark.createDataFrame(frame), list("xyz")).collect()}
    want = frame.rank().corr()
    for (a, b), rho in got.items():
        assert rho == pytest.approx(want.loc[a, b])


def test_anova_and_kruskal(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 4.0), ("b", 6.0)], "g string, v double")
    row = X.anova(df, "g", "v").first()
    assert (row.ss_between, row.ss_within, row.f) == pytest.approx((6.0, 10.0, 2.4))
    assert row.p_value == pytest.approx(0.1963, abs=1e-3)
    ranks = pd.Series([1, 2, 3, 2, 4, 6]).rank()
    h = 12 / 42 * (ranks[:3].sum() ** 2 / 3 + ranks[3:].sum() ** 2 / 3) - 21
    assert X.kruskal(df, "g", "v").first().h == pytest.approx(h / (1 - 6 / 210))


def test_histogram_and_entropy(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2], "k") for i in range(10)], "v double, w string, k string")
    bars = X.histogram(df, "v", 3).orderBy("bin").collect()
    assert [r["count"] for r in bars] == [3, 3, 4] and bars[-1].high == pytest.approx(9.0)
    assert {r.column: r.entropy for r in X.entropy(df, ["w", "k"]).collect()} == {"w": 1.0, "k": 0.0}
