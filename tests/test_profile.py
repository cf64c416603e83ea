import math

import numpy as np
import pandas as pd
import pytest

from facetframe.functions.quantiles import quantiles
from facetframe.operators import profile as P
from facetframe.operators.semantic import column_kinds, detect_schema, schema_summary


def one(df):
    return df.first().asDict(recursive=True)


def kinds(df):
    return {r.column: r.semantic_type for r in detect_schema(df).collect()}


def test_types_of_plots(spark, plots):
    assert kinds(plots) == {
        "plot_id": "identifier", "kind": "categorical", "age": "numerical", "annual_rent": "numerical",
        "place": "categorical", "opened": "datetime", "is_leased": "boolean"}
    counts = {r.semantic_type: r.columns for r in schema_summary(detect_schema(plots)).collect()}
    assert counts == {"numerical": 2, "categorical": 2, "datetime": 1, "boolean": 1, "identifier": 1}


def test_ambiguous_types(spark):
    df = spark.createDataFrame(
        [(i % 2, i % 2, 0.5 + i, f"note {i}", f"CODE-A{i}", "yes" if i % 2 else " No ") for i in range(10)],
        "target int, is_completed int, sensor double, order_notes string, serial_code string, answer string")
    assert kinds(df) == {"target": "numerical", "is_completed": "boolean", "sensor": "numerical",
                         "order_notes": "categorical", "serial_code": "categorical", "answer": "boolean"}


def test_dates_and_uuids_in_text(spark):
    df = spark.createDataFrame(
        [(f"2024-01-{d:02d}", f"{d:02d}/01/2024", f"2024-01-{d:02d} 10:11:12", f"2024-01-{d:02d}T01:02:03Z",
          f"{d:08x}-1111-2222-3333-444444444444", None) for d in range(10, 20)],
        "iso string, slash string, stamp string, zoned string, token string, empty string")
    assert kinds(df) == {"iso": "datetime", "slash": "datetime", "stamp": "datetime", "zoned": "datetime",
                         "token": "identifier", "empty": "categorical"}
    assert {k.column: k.day_first for k in column_kinds(df)}["slash"]
    stats = {r.column: r for r in P.datetime_stats(df, ["slash", "zoned"]).collect()}
    assert stats["slash"].min == "2024-01-10T00:00:00" and stats["slash"].time_span == "9 days"
    assert stats["zoned"].max == "2024-01-19T01:02:03"


@pytest.mark.parametrize("values, expected", [
    ([3, 4, 8, 12, 13], dict(mean=8, median=8, q25=4, q75=12, std=20.5 ** 0.5, variance=20.5, skewness=0)),
    ([-6, float("nan"), 1, None, 11], dict(count=3, mean=2)),
    ([2.5, 2.5, 2.5, 2.5], dict(std=0, variance=0, skewness=0, kurtosis=0)),
    ([-9], dict(count=1, mean=-9, std=None, variance=None, skewness=None)),
    ([None, None], dict(count=0, mean=None, min=None)),
    ([1, float("inf"), 3], dict(count=3, mean=None, max=None, infinite_count=1)),
])
def test_numerical_stats(spark, values, expected):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    got = one(P.numerical_stats(df, ["v"]))
    for name, value in expected.items():
        assert got[name] == (None if value is None else pytest.approx(value)), name


@pytest.mark.parametrize("buckets", [2, 2048])
def test_moments_and_quantiles_match_pandas(spark, buckets):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.lognormal(0, 3, 2000), "b": rng.integers(0, 5, 2000).astype(float),
                          "c": np.where(rng.random(2000) < 0.4, 7.0, rng.normal(0, 1e6, 2000))})
    got = P.numerical_stats(spark.createDataFrame(frame), buckets=buckets).toPandas().set_index("column")
    for c in frame:
        s = frame[c]
        for name, value in dict(mean=s.mean(), std=s.std(), skewness=s.skew(), kurtosis=s.kurt(),
                                q25=s.quantile(.25), q50=s.quantile(.5), q75=s.quantile(.75)).items():
            assert got.loc[c, name] == pytest.approx(value, rel=1e-9, abs=1e-9), (c, name)


def test_quantiles_with_infinities_and_copies(spark):
    values = [-math.inf] * 3 + [0.0] * 50 + list(np.linspace(-1, 1, 40) * 1e308) + [math.inf] * 2
    weighted = spark.createDataFrame([(1, float(v), 1) for v in values], "k int, value double, weight long")
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.p: r.quantile for r in quantiles(weighted, ["k"], probs, limit=5).collect()}
    ordered = np.sort(values)
    for p in probs:
        at = p * (len(ordered) - 1)
        if at == int(at) or ordered[int(at)] == ordered[int(at) + 1]:
            assert got[p] == ordered[int(at)]
    assert got[0.5] == 0.0


def test_profile_of_plots(spark, plots):
    profile = P.column_profile(plots)
    rows = {r.column: r for r in profile.collect()}
    assert rows["age"].numerical["count"] == 7 and rows["age"].numerical["min"] == 9
    assert rows["age"].missing_count == 1 and rows["age"].missing_percentage == 12.5
    assert rows["place"].categorical["most_frequent"] == "Turku"
    assert rows["place"].categorical["most_frequent_frequency"] == 2
    assert rows["is_leased"].boolean["true_count"] == 5
    assert rows["plot_id"].identifier["is_unique"] is False
    assert rows["opened"].datetime["min"] == "2016-01-31T00:00:00"
    table = one(P.dataset_profile(plots, profile))
    assert (table["row_count"], table["column_count"], table["missing_cells"], table["duplicate_rows"]) == (8, 7, 2, 1)


def test_boolean_text_counts_unknown_words_as_false(spark):
    df = spark.createDataFrame([("TRUE",), (" y ",), ("1",), ("maybe",), (None,)], "v string")
    got = one(P.boolean_stats(df, ["v"]))
    assert (got["true_count"], got["false_count"], got["missing_count"]) == (3, 1, 1)
    assert got["true_percentage"] == 75.0


def test_nulls_are_equal_in_duplicates_but_told_apart_by_place(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, "a"), (None, None), (None, None)], "x string, y string")
    assert one(P.duplicate_rows(df))["duplicate_rows"] == 2
    zero = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "x double")
    assert one(P.duplicate_rows(zero))["duplicate_rows"] == 2
    assert one(P.duplicate_rows(df.limit(0)))["duplicate_rows"] == 0


def test_long_texts_are_told_apart_and_restored(spark):
    base = "x" * 300
    df = spark.createDataFrame([(base + "a",), (base + "b",), (base + "b",), ("short",)], "t string")
    top = P.top_values(df, ["t"], 2).collect()
    assert top[0].value == base + "b" and top[0].frequency == 2
    assert one(P.common_stats(df))["unique_count"] == 3


def test_large_integers_stay_distinct(spark):
    df = spark.createDataFrame([(2 ** 53,), (2 ** 53 + 1,), (2 ** 53 + 2,)], "v long")
    assert one(P.common_stats(df))["unique_count"] == 3


def test_nested_columns_and_odd_names(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1), ([1.0, 2.0], 2)], "`a.b` array<double>, `c``d` int")
    rows = {r.column: r for r in P.column_profile(df).collect()}
    assert rows["a.b"].semantic_type == "categorical" and rows["a.b"].unique_count == 1
    assert rows["c`d"].numerical["mean"] == 1.5


def test_blanks_do_not_change_a_type(spark):
    pad = " " * 300
    df = spark.createDataFrame([("yes" if i % 2 else "no", f"2021-05-{i + 10}") for i in range(12)], "flag string, day string")
    padded = df.selectExpr(f"concat(flag, '{pad}') AS flag", f"concat('{pad}', day) AS day")
    assert kinds(padded) == kinds(df) == {"flag": "boolean", "day": "datetime"}


def test_number_summary_with_infinities_copies_and_neighbours(spark):
    from facetframe.functions.ranks import number_summary
    near = float(np.nextafter(1.0, 2.0))
    columns = [[-math.inf] * 3 + [0.0] * 50 + (np.linspace(-1, 1, 40) * 1e308).tolist() + [math.inf] * 2,
               [1.0] * 40 + [near] * 55, [5e-324, 0.0] * 47 + [1.0], [None] * 95, [math.nan] * 94 + [7.0]]
    frame = spark.createDataFrame([tuple(map(lambda c: c[i], columns)) for i in range(95)],
                                  "a double, b double, c double, d double, e double").repartition(3)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = number_summary(frame, [0, 1, 2, 3, 4], probs, buckets=8)
    assert sorted(got) == [0, 1, 2, 4] and got[4]["count"] == 1 and got[0]["infinite"] == 5
    for i in (0, 1, 2):
        ordered = sorted(columns[i])
        for p in probs:
            at = p * (len(ordered) - 1)
            a, b = ordered[int(at)], ordered[min(int(at) + 1, len(ordered) - 1)]
            want = a if a == b or at == int(at) else a + (b - a) * (at - int(at))
            assert got[i]["quantiles"][p] == want or math.isclose(got[i]["quantiles"][p], want), (i, p)


def test_distinct_counts_by_bitmap_and_digest(spark, monkeypatch):
    from facetframe.functions import ranks
    rows = [(i % 700, (i * 2_654_435_761) % 2 ** 40, float(i % 9) - 4.0 if i % 10 else -0.0, f"t{i % 37}", None, i % 3 == 0) for i in range(5000)]
    df = spark.createDataFrame(rows, "near int, far long, num double, word string, none string, flag boolean").repartition(3)
    want = {i: (sum(v is not None for v in c), len({v for v in c if v is not None})) for i, c in enumerate(zip(*rows))}
    assert ranks.distinct_counts(df, list(range(6))) == want
    # a first digest that clashes: the second one shows it, and the texts are counted
    from pyspark.sql import functions as F
    monkeypatch.setattr(ranks, "_digest", lambda c, dtype: (F.length(c).cast("long"), F.xxhash64(c)))
    assert ranks.distinct_counts(df.select("word"), [0]) == {0: want[3]}


def test_numbers_are_marked_without_a_sort_of_rows(spark):
    """Memory of a task: words of the numbers it has, where bitmaps of 4 KB sorted all its rows."""
    from facetframe.functions import ranks
    tall = spark.range(0, 1000, numPartitions=3).selectExpr("cast(id % 2 as int) AS o", "id * id % 640 AS v")
    marked = ranks._marked(tall)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
    want = {o: len({i * i % 640 for i in range(1000) if i % 2 == o}) for o in (0, 1)}
    rows = marked.collect()
    assert {o: sum(bin(r.bits % 2 ** 64).count("1") for r in rows if r.o == o) for o in (0, 1)} == want
    edges = [(x,) for x in [-(2 ** 63), -(2 ** 63) + 63, -(2 ** 63) + 64] * 50]
    assert ranks.distinct_counts(spark.createDataFrame(edges, "x long"), [0]) == {0: (150, 3)}
