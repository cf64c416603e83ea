import pytest

from facetframe.operators import features as FE


@pytest.mark.parametrize("strategy, fill", [("median", 5.5), ("mean", 16.75), ("zero", 0.0)])
def test_imputation(spark, strategy, fill):
    df = spark.createDataFrame([(-1.0,), (float("nan"),), (4.0,), (7.0,), (57.0,)], "val double")
    model = FE.fit_features(df, numeric_imputation=strategy, scaling=None)
    assert sorted(r.val for r in model.transform(df).collect()) == sorted([-1.0, fill, 4.0, 7.0, 57.0])


def test_one_hot_with_unseen_category(spark):
    train = spark.createDataFrame([("oak", 1.5), ("elm", 2.5), ("oak", 3.5), ("ash", 4.5), ("ash", 0.5)], "tree string, amount double")
    model = FE.fit_features(train, scaling=None)
    assert model.feature_names == ["amount", "tree_ash", "tree_elm", "tree_oak"]
    new = spark.createDataFrame([("elm", 5.0), ("fir", 6.0)], "tree string, amount double")
    got = {r.amount: tuple(r)[1:] for r in model.transform(new).collect()}
    assert got == {5.0: (0.0, 1.0, 0.0), 6.0: (0.0, 0.0, 0.0)}


def test_date_parts(spark):
    df = spark.createDataFrame([("2018-11-07", 1), ("2019-03-24", 2), ("2018-06-30", 3), ("2018-11-07", 4)], "date string, value int")
    model = FE.fit_features(df, scaling=None)
    assert len(model.feature_names) == 5
    first = model.transform(df).where("value = 1").first()
    assert (first.date_year, first.date_month, first.date_day, first.date_dayofweek) == (2018.0, 11.0, 7.0, 2.0)
    gap = spark.createDataFrame([("no date", 1)], "date string, value int")
    row = model.transform(gap).first()
    assert (row.date_year, row.date_month, row.date_day, row.date_dayofweek) == (2000.0, 1.0, 1.0, 0.0)


def test_roles(spark):
    df = spark.createDataFrame([(f"c{i}", f"u{i}@x", i, f"k{i % 55}", "same", None, "yes" if i % 2 else "no") for i in range(80)],
                               "customer_id string, email string, metric int, crowded string, fixed string, nothing string, ok string")
    got = {r.column: (r.role, r.reason) for r in FE.feature_roles(df).collect()}
    assert got["customer_id"][0] == got["email"][0] == "excluded"
    assert got["metric"] == ("numeric", None)
    assert got["crowded"] == ("excluded", "high_cardinality (55 unique > threshold 50)")
    assert got["fixed"] == ("excluded", "constant_feature")
    assert got["nothing"] == ("excluded", "all_null")
    assert got["ok"] == ("boolean", None)


def test_scaling_is_fitted_on_training_rows_only(spark):
    model = FE.fit_features(spark.createDataFrame([(2.0,), (5.0,), (5.0,), (8.0,)], "x double"))
    got = model.transform(spark.createDataFrame([(11.0,)], "x double")).first().x
    assert got == pytest.approx((11 - 5) / 4.5 ** 0.5)


def test_missing_column_takes_the_fills(spark):
    model = FE.fit_features(spark.createDataFrame([(1.0, "a"), (3.0, "b"), (5.0, "b")], "x double, k string"), scaling=None)
    row = model.transform(spark.createDataFrame([(1,)], "other int")).first()
    assert (row.x, row.k_a, row.k_b) == (3.0, 0.0, 1.0)


def test_equal_names_are_different_features(spark):
    """Numbers ``order_year`` beside a date ``order``, and categories that spell the same name."""
    df = spark.createDataFrame([(1999.0 + i, f"2020-0{i % 9 + 1}-03", "b_c" if i % 2 else "x", "c" if i % 3 else "y") for i in range(12)],
                               "order_year double, order string, a string, a_b string")
    model = FE.fit_features(df)
    names = model.feature_names
    assert len(names) == len(set(names)) == 1 + 4 + 2 + 2
    out = model.transform(df)
    assert out.columns == names and {"order_year", "order_year_2", "a_b_c", "a_b_c_2"} <= set(names)
    plain = FE.fit_features(df, scaling=None).transform(df).first()
    assert plain["order_year"] >= 1999.0 and plain["order_year_2"] == 2020.0


def test_few_categories_are_obeyed(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbcde"], "v string")
    assert FE.fit_features(df, max_categories=2).categories == {"v": ["a", "b"]}
