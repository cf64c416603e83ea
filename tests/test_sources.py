import json

import pytest

from facetframe.sources import readers as S
from facetframe.sources import writers as W
from facetframe.operators import browse as B


def write(path, text):
    path.write_text(text)
    return str(path)


def test_formats(spark, tmp_path, plots):
    csv = write(tmp_path / "a.CSV", "id,when,amount\n1,2024-01-01,1.5\n2,2024-01-02,\n")
    df = S.load(spark, csv)
    assert df.count() == 2 and dict(df.dtypes)["amount"] == "double"
    records = write(tmp_path / "b.json", json.dumps([{"a": 1, "b": None}, {"a": 2, "b": "x"}]))
    assert S.load(spark, records).count() == 2
    plots.write.parquet(str(tmp_path / "c.parquet"))
    assert S.load(spark, str(tmp_path / "c.parquet")).count() == 8
    meta = S.dataset_metadata(df).first()
    assert meta.row_count == 2 and meta.file_size_bytes > 0 and meta.columns == "id,when,amount"


def test_failures(spark, tmp_path):
    with pytest.raises(S.UnsupportedFileFormatError, match=".csv"):
        S.load(spark, "x.txt")
    with pytest.raises(S.DatasetNotFoundError):
        S.load(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(S.EmptyDatasetError):
        S.load(spark, write(tmp_path / "empty.csv", ""))
    with pytest.raises(S.EmptyDatasetError):
        S.load(spark, write(tmp_path / "header.csv", "a,b\n"))
    with pytest.raises(S.CorruptDatasetError):
        S.load(spark, write(tmp_path / "bad.parquet", "not parquet at all"))
    with pytest.raises(S.CorruptDatasetError):
        S.load(spark, write(tmp_path / "bad.json", "{broken"))
    late = "a,b\n" + "1,2\n" * 5000 + "1,2,3\n"
    with pytest.raises(S.CorruptDatasetError):                  # however far down the broken row is
        S.load(spark, write(tmp_path / "late.csv", late), schema="a int, b int")
    assert issubclass(S.DatasetNotFoundError, FileNotFoundError)


def test_text_files_are_split(spark, tmp_path):
    path = write(tmp_path / "long.csv", "a,b\n" + "12345678,abcdefgh\n" * 60_000)
    lines = write(tmp_path / "long.json", '{"a": 12345678}\n' * 60_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        assert S.read_csv(spark, path, "a int, b string").rdd.getNumPartitions() > 4
        assert S.read_json(spark, lines, "a int").rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    array = write(tmp_path / "array.json", '[\n{"a": 1,\n"b": "x"},\n{"a": 2}\n]')
    assert S.load(spark, array, multi_line=True).count() == 2


def test_csv_round_trip(spark, tmp_path, plots):
    W.export_csv(plots, str(tmp_path / "out"))
    assert S.load(spark, str(tmp_path / "out"), "csv", plots.schema).exceptAll(plots).isEmpty()


def test_json_has_no_infinities(spark):
    df = spark.createDataFrame([(float("inf"), {"a": float("nan")}, [1.0, float("-inf")])], "x double, m map<string,double>, l array<double>")
    assert json.loads(W.report_json(df).first().json) == {"x": None, "m": {"a": None}, "l": [1.0, None]}


def test_browse(spark, plots):
    rows, totals = B.browse(plots, 1, 3, "age", False)
    assert [r.age for r in rows.collect()] == [44, 31, 26]
    assert tuple(totals.first()) == (8, 3)
    assert [r.age for r in B.sort_by(plots, "age").collect()][-1] is None
    assert B.sort_by(plots, "unknown") is plots
    assert B.search(plots, " TURKU ").count() == 2
    assert B.search(plots, ".*").count() == 0
    assert B.page_totals(plots.limit(0)).first().total_pages == 1
    with pytest.raises(ValueError):
        B.page(plots, 0)
    with pytest.raises(ValueError):
        B.select_columns(plots, [])


def test_load_errors_counts_all_rows_of_several_files(spark, tmp_path):
    from catalog.registry import QUERIES
    spark.range(1, 1001).selectExpr("id AS o_orderkey", "id % 100 AS o_custkey").repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.case: r.result for r in QUERIES["load_errors"](spark, str(tmp_path)).collect()}
    assert got["whole"] == "rows: 1000" and got["ragged"] == got["not parquet"] == "CorruptDatasetError"
    assert got["header"] == got["no bytes"] == "EmptyDatasetError" and got["absent"] == "DatasetNotFoundError"


def test_rejected_records(spark, tmp_path):
    path = write(tmp_path / "mixed.csv", 'a,b,c\n1,x,2.5\n2,y\n3,z,1.0,9\nfour,"w,w",1.5\n5,,\n6,u,much\n')
    rows, rejected = S.load_tolerant(spark, path, "a int, b string, c double")
    assert sorted(map(tuple, rows.collect())) == [(1, "x", 2.5), (5, None, None)]
    got = {r.record: r.reason for r in rejected.collect()}
    assert got == {"2,y": "too few values", "3,z,1.0,9": "too many values", 'four,"w,w",1.5': "a: no int", "6,u,much": "c: no double"}
    assert all(r.file.endswith("mixed.csv") for r in rejected.collect())
    lines = write(tmp_path / "mixed.json", '{"a": 1, "b": "x"}\n{"a": "one", "b": "y"}\n{broken\n[1]\n{"b": null}\n')
    rows, rejected = S.load_tolerant(spark, lines, "a int, b string")
    assert sorted(map(tuple, rows.collect()), key=repr) == [(1, "x"), (None, None)]
    assert {r.record: r.reason for r in rejected.collect()} == {
        '{"a": "one", "b": "y"}': "a: no int", "{broken": "no JSON object", "[1]": "no JSON object"}
    with pytest.raises(S.DatasetNotFoundError):
        S.load_tolerant(spark, str(tmp_path / "absent.csv"), "a int")
    with pytest.raises(S.UnsupportedFileFormatError):
        S.load_tolerant(spark, str(tmp_path / "x.parquet"), "a int")


@pytest.mark.parametrize("ascending", [True, False])
def test_order_index(spark, ascending):
    values = [None, 3.0, float("nan"), 1.0, 1.0, 2.0, -5.0, None] * 9
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").repartition(5)
    index = B.OrderIndex(df, "v", ascending)
    sign = 1 if ascending else -1
    missing = lambda v: v is None or v != v
    want = [i for i, v in sorted(enumerate(values), key=lambda t: (missing(t[1]), 0 if missing(t[1]) else sign * t[1], t[0]))]
    assert index.total == 72 and [r.i for r in index.numbered().orderBy("position").collect()] == want
    for number in (1, 2, 5, 11):
        assert [r.i for r in index.page(number, 7).collect()] == want[(number - 1) * 7:number * 7]
    assert B.OrderIndex(df.limit(0), "v").page(1).count() == 0
