"""Readers and writers."""

from pyspark.sql import functions as F

from facetframe.session import shared_folder
from facetframe.sources import readers, writers

from .registry import query, table


@query("read_parquet", "SELECT * FROM nation")
def _(spark, sf):
    return readers.load(spark, f"{sf}/nation.parquet")


@query("export_csv_read_csv", "SELECT * FROM customer")
def _(spark, sf):
    customer = table(spark, sf, "customer")
    path = shared_folder(spark, "customer-csv")
    writers.export_csv(customer, path)
    return readers.load(spark, path, "csv", customer.schema)


@query("read_csv_inferred", """
SELECT o_orderkey::INTEGER AS o_orderkey, o_totalprice, o_orderpriority,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders""")
def _(spark, sf):
    path = shared_folder(spark, "orders-csv")
    writers.export_csv(table(spark, sf, "orders"), path)
    df = readers.load(spark, path, "csv")
    return df.select("o_orderkey", "o_totalprice", "o_orderpriority",
                     F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


@query("export_json_read_json", """
SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier""")
def _(spark, sf):
    path = shared_folder(spark, "report-json")
    writers.export_report_json({"supplier": table(spark, sf, "supplier")}, path)
    # written as one record per line
    return readers.read_json(spark, f"{path}/supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("read_json_array", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf):
    nation = table(spark, sf, "nation")
    path = shared_folder(spark, "nation-array")
    # one array of records over several lines: the 25 nations
    nation.agg(F.regexp_replace(F.to_json(F.collect_list(F.struct("*"))), "\\},", "},\n")).write.text(path)
    return readers.load(spark, path, "json", nation.schema, multi_line=True)


@query("load_errors", """
SELECT * FROM (VALUES ('absent', 'DatasetNotFoundError'), ('header', 'EmptyDatasetError'), ('no bytes', 'EmptyDatasetError'),
  ('not parquet', 'CorruptDatasetError'), ('ragged', 'CorruptDatasetError'), ('unknown', 'UnsupportedFileFormatError'),
  ('whole', 'rows: ' || (SELECT count(*) FROM orders))) AS t ("case", result)""")
def _(spark, sf):
    """The kinds of failure of the reader, and a good table, all written from orders."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    path = shared_folder(spark, "orders-faulty")
    line = F.concat_ws(",", "a", "b").alias("a,b")
    broken = F.when(F.col("a,b").contains("77,"), F.concat("a,b", F.lit(",1"))).otherwise(F.col("a,b"))
    writers.export_csv(orders, f"{path}/whole")
    # a header of two names in each file, and some rows with a third value
    orders.select(line).select(broken.alias("a,b")).write.option("header", True).option("quote", "").csv(f"{path}/ragged", sep="\t")
    orders.limit(0).select(line).write.text(f"{path}/no bytes")
    orders.select(F.lit("a,b").alias("line")).limit(1).write.text(f"{path}/header")

    def outcome(case: str, fmt: str | None) -> str:
        try:
            return f"rows: {readers.load(spark, f'{path}/{case}', fmt, 'a long, b long').count()}"
        except readers.IngestionError as err:
            return type(err).__name__

    cases = {"absent": "csv", "header": "csv", "no bytes": "csv", "ragged": "csv", "unknown": None, "whole": "csv"}
    rows = [(c, outcome(c, fmt)) for c, fmt in cases.items()]
    rows.append(("not parquet", outcome("whole", "parquet")))
    return spark.createDataFrame(rows, "case string, result string")


def _faulty(spark, sf):
    """Orders as CSV with a header in each file; every seventh row has a third value, every eleventh no number."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    line = (F.when(F.col("a") % 7 == 0, F.concat_ws(",", "a", "b", F.lit("more"))).when(F.col("a") % 11 == 0, F.concat_ws(",", "a", F.lit("none")))
            .when(F.col("a") % 13 == 0, F.col("a").cast("string")).otherwise(F.concat_ws(",", "a", "b")))
    path = shared_folder(spark, "orders-rejected")
    orders.select(line.alias("a,b")).write.option("header", True).option("quote", "").csv(path, sep="\t")
    return readers.load_tolerant(spark, path, "a long, b long", "csv")


@query("load_accepted", """
SELECT o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""")
def _(spark, sf):
    return _faulty(spark, sf)[0]


@query("load_rejected", """
SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey || ',' || o_custkey || ',more' WHEN o_orderkey % 11 = 0 THEN o_orderkey || ',none'
            ELSE o_orderkey::VARCHAR END AS record,
       CASE WHEN o_orderkey % 7 = 0 THEN 'too many values' WHEN o_orderkey % 11 = 0 THEN 'b: no bigint' ELSE 'too few values' END AS reason
FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0""")
def _(spark, sf):
    return _faulty(spark, sf)[1].select("record", "reason")


@query("dataset_metadata", """
SELECT 1::BIGINT AS files, count(*) AS row_count, 11 AS column_count,
       'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' AS columns
FROM lineitem""")
def _(spark, sf):
    return readers.dataset_metadata(table(spark, sf, "lineitem")).select(
        "files", "row_count", "column_count", "columns")


@query("export_report_json", """
SELECT '{"event_id":' || event_id || ',"ratio":' ||
       CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '1.5' END || '}' AS json FROM events""")
def _(spark, sf):
    infinite = F.when(F.col("event_id") % 3 == 0, float("inf")).otherwise(1.5)
    return writers.report_json(table(spark, sf, "events").select("event_id", infinite.alias("ratio")))
