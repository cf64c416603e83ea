"""Compare registered queries with their SQL: python tests/check_queries.py SF_DIR [name ...]."""

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, run, sql, sf):
    started = time.time()
    df = run(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - started
    if sql is None:
        return "rows only" if got else "EMPTY", f"{len(got)} rows", seconds
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return "COLUMNS", f"{sorted(df.columns)} != {sorted(rel.columns)}", seconds
    kinds = lambda rows: [[type(v).__name__ for v in r] for r in rows]
    if got == want and kinds(got) == kinds(want):
        return ("ok" if got else "ok but EMPTY"), f"{len(got)} rows", seconds
    pairs = [(g, w) for g, w in zip(got, want) if g != w or kinds([g]) != kinds([w])][:3]
    return "DIFFERENT", f"{len(got)} vs {len(want)} rows; first: {pairs}", seconds


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            verdict, note, seconds = compare(spark, con, name, queries[name], sql.get(name), sf)
        except Exception as err:   # report and go on
            verdict, note, seconds = "ERROR", f"{type(err).__name__}: {str(err)[:600]}", 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{verdict:12} {name:32} {seconds:6.1f}s {'' if verdict == 'ok' else note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
