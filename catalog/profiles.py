"""Column and table profiles."""

from pyspark.sql import functions as F

from facetframe.operators import profile as P

from .browsing import MIXED_SQL, mixed
from .registry import query, rounded, table, union_all

LINEITEM_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax")
LINEITEM_COLUMNS = (*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate")


def _numbers(c: str, source: str, digits: int = 4) -> str:
    r = lambda e: f"round({e}, {digits})"
    return f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})')} AS mean,
      {r(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median, {r(f'stddev_samp({c})')} AS std,
      round(var_samp({c}), 2) AS variance, {r(f'min({c})::DOUBLE')} AS min, {r(f'max({c})::DOUBLE')} AS max,
      {r(f'quantile_cont({c}::DOUBLE, 0.25)')} AS q25, {r(f'quantile_cont({c}::DOUBLE, 0.5)')} AS q50,
      {r(f'quantile_cont({c}::DOUBLE, 0.75)')} AS q75, {r(f'skewness({c})')} AS skewness,
      {r(f'kurtosis({c})')} AS kurtosis, 0::BIGINT AS infinite_count FROM {source}"""


def numbers(df, digits=4):
    return rounded(df.withColumn("variance", F.round("variance", 2)), digits)


@query("numerical_stats", union_all([_numbers(c, "lineitem") for c in LINEITEM_NUMBERS]))
def _(spark, sf):
    return numbers(P.numerical_stats(table(spark, sf, "lineitem"), list(LINEITEM_NUMBERS)))


@query("numerical_stats_with_gaps", union_all([_numbers(
    "v", "(SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS v FROM lineitem)")]))
def _(spark, sf):
    gap = F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_extendedprice"))
    return numbers(P.numerical_stats(table(spark, sf, "lineitem").select(gap.alias("v"))))


@query("quantiles_by_narrowing", union_all([_numbers(c, "orders") for c in ("o_totalprice", "o_custkey")]))
def _(spark, sf):
    # few buckets make every column take many rounds
    return numbers(P.numerical_stats(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], buckets=4))


def _common(c: str, source: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS missing_count,
      round((count(*) - count({c})) / count(*) * 100, 2) AS missing_percentage,
      count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count(*) * 100, 2) AS unique_percentage
      FROM {source}"""


@query("common_stats", union_all([_common(c, "lineitem") for c in LINEITEM_COLUMNS]))
def _(spark, sf):
    return P.common_stats(table(spark, sf, "lineitem")).select(
        "column", "row_count", "missing_count", "missing_percentage", "unique_count", "unique_percentage")


@query("common_stats_long_text", union_all([_common(c, "pages") for c in ("page_id", "url", "html")]))
def _(spark, sf):
    return P.common_stats(table(spark, sf, "pages")).select(
        "column", "row_count", "missing_count", "missing_percentage", "unique_count", "unique_percentage")


def _top(c: str, source: str, n: int = 10, order: str = "value") -> str:
    return f"""SELECT '{c}' AS "column", rank::INTEGER AS rank, value, frequency FROM (
      SELECT {c} AS value, count(*) AS frequency,
             row_number() OVER (ORDER BY count(*) DESC, {order}) AS rank
      FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= {n}"""


@query("top_values", union_all(
    [_top(c, "part", order=c) for c in ("p_name", "p_brand", "p_type")]))
def _(spark, sf):
    return P.top_values(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@query("top_values_long_text", _top("text", "documents", 5,
                                    "CASE WHEN strlen(text) > 128 THEN sha256(text) ELSE text END"))
def _(spark, sf):
    return P.top_values(table(spark, sf, "documents"), ["text"], 5)


@query("categorical_stats", union_all([f"""
SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM customer) AS unique_count, 0::BIGINT AS missing_count,
  0.0::DOUBLE AS missing_percentage, {c} AS most_frequent, count(*) AS most_frequent_frequency
FROM customer GROUP BY {c} QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) = 1
""" for c in ("c_name", "c_mktsegment")]))
def _(spark, sf):
    return P.categorical_stats(table(spark, sf, "customer")).drop("top_values")


_SPAN = """(d.days::BIGINT::VARCHAR || ' days' || CASE WHEN d.rest = 0 THEN '' ELSE ' ' ||
  printf('%02d:%02d:%02d', d.rest // 3600000000, (d.rest // 60000000) % 60, (d.rest // 1000000) % 60) ||
  CASE WHEN d.rest % 1000000 = 0 THEN '' ELSE printf('.%06d', d.rest % 1000000) END END)"""


def _times(c: str, source: str, parsed: str) -> str:
    iso = lambda e: (f"CASE WHEN microsecond({e}) % 1000000 = 0 THEN strftime({e}, '%Y-%m-%dT%H:%M:%S') "   # noqa: E731
                     f"ELSE strftime({e}, '%Y-%m-%dT%H:%M:%S.%f') END")
    return f"""SELECT '{c}' AS "column", missing_count, {iso('low')} AS min, {iso('high')} AS max, unique_count,
      {_SPAN} AS time_span FROM (
      SELECT *, epoch_us(high) - epoch_us(low) AS us FROM (
        SELECT min(v) AS low, max(v) AS high, count(DISTINCT v) AS unique_count, count(*) - count(raw) AS missing_count
        FROM (SELECT {parsed} AS v, {c} AS raw FROM {source}))) s,
      LATERAL (SELECT us // 86400000000 AS days, us % 86400000000 AS rest) d"""


@query("datetime_stats", union_all([
    _times("o_orderdate", "orders", "o_orderdate"), _times("ts", "events", "ts"),
    _times("written", "(SELECT CASE WHEN event_id % 10 <> 0 THEN strftime(ts, '%d/%m/%Y') END AS written, ts FROM events)",
           "strptime(written, '%d/%m/%Y')")]))
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderdate")
    events = table(spark, sf, "events")
    written = events.select(F.when(F.col("event_id") % 10 != 0, F.date_format("ts", "dd/MM/yyyy")).alias("written"))
    parts = [P.datetime_stats(df) for df in (orders, events.select("ts"), written)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        "column", "missing_count", "min", "max", "unique_count", "time_span")


@query("boolean_stats", """
SELECT 'cheap' AS "column", count_if(x) AS true_count, count_if(NOT x) AS false_count, count(*) - count(x) AS missing_count,
  round(count_if(x) / count(x) * 100, 2) AS true_percentage, round(count_if(NOT x) / count(x) * 100, 2) AS false_percentage
FROM (SELECT CASE WHEN p_size > 40 THEN NULL ELSE p_retailprice < 1000 END AS x FROM part)
UNION ALL
SELECT 'words', count_if(x), count_if(NOT x), 0, round(count_if(x) / count(*) * 100, 2), round(count_if(NOT x) / count(*) * 100, 2)
FROM (SELECT p_size % 3 = 0 AS x FROM part)
UNION ALL
SELECT 'is_odd', count_if(x), count_if(NOT x), 0, round(count_if(x) / count(*) * 100, 2), round(count_if(NOT x) / count(*) * 100, 2)
FROM (SELECT p_size % 2 = 1 AS x FROM part)""")
def _(spark, sf):
    part = table(spark, sf, "part")
    size = F.col("p_size")
    return P.boolean_stats(part.select(
        F.when(size <= 40, F.col("p_retailprice") < 1000).alias("cheap"),
        F.when(size % 3 == 0, " YES").otherwise("N").alias("words"), (size % 2).alias("is_odd")))


@query("identifier_stats", union_all([f"""
SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count,
  round(count(DISTINCT {c}) / count(*) * 100, 2) AS unique_percentage, count(*) - count({c}) AS missing_count,
  round((count(*) - count({c})) / count(*) * 100, 2) AS missing_percentage,
  count(DISTINCT {c}) = count(*) AS is_unique FROM events""" for c in ("event_id", "user_id")]))
def _(spark, sf):
    return P.identifier_stats(table(spark, sf, "events"))


@query("duplicate_rows", """
SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT a, l_linestatus FROM t)) AS duplicate_rows,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT a, l_linestatus FROM t))) / count(*) * 100, 2) AS duplicate_percentage
FROM t""".replace("FROM t", "FROM (SELECT nullif(l_returnflag, 'A') AS a, l_linestatus FROM lineitem)"))
def _(spark, sf):
    gaps = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag"))
    return P.duplicate_rows(table(spark, sf, "lineitem").select(gaps.alias("a"), "l_linestatus"))


@query("duplicate_rows_wide", """
SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows FROM lineitem
UNION ALL
SELECT count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) FROM documents""")
def _(spark, sf):
    return (P.duplicate_rows(table(spark, sf, "lineitem"))
            .unionByName(P.duplicate_rows(table(spark, sf, "documents").drop("doc_id")))
            .drop("duplicate_percentage"))


@query("dataset_profile", """
SELECT count(*) AS row_count, 3::BIGINT AS column_count, count(*) * 3 AS total_cells,
  count(*) * 3 - count(status) - count(priority) - count(price) AS missing_cells,
  round((count(*) * 3 - count(status) - count(priority) - count(price)) / (count(*) * 3) * 100, 2) AS missing_percentage,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))) / count(*) * 100, 2) AS duplicate_percentage,
  1::BIGINT AS numerical_columns, 2::BIGINT AS categorical_columns, 0::BIGINT AS datetime_columns
FROM t""".replace("FROM t", """FROM (SELECT nullif(o_orderstatus, 'P') AS status, o_orderpriority AS priority,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE round(o_totalprice / 100000) END AS price FROM orders)"""))
def _(spark, sf):
    orders = table(spark, sf, "orders")
    df = orders.select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_custkey") % 5 != 0, F.round(F.col("o_totalprice") / 100000)).alias("price"))
    return P.dataset_profile(df).select(
        "row_count", "column_count", "total_cells", "missing_cells", "missing_percentage", "duplicate_rows",
        "duplicate_percentage", "numerical_columns", "categorical_columns", "datetime_columns")


_MIXED_TYPES = {"event_id": "identifier", "user_id": "identifier", "value": "numerical",
                "event_type": "categorical", "ts": "datetime", "props": "categorical", "big": "boolean",
                "is_big": "boolean", "code": "numerical", "iso_day": "datetime",
                "written_day": "datetime", "token": "identifier"}


def _profile_line(c: str, kind: str) -> str:
    mean = f"round(avg({c}), 4)" if kind == "numerical" else "NULL::DOUBLE"
    top = (f"(SELECT {c} FROM t GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)"
           if kind == "categorical" else "NULL::VARCHAR")
    true = {"big": "count_if(big = 'Yes')", "is_big": "count_if(is_big = 1)"}.get(c, "NULL::BIGINT")
    days = {"ts": "ts", "iso_day": "strptime(iso_day, '%Y-%m-%d')",
            "written_day": "strptime(written_day, '%d/%m/%Y')"}.get(c)
    span = f"date_diff('day', min({days}), max({days}))::INTEGER" if days else "NULL::INTEGER"
    unique = f"count(DISTINCT {c}) = count(*)" if kind == "identifier" else "NULL::BOOLEAN"
    return f"""SELECT '{c}' AS "column", '{kind}' AS semantic_type, count(*) AS row_count,
      count(DISTINCT {c}) AS unique_count, {mean} AS mean, {top} AS most_frequent, {true} AS true_count,
      {span} AS span_days, {unique} AS is_unique FROM t"""


@query("column_profile", f"WITH t AS ({MIXED_SQL})\n" + union_all(
    [_profile_line(c, k) for c, k in _MIXED_TYPES.items()]))
def _(spark, sf):
    return rounded(P.column_profile(mixed(spark, sf)).select(
        "column", "semantic_type", "row_count", "unique_count", F.col("numerical.mean").alias("mean"),
        F.col("categorical.most_frequent").alias("most_frequent"), F.col("boolean.true_count").alias("true_count"),
        F.col("datetime.span_days").alias("span_days"), F.col("identifier.is_unique").alias("is_unique")))


@query("column_profile_lineitem", union_all([_common(c, "lineitem") for c in LINEITEM_COLUMNS]))
def _(spark, sf):
    return P.column_profile(table(spark, sf, "lineitem")).select(
        "column", "row_count", "missing_count", "missing_percentage", "unique_count", "unique_percentage")
