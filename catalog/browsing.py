"""Record browser and schema detection."""

from pyspark.sql import functions as F

from facetframe.operators import browse as B
from facetframe.operators import quality as R
from facetframe.operators import semantic as S
from facetframe.operators.findings import analyze_statistics
from facetframe.operators.profile import column_profile, dataset_profile

from .registry import query, table, union_all


@query("search", """
SELECT * FROM part WHERE lower(p_partkey::VARCHAR) LIKE '%steel%' OR lower(p_name) LIKE '%steel%'
  OR lower(p_brand) LIKE '%steel%' OR lower(p_type) LIKE '%steel%' OR lower(p_size::VARCHAR) LIKE '%steel%'
  OR p_type = 'ECONOMY'""")
def _(spark, sf):
    part = table(spark, sf, "part")
    return B.search(part, " Steel ").unionByName(B.search(part, "ECONOMY")).distinct()


@query("search_text", """
SELECT page_id FROM pages
WHERE contains(lower(url), '.example.com/fr') OR contains(lower(html), '.example.com/fr')""")
def _(spark, sf):
    return B.search(table(spark, sf, "pages"), ".Example.com/FR").select("page_id")


@query("sort_by", """
SELECT c_custkey, c_name, row_number() OVER (ORDER BY v DESC NULLS LAST, c_custkey) AS place
FROM (SELECT *, CASE WHEN c_nationkey < 20 THEN c_acctbal END AS v FROM customer)""")
def _(spark, sf):
    gaps = table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_nationkey") < 20, F.col("c_acctbal")).alias("v"))
    numbered = B.OrderIndex(gaps, "v", ascending=False).numbered("at")
    return numbered.select("c_custkey", "c_name", (F.col("at") + 1).alias("place"))


@query("page_deep", """
SELECT * FROM lineitem ORDER BY l_extendedprice NULLS LAST, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax,
  l_returnflag, l_linestatus, l_shipdate LIMIT 50 OFFSET 49950""")
def _(spark, sf):
    return B.OrderIndex(table(spark, sf, "lineitem"), "l_extendedprice").page(1000, 50)


@query("page", """
SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100""")
def _(spark, sf):
    return B.page(B.sort_by(table(spark, sf, "orders"), "o_totalprice", ascending=False), 3, 50)


@query("page_totals", """
SELECT count(*) AS total_rows, greatest(1, ceil(count(*) / 50.0))::BIGINT AS total_pages
FROM customer WHERE lower(c_mktsegment) LIKE '%machinery%'""")
def _(spark, sf):
    return B.browse(table(spark, sf, "customer"), needle="machinery")[1]


@query("browse", """
SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts, user_id, event_type, value, props
FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 20""")
def _(spark, sf):
    return B.browse(table(spark, sf, "events"), size=20, sort="value", ascending=False, needle="purchase")[0]


@query("clean_cells", """
SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts,
       CASE WHEN event_id % 4 IN (0, 1, 2) THEN NULL ELSE value END AS value FROM events""")
def _(spark, sf):
    kind = F.col("event_id") % 4
    odd = (F.when(kind == 0, float("nan")).when(kind == 1, float("inf")).when(kind == 2, float("-inf"))
           .otherwise(F.col("value")))
    return B.clean_cells(table(spark, sf, "events").select("event_id", "ts", odd.alias("value")))


@query("select_columns", "SELECT l_orderkey, l_linenumber FROM lineitem")
def _(spark, sf):
    return B.select_columns(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# A table with every semantic type, also as text.

MIXED_SQL = """
SELECT event_id, user_id, value, event_type, ts, props,
       CASE WHEN value > 10 THEN 'Yes' ELSE ' no ' END AS big,
       (value > 10)::INTEGER AS is_big, (value > 10)::INTEGER AS code,
       strftime(ts, '%Y-%m-%d') AS iso_day, strftime(ts, '%d/%m/%Y') AS written_day,
       substr(md5(event_id::VARCHAR), 1, 8) || '-' || substr(md5(event_id::VARCHAR), 9, 4) || '-' ||
       substr(md5(event_id::VARCHAR), 13, 4) || '-' || substr(md5(event_id::VARCHAR), 17, 4) || '-' ||
       substr(md5(event_id::VARCHAR), 21, 12) AS token FROM events"""


def mixed(spark, sf):
    digest = F.md5(F.col("event_id").cast("string"))
    pieces = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    big = F.col("value") > 10
    return table(spark, sf, "events").select(
        "event_id", "user_id", "value", "event_type", "ts", "props",
        F.when(big, "Yes").otherwise(" no ").alias("big"), big.cast("int").alias("is_big"),
        big.cast("int").alias("code"), F.date_format("ts", "yyyy-MM-dd").alias("iso_day"),
        F.date_format("ts", "dd/MM/yyyy").alias("written_day"), F.concat_ws("-", *pieces).alias("token"))


_BOOL = "('true','false','t','f','yes','no','y','n')"
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _text_type(c: str) -> str:
    return f"""SELECT '{c}' AS "column", CASE
      WHEN bool_and(lower(trim({c})) IN {_BOOL}) THEN 'boolean'
      WHEN avg(regexp_matches({c}, '{_UUID}')::INTEGER) >= 0.8 THEN 'identifier'
      WHEN bool_and(regexp_matches({c}, '[-/:T]'))
       AND avg((try_strptime({c}, '%Y-%m-%d') IS NOT NULL OR try_strptime({c}, '%d/%m/%Y') IS NOT NULL
                OR try_strptime({c}, '%m/%d/%Y') IS NOT NULL)::INTEGER) >= 0.9 THEN 'datetime'
      ELSE 'categorical' END AS semantic_type FROM t"""


def _key_type(c: str) -> str:
    return f"""SELECT '{c}', CASE WHEN count(DISTINCT {c}) > 1 THEN 'identifier' ELSE 'numerical' END FROM t"""


_TYPES = f"WITH t AS ({MIXED_SQL}), types AS (" + union_all([
    *[_text_type(c) for c in ("event_type", "props", "big", "iso_day", "written_day", "token")],
    _key_type("event_id"), _key_type("user_id"),
    "SELECT 'value', 'numerical'", "SELECT 'code', 'numerical'", "SELECT 'ts', 'datetime'",
    "SELECT 'is_big', CASE WHEN bool_and(is_big IN (0, 1)) THEN 'boolean' ELSE 'numerical' END FROM t"]) + ")\n"


@query("detect_schema", _TYPES + 'SELECT "column", semantic_type FROM types')
def _(spark, sf):
    return S.detect_schema(mixed(spark, sf)).select("column", "semantic_type")


@query("schema_summary", _TYPES + """
SELECT k.semantic_type, count(t."column") AS columns
FROM (VALUES ('numerical'), ('categorical'), ('datetime'), ('boolean'), ('identifier')) k(semantic_type)
LEFT JOIN types t USING (semantic_type) GROUP BY 1""")
def _(spark, sf):
    return S.schema_summary(S.detect_schema(mixed(spark, sf)))


@query("columns_by_type", _TYPES + "SELECT \"column\" FROM types WHERE semantic_type = 'datetime'")
def _(spark, sf):
    return S.columns_of_type(S.detect_schema(mixed(spark, sf)), "datetime").select("column")


# Filters over result tables.

def _key_issues(spark, sf):
    events = table(spark, sf, "events")
    profile = column_profile(events)
    return R.quality_issues(profile, dataset_profile(events, profile))


@query("issues_by_severity", """
SELECT 'IDENTIFIER_FEATURE' AS rule_id, k AS "column" FROM (VALUES ('event_id'), ('user_id')) v(k)
WHERE (SELECT count(DISTINCT event_id) > 1 AND count(DISTINCT user_id) > 1 FROM events)""")
def _(spark, sf):
    return B.issues_by_severity(_key_issues(spark, sf), "info").select("rule_id", "column")


@query("issues_by_column", """
SELECT 'IDENTIFIER_FEATURE' AS rule_id, 'INFO' AS severity
WHERE (SELECT count(DISTINCT user_id) > 1 FROM events)""")
def _(spark, sf):
    return B.issues_by_column(_key_issues(spark, sf), "user_id").select("rule_id", "severity")


_DOC_SHARES = """WITH s AS (
  SELECT max(n) * 100.0 / sum(n) AS share, count(*) AS k FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1))
"""


def _document_findings(spark, sf):
    return analyze_statistics(table(spark, sf, "documents"))["findings"]


@query("findings_by_column", _DOC_SHARES + """
SELECT 'cat_concentration_lang' AS finding_id, CASE WHEN share >= 80 THEN 'HIGH' ELSE 'MEDIUM' END AS importance
FROM s WHERE share >= 50""")
def _(spark, sf):
    found = B.findings_by_column(B.findings_by_type(_document_findings(spark, sf), "CATEGORY"), "lang")
    return found.select("finding_id", "importance")


@query("findings_by_importance", """
SELECT 'dist_n_chars' AS finding_id, 'DISTRIBUTION' AS finding_type WHERE (SELECT skewness(n_chars) >= 2 FROM documents)""")
def _(spark, sf):
    found = B.findings_by_importance(_document_findings(spark, sf), "high")
    return B.findings_by_type(found, "DISTRIBUTION").select("finding_id", "finding_type")
