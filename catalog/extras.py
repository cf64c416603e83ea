"""Rank correlation, histograms, entropy, interquartile range, tests of group differences."""

from pyspark.sql import functions as F

from facetframe.functions.dates import parse_text
from facetframe.operators import extensions as X
from facetframe.operators.profile import column_profile

from .registry import query, rounded, table, union_all

_RANKED = """(SELECT (count(*) OVER (PARTITION BY {x} ) + 1) / 2.0 + rank() OVER (ORDER BY {x}) - 1 AS {x},
  (count(*) OVER (PARTITION BY {y}) + 1) / 2.0 + rank() OVER (ORDER BY {y}) - 1 AS {y} FROM lineitem)"""
_SPEARMAN = [("l_discount", "l_extendedprice"), ("l_discount", "l_quantity"), ("l_extendedprice", "l_quantity")]


@query("spearman_pairs", union_all([
    f"SELECT '{x}' AS column_x, '{y}' AS column_y, round(corr({x}, {y}), 6) AS rho, count(*) AS sample_size FROM {_RANKED.format(x=x, y=y)}"
    for x, y in _SPEARMAN]))
def _(spark, sf):
    return rounded(X.spearman_pairs(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]), 6)


@query("histogram", """
WITH b AS (SELECT min(o_totalprice) AS low, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders)
SELECT bin, round(low + bin * w, 4) AS low, round(low + (bin + 1) * w, 4) AS high, n AS count FROM b,
 (SELECT least(floor((o_totalprice - low) / w), 9)::INTEGER AS bin, count(*) AS n FROM orders, b GROUP BY 1)""")
def _(spark, sf):
    return rounded(X.histogram(table(spark, sf, "orders"), "o_totalprice", 10))


@query("entropy", union_all([
    f"""SELECT '{c}' AS "column", round(-sum(n / total * log2(n / total)), 6) AS entropy
    FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER () AS total FROM lineitem GROUP BY {c})"""
    for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate")]))
def _(spark, sf):
    return rounded(X.entropy(table(spark, sf, "lineitem"),
                             ["l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate"]), 6)


@query("iqr", union_all([
    f"SELECT '{c}' AS \"column\", round(quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25), 4) AS iqr FROM part"
    for c in ("p_partkey", "p_size", "p_retailprice")]))
def _(spark, sf):
    return rounded(X.iqr(column_profile(table(spark, sf, "part"))))


@query("anova", """
SELECT count(*) AS groups, sum(n)::BIGINT AS rows, round(sum(n * (m - g) ^ 2), 2) AS ss_between, round(sum(n * v), 2) AS ss_within,
  round(sum(n * (m - g) ^ 2) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 6) AS f
FROM (SELECT count(*) AS n, avg(n_chars) AS m, var_pop(n_chars) AS v FROM documents GROUP BY source), (SELECT avg(n_chars) AS g FROM documents)""")
def _(spark, sf):
    out = X.anova(table(spark, sf, "documents"), "source", "n_chars")
    return rounded(rounded(out, 6).drop("p_value"), 6).selectExpr(
        "groups", "rows", "round(ss_between, 2) AS ss_between", "round(ss_within, 2) AS ss_within", "f")


@query("kruskal", """
WITH r AS (SELECT source, n_chars, (count(*) OVER (PARTITION BY n_chars) + 1) / 2.0 + rank() OVER (ORDER BY n_chars) - 1 AS r FROM documents),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM documents GROUP BY n_chars))
SELECT count(*) AS groups, any_value(n)::BIGINT AS rows,
  round((12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / c) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (any_value(n) ^ 3 - any_value(n))), 6) AS h
FROM (SELECT source, sum(r) AS s, count(*) AS c FROM r GROUP BY 1), n, t""")
def _(spark, sf):
    return rounded(X.kruskal(table(spark, sf, "documents"), "source", "n_chars"), 6)


@query("date_spellings", """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN date_trunc('month', o_orderdate)::DATE ELSE o_orderdate::DATE END AS day FROM orders""")
def _(spark, sf):
    forms = ("MMM d, yyyy", "d MMMM yyyy", "dd-MMMM-yyyy", "yyyy.MM.dd", "MM/dd/yyyy h:mm a", "dd-MMM-yy", "M/d/yy", "yyyy-MM")
    which = F.col("o_orderkey") % len(forms)
    spelled = F.coalesce(*[F.when(which == i, F.date_format("o_orderdate", f)) for i, f in enumerate(forms)])
    return table(spark, sf, "orders").select("o_orderkey", parse_text(spelled).cast("date").alias("day"))
