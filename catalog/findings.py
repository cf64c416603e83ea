"""Correlations, shapes, categories, groups, trends and the merged findings."""

from pyspark.sql import functions as F

from facetframe.operators import correlation as C
from facetframe.operators import findings as A
from facetframe.operators import groups as G
from facetframe.operators import trend as T
from facetframe.operators.distribution import distribution_shape
from facetframe.operators.profile import column_profile

from .registry import query, rounded, table, union_all

_PAIR_COLUMNS = ("discount", "gap", "price", "quantity", "revenue")
_PAIR_SOURCE = """(SELECT l_discount AS discount, l_quantity AS quantity, l_extendedprice AS price,
  l_extendedprice * (1 - l_discount) AS revenue, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity + l_discount END AS gap
  FROM lineitem)"""
_LABELS = """CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction,
  CASE WHEN abs(r) >= 0.7 THEN 'very strong' WHEN abs(r) >= 0.5 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength"""


def _pairs(columns, source: str) -> str:
    return union_all([
        f"SELECT '{x}' AS column_x, '{y}' AS column_y, corr({x}, {y}) AS r, regr_count({y}, {x})::BIGINT AS n FROM {source}"
        for i, x in enumerate(columns) for y in columns[i + 1:]])


def _numbers(spark, sf):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_discount").alias("discount"), quantity.alias("quantity"), price.alias("price"),
        (price * (1 - F.col("l_discount"))).alias("revenue"),
        F.when(F.col("l_linenumber") != 7, quantity + F.col("l_discount")).alias("gap"))


@query("correlation_pairs", f"""
SELECT column_x, column_y, round(r, 4) AS coefficient, n AS sample_size, {_LABELS}
FROM ({_pairs(_PAIR_COLUMNS, _PAIR_SOURCE)}) WHERE abs(r) >= 0.3""")
def _(spark, sf):
    return C.correlation_pairs(_numbers(spark, sf)).drop("p_value", "importance")


@query("correlation_pairs_by_matrices", f"""
SELECT column_x, column_y, round(r, 4) AS coefficient, n AS sample_size, {_LABELS}
FROM ({_pairs(_PAIR_COLUMNS, _PAIR_SOURCE)})""")
def _(spark, sf):
    # the path of tables with very many pairs
    return C.correlation_pairs(_numbers(spark, sf), min_correlation=0.0, wide_agg_pairs=0).drop("p_value", "importance")


_INFINITE = """(SELECT l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b,
  CASE WHEN l_linenumber = 3 THEN 'inf'::DOUBLE ELSE l_discount END AS c, CASE WHEN l_linenumber <> 3 THEN l_tax END AS d FROM lineitem)"""


def _with_infinities(name: str, limit: int):
    @query(name, f"""
SELECT 'a' AS column_x, 'b' AS column_y, round(corr(a, b), 4) AS coefficient, regr_count(a, b)::BIGINT AS sample_size FROM {_INFINITE}
UNION ALL SELECT 'a', 'd', round(corr(a, d), 4), regr_count(a, d)::BIGINT FROM {_INFINITE}
UNION ALL SELECT 'b', 'd', round(corr(b, d), 4), regr_count(b, d)::BIGINT FROM {_INFINITE}
UNION ALL SELECT 'c', 'd', round(corr(c, d), 4), regr_count(c, d)::BIGINT FROM {_INFINITE} WHERE d IS NOT NULL""")
    def _(spark, sf):
        # c is infinite only where d is missing, so (c, d) is defined, (a, c) and (b, c) are not
        third = F.col("l_linenumber") == 3
        df = table(spark, sf, "lineitem").select(
            F.col("l_quantity").cast("double").alias("a"), F.col("l_extendedprice").cast("double").alias("b"),
            F.when(third, float("inf")).otherwise(F.col("l_discount")).alias("c"), F.when(~third, F.col("l_tax")).alias("d"))
        return C.correlation_pairs(df, min_correlation=0.0, wide_agg_pairs=limit).select(
            "column_x", "column_y", "coefficient", "sample_size")


_with_infinities("correlation_with_infinities", 45)
_with_infinities("correlation_with_infinities_by_matrices", 0)


@query("correlation_strength", f"""
SELECT column_x, column_y, {_LABELS}, CASE WHEN abs(r) >= 0.7 THEN 'HIGH' WHEN abs(r) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS importance
FROM ({_pairs(("a", "b", "c", "d"), '''(SELECT l_quantity AS a, l_quantity + 20 * l_linenumber AS b,
  l_quantity + 9 * l_linenumber AS c, -l_quantity - 8 * l_linenumber AS d FROM lineitem)''')}) WHERE abs(r) >= 0.3""")
def _(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    df = table(spark, sf, "lineitem").select(q.alias("a"), (q + 20 * n).alias("b"), (q + 9 * n).alias("c"),
                                             (-q - 8 * n).alias("d"))
    return C.correlation_pairs(df).select("column_x", "column_y", "direction", "strength", "importance")


@query("correlation_cap", f"""
SELECT column_x, column_y FROM ({_pairs(_PAIR_COLUMNS, _PAIR_SOURCE)}) ORDER BY abs(r) DESC LIMIT 2""")
def _(spark, sf):
    return C.correlation_pairs(_numbers(spark, sf), max_pairs=2).select("column_x", "column_y")


def _shape(c: str, source: str) -> str:
    return f"""SELECT '{c}' AS "column", round(s, 4) AS skewness, round(k, 4) AS kurtosis, round(m, 3) AS mean,
      CASE WHEN abs(s) >= 2 THEN 'extremely ' WHEN abs(s) >= 1 THEN 'strongly ' WHEN abs(s) >= 0.5 THEN 'moderately ' ELSE '' END ||
      CASE WHEN abs(s) < 0.5 THEN 'approximately symmetric' WHEN s > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS skewness_classification,
      CASE WHEN abs(s) >= 2 THEN 'HIGH' WHEN abs(s) >= 1 THEN 'MEDIUM' WHEN abs(s) >= 0.5 THEN 'LOW' ELSE 'INFO' END AS importance
      FROM (SELECT skewness({c}) AS s, kurtosis({c}) AS k, avg({c}) AS m FROM {source})"""


@query("distribution_shape", union_all([_shape("n_chars", "documents"), _shape("value", "events"),
                                        _shape("minus", "(SELECT -value AS minus FROM events)"),
                                        _shape("o_totalprice", "orders")]))
def _(spark, sf):
    events = table(spark, sf, "events")
    tables = [table(spark, sf, "documents").select("n_chars"),
              events.select("value", (-F.col("value")).alias("minus")),
              table(spark, sf, "orders").select("o_totalprice")]
    shapes = [distribution_shape(column_profile(t)) for t in tables]
    out = shapes[0].unionByName(shapes[1]).unionByName(shapes[2])
    return rounded(out, 4).withColumn("mean", F.round("mean", 3)).select(
        "column", "skewness", "kurtosis", "mean", "skewness_classification", "importance")


def _share(c: str, source: str) -> str:
    return f"""SELECT '{c}' AS "column", {c} AS dominant_category, n AS dominant_count, k AS unique_categories, share
      FROM (SELECT {c}, n, count(*) OVER () AS k, n * 100.0 / sum(n) OVER () AS share,
                   row_number() OVER (ORDER BY n DESC, {c}) AS place
            FROM (SELECT {c}, count(*) AS n FROM {source} GROUP BY 1)) WHERE place = 1"""


_SHARES = union_all([_share("lang", "documents"), _share("source", "documents"), _share("role", "conversations"),
                     _share("quality", "(SELECT quality::VARCHAR AS quality FROM labels)"),
                     _share("c_mktsegment", "customer"), _share("event_type", "events")])


def _category_profiles(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("quality").cast("string").alias("quality"))
    return [column_profile(t) for t in (
        table(spark, sf, "documents").select("lang", "source"), table(spark, sf, "conversations").select("role"),
        labels, table(spark, sf, "customer").select("c_mktsegment"), table(spark, sf, "events").select("event_type"))]


def _all_shares(spark, sf, operator):
    parts = [operator(p) for p in _category_profiles(spark, sf)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("column", "dominant_category", "dominant_count", "unique_categories",
                      F.round("dominant_share_pct", 2).alias("dominant_share_pct"), "importance")


@query("category_concentration", f"""
SELECT "column", dominant_category, dominant_count, unique_categories, round(share, 2) AS dominant_share_pct,
  CASE WHEN share >= 80 THEN 'HIGH' ELSE 'MEDIUM' END AS importance FROM ({_SHARES}) WHERE share >= 50""")
def _(spark, sf):
    return _all_shares(spark, sf, G.category_concentration)


@query("category_balance", f"""
SELECT "column", dominant_category, dominant_count, unique_categories, round(share, 2) AS dominant_share_pct,
  'INFO' AS importance FROM ({_SHARES}) WHERE share < 50 AND unique_categories >= 3 AND share <= 35""")
def _(spark, sf):
    return _all_shares(spark, sf, G.category_balance)


def _groups(c: str, v: str, source: str) -> str:
    return f"""SELECT '{c}' AS categorical_column, '{v}' AS numerical_column, {c} AS group_name, count(*) AS count,
      avg({v}) AS mean, quantile_cont({v}::DOUBLE, 0.5) AS median, stddev_samp({v}) AS std,
      min({v})::DOUBLE AS min, max({v})::DOUBLE AS max
      FROM {source} WHERE {c} IS NOT NULL AND {v} IS NOT NULL GROUP BY {c}
      QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) <= 8"""


_LINE_GROUPS = union_all([
    _groups(c, v, "(SELECT *, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS tax FROM lineitem)")
    for c in ("l_linestatus", "l_returnflag") for v in ("l_extendedprice", "l_quantity", "tax")])
_DOC_GROUPS = union_all([_groups(c, "n_chars", "documents") for c in ("lang", "source")])


def _lines(spark, sf):
    tax = F.when(F.col("l_linenumber") != 7, F.col("l_tax"))
    return table(spark, sf, "lineitem").withColumn("tax", tax)


@query("group_summary", f"""
SELECT categorical_column, numerical_column, group_name, count, round(mean, 2) AS mean, round(median, 2) AS median,
  round(std, 2) AS std, round(min, 2) AS min, round(max, 2) AS max FROM ({_LINE_GROUPS} UNION ALL {_DOC_GROUPS})""")
def _(spark, sf):
    lines = G.group_summary(_lines(spark, sf), ["l_linestatus", "l_returnflag"],
                            ["l_extendedprice", "l_quantity", "tax"])
    return lines.unionByName(G.group_summary(table(spark, sf, "documents"), ["lang", "source"], ["n_chars"]))


@query("group_variation", f"""
SELECT categorical_column, numerical_column, count(*) AS groups, round(max(mean) / min(mean), 2) AS variation_ratio,
  arg_max(group_name, mean) AS top_group, round(max(mean), 2) AS top_mean, arg_min(group_name, mean) AS bottom_group,
  round(min(mean), 2) AS bottom_mean,
  CASE WHEN round(max(mean) / min(mean), 2) >= 2 THEN 'HIGH' WHEN round(max(mean) / min(mean), 2) >= 1.3 THEN 'MEDIUM' END AS importance
FROM ({_LINE_GROUPS} UNION ALL {_DOC_GROUPS}) GROUP BY 1, 2""")
def _(spark, sf):
    lines = G.group_summary(_lines(spark, sf), ["l_linestatus", "l_returnflag"],
                            ["l_extendedprice", "l_quantity", "tax"], digits=None)
    docs = G.group_summary(table(spark, sf, "documents"), ["lang", "source"], ["n_chars"], digits=None)
    return G.group_variation(lines.unionByName(docs))


_PERIODS = {
    "daily": ("ts", "value", "events", "ts::DATE"),
    "weekly": ("o_orderdate", "o_totalprice", "(SELECT * FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1996-12-01')",
               "(date_trunc('week', o_orderdate) + INTERVAL 6 DAY)::DATE"),
    "monthly": ("o_orderdate", "o_totalprice", "orders", "last_day(o_orderdate)")}


def _means(frequency: str) -> str:
    date, value, source, bucket = _PERIODS[frequency]
    return f"""SELECT '{date}' AS datetime_column, '{value}' AS numerical_column, '{frequency}' AS period_frequency,
      {bucket} AS period, avg({value}) AS mean FROM {source} GROUP BY 4"""


def _periods(spark, sf, frequency: str):
    date, value, _, _ = _PERIODS[frequency]
    df = table(spark, sf, "events" if frequency == "daily" else "orders")
    if frequency == "weekly":
        df = df.where("o_orderdate >= '1996-01-01' AND o_orderdate < '1996-12-01'")
    return T.period_means(df, date, [value])


for _frequency in _PERIODS:
    @query(f"period_means_{_frequency}", f"""SELECT datetime_column, numerical_column, period_frequency,
      strftime(period, '%Y-%m-%d') AS period, round(mean, 4) AS mean FROM ({_means(_frequency)})""")
    def _(spark, sf, frequency=_frequency):
        return rounded(_periods(spark, sf, frequency)).select(
            "datetime_column", "numerical_column", "period_frequency",
            F.date_format("period", "yyyy-MM-dd").alias("period"), "mean")


def _fit(frequency: str, source: str | None = None) -> str:
    return f"""SELECT datetime_column, numerical_column, period_frequency, count(*) AS periods_count,
      regr_slope(mean, x) AS slope, regr_r2(mean, x) AS r2
      FROM (SELECT *, row_number() OVER (ORDER BY period) - 1 AS x FROM ({source or _means(frequency)})) GROUP BY 1, 2, 3"""


@query("trend_fit", union_all([f"""SELECT datetime_column, numerical_column, period_frequency, periods_count,
  round(slope, 4) AS slope, round(r2, 4) AS r_squared FROM ({_fit(f)})""" for f in _PERIODS]))
def _(spark, sf):
    means = [_periods(spark, sf, f) for f in _PERIODS]
    return T.trend_fit(means[0].unionByName(means[1]).unionByName(means[2])).select(
        "datetime_column", "numerical_column", "period_frequency", "periods_count", "slope", "r_squared")


# A number that grows with time, one that falls and one without a trend.
_DRIFT = """SELECT 'o_orderdate' AS datetime_column, '{name}' AS numerical_column, 'monthly' AS period_frequency,
  last_day(o_orderdate) AS period, avg({expr}) AS mean FROM orders GROUP BY 4"""
_DRIFTS = {"falling": "-epoch(o_orderdate) / 86400.0", "growing": "o_totalprice + 1000 * epoch(o_orderdate) / 86400.0",
           "level": "o_totalprice"}


def _drifting(spark, sf):
    day = F.unix_date(F.to_date("o_orderdate")).cast("double")
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderdate", (-day).alias("falling"),
                                             (price + 1000 * day).alias("growing"), price.alias("level"))


@query("trend_direction", "SELECT numerical_column, CASE WHEN r2 >= 0.25 THEN CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END"
       " ELSE 'stable' END AS direction, CASE WHEN r2 >= 0.6 THEN 'HIGH' WHEN r2 >= 0.25 THEN 'MEDIUM' END AS importance FROM ("
       + union_all([_fit("monthly", _DRIFT.format(name=n, expr=e)) for n, e in _DRIFTS.items()]) + ")")
def _(spark, sf):
    df = _drifting(spark, sf)
    return T.trends(df, column_profile(df)).select("numerical_column", "direction", "importance")


_FINDINGS = f"""
WITH d AS (SELECT o_orderdate, o_orderstatus, {", ".join(f"{e} AS {n}" for n, e in _DRIFTS.items())} FROM orders),
shapes AS ({_shape("falling", "d")} UNION ALL {_shape("growing", "d")} UNION ALL {_shape("level", "d")}),
pairs AS ({_pairs(("falling", "growing", "level"), "d")}),
groups AS ({union_all([_groups("o_orderstatus", n, "d") for n in _DRIFTS])}),
ratios AS (SELECT numerical_column AS v, round(CASE WHEN min(mean) > 0 THEN max(mean) / min(mean)
   WHEN min(mean) < 0 AND max(mean) > 0 THEN (max(mean) - min(mean)) / greatest(abs(min(mean)), abs(max(mean))) END, 2) AS ratio FROM groups GROUP BY 1),
f AS (
SELECT 'corr_' || column_x || '_' || column_y AS finding_id, 'CORRELATION' AS finding_type,
  CASE WHEN abs(r) >= 0.7 THEN 'HIGH' WHEN abs(r) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS importance FROM pairs WHERE abs(r) >= 0.3
UNION ALL SELECT 'dist_' || "column", 'DISTRIBUTION', importance FROM shapes
UNION ALL SELECT CASE WHEN share >= 50 THEN 'cat_concentration_' ELSE 'cat_balanced_' END || "column", 'CATEGORY',
  CASE WHEN share >= 80 THEN 'HIGH' WHEN share >= 50 THEN 'MEDIUM' ELSE 'INFO' END FROM ({_share("o_orderstatus", "d")})
  WHERE share >= 50 OR (unique_categories >= 3 AND share <= 35)
UNION ALL SELECT 'rel_o_orderstatus_' || v, 'GROUP_RELATIONSHIP', CASE WHEN ratio >= 2 THEN 'HIGH' ELSE 'MEDIUM' END FROM ratios WHERE ratio >= 1.3
UNION ALL SELECT 'trend_o_orderdate_' || numerical_column, 'TEMPORAL_TREND', CASE WHEN r2 >= 0.6 THEN 'HIGH' ELSE 'MEDIUM' END
  FROM ({union_all([_fit("monthly", _DRIFT.format(name=n, expr=e)) for n, e in _DRIFTS.items()])}) WHERE r2 >= 0.25)
"""


def drift_findings(spark, sf):
    day = F.unix_date(F.to_date("o_orderdate")).cast("double")
    price = F.col("o_totalprice")
    df = table(spark, sf, "orders").select("o_orderdate", "o_orderstatus", (-day).alias("falling"), (price + 1000 * day).alias("growing"),
                       price.alias("level"))
    return A.analyze_statistics(df)


@query("findings", _FINDINGS + "SELECT * FROM f")
def _(spark, sf):
    return drift_findings(spark, sf)["findings"].select("finding_id", "finding_type", "importance")


@query("finding_counts", _FINDINGS + """
SELECT k.finding_type, count(f.finding_id) AS findings FROM (VALUES ('CORRELATION'), ('DISTRIBUTION'), ('CATEGORY'),
  ('GROUP_RELATIONSHIP'), ('TEMPORAL_TREND')) k(finding_type) LEFT JOIN f USING (finding_type) GROUP BY 1""")
def _(spark, sf):
    return A.finding_counts(drift_findings(spark, sf)["findings"])


@query("stage_counts", _FINDINGS + """
SELECT 'correlations' AS stage, count(*) AS rows FROM pairs WHERE abs(r) >= 0.3
UNION ALL SELECT 'distributions', count(*) FROM shapes
UNION ALL SELECT 'relationships', count(*) FROM ratios
UNION ALL SELECT 'trends', 3""")
def _(spark, sf):
    return A.stage_counts(drift_findings(spark, sf))
