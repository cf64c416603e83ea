"""Feature preparation on the mixed events table."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from facetframe.operators import features as FE

from .browsing import MIXED_SQL, mixed
from .registry import query, rounded

# Gaps in the number and the category, so that imputation has work to do.
_GAPPY_SQL = f"""WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS kind, trim(big) AS big, iso_day,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS ts, user_id AS visitor FROM ({MIXED_SQL}))
"""


def gappy(spark, sf):
    key = F.col("event_id")
    return mixed(spark, sf).select(
        "event_id", F.when(key % 7 != 0, F.col("value")).alias("value"),
        F.when(key % 5 != 0, F.col("event_type")).alias("kind"), F.trim("big").alias("big"), "iso_day",
        F.when(key % 3 != 0, F.col("ts")).alias("ts"), F.col("user_id").alias("visitor"))


def _fit(spark, sf, columns, **options):
    df = gappy(spark, sf)
    return df, FE.fit_features(df.select(*columns), **options)


@query("feature_roles", f"""WITH t AS ({MIXED_SQL})
SELECT c AS "column", CASE WHEN c IN ('event_id', 'user_id') THEN 'excluded'
    WHEN share >= 0.99 THEN 'excluded' WHEN n <= 1 THEN 'excluded' WHEN c IN ('iso_day', 'written_day') THEN 'datetime'
    WHEN n > 50 THEN 'excluded' ELSE 'categorical' END AS role,
  CASE WHEN c IN ('event_id', 'user_id') THEN 'identifier (name_matches_pattern__id$)'
    WHEN share >= 0.99 THEN 'identifier (high_uniqueness_text)' WHEN n <= 1 THEN 'constant_feature'
    WHEN c IN ('iso_day', 'written_day') THEN NULL
    WHEN n > 50 THEN 'high_cardinality (' || n || ' unique > threshold 50)' END AS reason
FROM (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS c, count(DISTINCT {c}) AS n, count(DISTINCT {c}) / count({c}) AS share FROM t"
    for c in ("event_id", "user_id", "event_type", "ts", "props", "big", "iso_day", "written_day", "token")) + """)
UNION ALL SELECT c, 'numeric', NULL FROM (VALUES ('value'), ('is_big'), ('code')) v(c)""")
def _(spark, sf):
    return FE.feature_roles(mixed(spark, sf))


@query("impute_numeric", _GAPPY_SQL + """
SELECT 'median' AS strategy, round(median(value), 4) AS fill FROM t UNION ALL
SELECT 'mean', round(avg(value), 4) FROM t UNION ALL SELECT 'zero', 0.0::DOUBLE""")
def _(spark, sf):
    rows = []
    for strategy in ("median", "mean", "zero"):
        _, model = _fit(spark, sf, ["value"], numeric_imputation=strategy, scaling=None)
        rows.append((strategy, model.numeric_fill["value"]))
    return rounded(spark.createDataFrame(rows, "strategy string, fill double"))


@query("impute_category", _GAPPY_SQL + """
SELECT kind AS fill FROM t WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""")
def _(spark, sf):
    _, model = _fit(spark, sf, ["kind"], scaling=None)
    return spark.createDataFrame([(model.category_fill["kind"],)], "fill string")


@query("imputed_rows", _GAPPY_SQL + """
SELECT event_id, coalesce(value, (SELECT median(value) FROM t)) AS value FROM t""")
def _(spark, sf):
    df, model = _fit(spark, sf, ["value"], scaling=None)
    return model.transform(df, ["event_id"])


@query("one_hot", _GAPPY_SQL + """, m AS (SELECT kind FROM t WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
s AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'never seen' ELSE coalesce(kind, (SELECT kind FROM m)) END AS k FROM t)
SELECT event_id, 'kind_' || c AS feature, (k = c)::INTEGER::DOUBLE AS value
FROM s, (SELECT DISTINCT kind AS c FROM t WHERE kind IS NOT NULL)""")
def _(spark, sf):
    df, model = _fit(spark, sf, ["kind"], scaling=None)
    unseen = F.when(F.col("event_id") % 11 == 0, "never seen").otherwise(F.col("kind"))
    return FE.tall(model.transform(df.withColumn("kind", unseen), ["event_id"]), model.feature_names, ["event_id"])


@query("encode_boolean", _GAPPY_SQL + "SELECT event_id, (big = 'Yes')::INTEGER::DOUBLE AS big FROM t")
def _(spark, sf):
    df, model = _fit(spark, sf, ["big"], scaling=None)
    return model.transform(df, ["event_id"])


@query("datetime_parts", _GAPPY_SQL + """
SELECT event_id, coalesce(year(ts), 2000)::DOUBLE AS ts_year, coalesce(month(ts), 1)::DOUBLE AS ts_month,
  coalesce(day(ts), 1)::DOUBLE AS ts_day, coalesce(isodow(ts) - 1, 0)::DOUBLE AS ts_dayofweek FROM t""")
def _(spark, sf):
    df, model = _fit(spark, sf, ["iso_day"], scaling=None)
    # the fitted text column names the parts; typed gaps take the same way
    renamed = df.select("event_id", F.col("ts").alias("iso_day"))
    out = model.transform(renamed, ["event_id"])
    return out.withColumnsRenamed({f"iso_day_{p}": f"ts_{p}" for p, _ in FE.DATE_PARTS})


_SCALED = {
    "standard": ("avg(x)", "stddev_pop(x)"), "minmax": ("min(x)", "max(x) - min(x)"),
    "robust": ("median(x)", "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)")}

for _scaling, (_centre, _scale) in _SCALED.items():
    @query(f"scale_{_scaling}", _GAPPY_SQL + f"""
, v AS (SELECT event_id, coalesce(value, (SELECT median(value) FROM t)) AS x FROM t),
s AS (SELECT {_centre} AS c, {_scale} AS w FROM v)
SELECT event_id, round((x - c) / w, 6) AS value FROM v, s""")
    def _(spark, sf, scaling=_scaling):
        df, model = _fit(spark, sf, ["value"], scaling=scaling)
        return rounded(model.transform(df, ["event_id"]), 6)


@query("scale_mixed", _GAPPY_SQL + """
, m AS (SELECT kind FROM t WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
k AS (SELECT DISTINCT kind AS c FROM t WHERE kind IS NOT NULL),
u AS (SELECT event_id, 'value' AS feature, coalesce(value, (SELECT median(value) FROM t)) AS x FROM t
 UNION ALL SELECT event_id, 'big', (big = 'Yes')::INTEGER FROM t
 UNION ALL SELECT event_id, 'iso_day_year', year(iso_day::DATE) FROM t
 UNION ALL SELECT event_id, 'iso_day_month', month(iso_day::DATE) FROM t
 UNION ALL SELECT event_id, 'iso_day_day', day(iso_day::DATE) FROM t
 UNION ALL SELECT event_id, 'iso_day_dayofweek', isodow(iso_day::DATE) - 1 FROM t
 UNION ALL SELECT event_id, 'kind_' || c, (coalesce(kind, (SELECT kind FROM m)) = c)::INTEGER FROM t, k),
s AS (SELECT feature, avg(x) AS c, stddev_pop(x) AS w FROM u GROUP BY 1)
SELECT event_id, feature, round((x - c) / CASE WHEN w = 0 THEN 1 ELSE w END, 6) + 0.0 AS value FROM u JOIN s USING (feature)""")
def _(spark, sf):
    df, model = _fit(spark, sf, ["value", "kind", "big", "iso_day"])
    return rounded(FE.tall(model.transform(df, ["event_id"]), model.feature_names, ["event_id"]), 6)


@query("assemble", _GAPPY_SQL + """
SELECT event_id, 6 + (SELECT count(DISTINCT kind) FROM t) AS size, coalesce(value, (SELECT median(value) FROM t)) AS first_feature FROM t""")
def _(spark, sf):
    df, model = _fit(spark, sf, ["value", "kind", "big", "iso_day"], scaling=None)
    vectors = FE.assemble(model.transform(df, ["event_id"]), model.feature_names)
    values = vector_to_array("features")
    return vectors.select("event_id", F.size(values).cast("long").alias("size"), values[0].alias("first_feature"))


@query("preprocessing_summary", _GAPPY_SQL + """
SELECT * FROM (VALUES ('numeric', 'value'), ('categorical', 'kind'), ('boolean', 'big'), ('datetime', 'iso_day'),
  ('strategy', 'numeric_imputation'), ('strategy', 'encoding'), ('strategy', 'scaling')) v(item, name)
UNION ALL SELECT 'feature', 'kind_' || kind FROM (SELECT DISTINCT kind FROM t WHERE kind IS NOT NULL)
UNION ALL SELECT 'feature', f FROM (VALUES ('value'), ('big'), ('iso_day_year'), ('iso_day_month'), ('iso_day_day'), ('iso_day_dayofweek')) w(f)""")
def _(spark, sf):
    _, model = _fit(spark, sf, ["value", "kind", "big", "iso_day"])
    return model.summary(spark).where(
        F.col("item").isin("numeric", "categorical", "boolean", "datetime", "strategy", "feature")).select("item", "name")
