"""Reading model answers: a table of texts becomes tables of insights and recommendations.

The answers are parsed by Spark's own JSON functions, row by row and without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col

# What an absent field of an insight or recommendation becomes.
INSIGHT_DEFAULTS = {"title": "Untitled Insight", "importance": "INFO", "category": "general"}
RECOMMENDATION_DEFAULTS = {"title": "Technical Recommendation", "action_type": "investigation",
                           "priority": "medium"}
FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"
BRACES = r"(?s)(\{.*\})"


def json_text(response: Column) -> Column:
    """The fenced block, else the outermost braces, else the whole answer."""
    plain = F.trim(response)
    return (F.when(plain.rlike(FENCE), F.trim(F.regexp_extract(plain, FENCE, 1)))
            .when(plain.rlike(BRACES), F.regexp_extract(plain, BRACES, 1)).otherwise(plain))


def _kind(c: Column) -> Column:
    """First character of a JSON value tells its kind."""
    return F.substring(F.ltrim(c), 1, 1)


def _field(name: str) -> Column:
    return F.expr(f"variant_get(payload, '$.{name}', 'string')")


def parse_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """The rows with executive_summary, error and the raw insights, recommendations, warnings.

    A bad answer keeps its row and gets an ``error`` instead of a summary.
    """
    body = json_text(col(text))
    parsed = responses.withColumn("_body", body).withColumn("payload", F.try_parse_json("_body"))
    blank = F.coalesce(F.trim(col(text)), F.lit("")) == ""
    is_object = _kind(F.col("_body")) == "{"
    summary = F.trim(_field("executive_summary"))

    def not_list(name: str) -> Column:
        value = F.expr(f"try_variant_get(payload, '$.{name}', 'variant')")
        return value.isNotNull() & ~F.schema_of_variant(value).startswith("ARRAY")

    has_summary = F.expr("try_variant_get(payload, '$.executive_summary', 'variant')").isNotNull()
    error = (F.when(blank, "the answer is empty")
             .when(F.col("payload").isNull(), "the answer is not valid JSON")
             .when(~is_object, "the answer is not a JSON object")
             .when(~has_summary, "executive_summary is missing")
             .when(F.coalesce(summary, F.lit("None")) == "", "executive_summary is blank")
             .when(not_list("insights"), "insights is not a list")
             .when(not_list("recommendations"), "recommendations is not a list"))
    out = parsed.withColumn("error", error)
    ok = F.col("error").isNull()
    return out.select(
        *[col(c) for c in responses.columns if c != text],
        F.when(ok, F.coalesce(summary, F.lit("None"))).alias("executive_summary"), "error",
        *[F.when(ok, F.expr(f"try_variant_get(payload, '$.{n}', 'array<variant>')")).alias(n)
          for n in ("insights", "recommendations", "warnings")])


def _text_of(name: str) -> Column:
    return F.expr(f"try_variant_get(item, '$.{name}', 'string')")


def _list_of(name: str) -> Column:
    """A list of texts; a single value counts as a list of one."""
    many = F.expr(f"try_variant_get(item, '$.{name}', 'array<string>')")
    one = _text_of(name)
    return F.coalesce(many, F.when(F.coalesce(one, F.lit("")) != "", F.array(one)),
                      F.array().cast("array<string>"))


def _items(parsed: DataFrame, name: str) -> DataFrame:
    keep = [c for c in parsed.columns if c not in ("executive_summary", "error", "insights",
                                                   "recommendations", "warnings")]
    # the outer form keeps Spark from repeating the parsing in a filter before the explode
    rows = parsed.select(*[col(c) for c in keep], F.posexplode_outer(name).alias("place", "item"))
    return rows.where(F.schema_of_variant("item").startswith("OBJECT"))


def insights(parsed: DataFrame) -> DataFrame:
    """One row per insight of every good answer."""
    rows = _items(parsed, "insights")
    title = F.coalesce(_text_of("title"), F.lit(INSIGHT_DEFAULTS["title"]))
    summary = F.coalesce(_text_of("summary"), title)
    caveats = _text_of("caveats")
    evidence = F.to_json(F.expr("try_variant_get(item, '$.evidence', 'variant')"))
    raw = F.to_json(F.struct(_text_of("evidence").alias("raw_evidence")))
    return rows.select(
        *[col(c) for c in rows.columns if c not in ("place", "item")],
        F.coalesce(_text_of("insight_id"), F.format_string("INSIGHT_%02d", F.col("place") + 1)).alias("insight_id"),
        title.alias("title"), summary.alias("summary"),
        F.coalesce(_text_of("explanation"), summary).alias("explanation"),
        F.upper(F.coalesce(_text_of("importance"), F.lit(INSIGHT_DEFAULTS["importance"]))).alias("importance"),
        F.lower(F.coalesce(_text_of("category"), F.lit(INSIGHT_DEFAULTS["category"]))).alias("category"),
        F.when(evidence.isNull(), "{}").when(_kind(evidence) == "{", evidence).otherwise(raw).alias("evidence"),
        _list_of("affected_columns").alias("affected_columns"),
        F.when(F.lower(caveats) != "null", caveats).alias("caveats"))


def recommendations(parsed: DataFrame) -> DataFrame:
    rows = _items(parsed, "recommendations")
    title = F.coalesce(_text_of("title"), F.lit(RECOMMENDATION_DEFAULTS["title"]))
    return rows.select(
        *[col(c) for c in rows.columns if c not in ("place", "item")],
        F.coalesce(_text_of("recommendation_id"), F.format_string("REC_%02d", F.col("place") + 1))
        .alias("recommendation_id"),
        title.alias("title"), F.coalesce(_text_of("description"), title).alias("description"),
        F.lower(F.coalesce(_text_of("action_type"), F.lit(RECOMMENDATION_DEFAULTS["action_type"])))
        .alias("action_type"),
        _list_of("supporting_evidence").alias("supporting_evidence"),
        F.lower(F.coalesce(_text_of("priority"), F.lit(RECOMMENDATION_DEFAULTS["priority"]))).alias("priority"))


def warnings(parsed: DataFrame) -> DataFrame:
    keep = [c for c in parsed.columns if c not in ("executive_summary", "error", "insights",
                                                   "recommendations", "warnings")]
    texts = F.transform("warnings", lambda w: F.coalesce(w.cast("string"), F.lit("None")))
    return (parsed.select(*[col(c) for c in keep], F.explode_outer(texts).alias("warning"))
            .where(F.col("warning").isNotNull()))


def failed_responses(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).drop("executive_summary", "insights",
                                                         "recommendations", "warnings")
