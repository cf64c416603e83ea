"""A table in long form: one row per (column, value), typed slots, optional weights.

``cells`` costs no shuffle. ``value_counts`` groups the cells, combining map-side,
so a value that fills a third of the table reaches the shuffle once per task.
Long texts travel as SHA-256 digests, so the shuffle never carries documents.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, is_float, is_time, normalize, spread

LONG_TEXT_BYTES = 128
# Characters one of which every date text contains.
DATE_MARKS = "[-/:T]"

_SLOTS = {"l": "long", "d": "double", "s": "string", "t": "timestamp_ntz", "long_text": "boolean"}


def _slots(field: T.StructField) -> dict[str, Column]:
    """Put a value into the slot of its type, so no value is converted lossily."""
    c, dtype = col(field.name), field.dataType
    if is_float(dtype):
        return {"d": c.cast("double")}
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return {"l": c.cast("long")}
    if is_time(dtype):
        return {"t": c.cast("timestamp_ntz")}
    text = c.cast("string")
    # blanks around a value do not make it long: what is long could be no flag, date or UUID
    long = F.octet_length(F.btrim(text, F.lit(" \t\r\n"))) > LONG_TEXT_BYTES
    # long_text also keeps the one thing type detection asks of a long text
    return {"s": F.when(long, F.sha2(text, 256)).otherwise(text),
            "long_text": F.when(long, text.rlike(DATE_MARKS))}


def cells(df: DataFrame, ordinals: list[int] | None = None, deal: bool = True) -> DataFrame:
    """(ordinal, l, d, s, t, long_text) of every non-null value of the chosen columns."""
    fields = df.schema.fields
    ordinals = list(range(len(fields))) if ordinals is None else ordinals
    df = normalize(df.select(*[col(fields[i].name) for i in ordinals]))
    if not ordinals:
        return df.select(*[F.lit(None).cast(t).alias(n) for n, t in {"ordinal": "int", **_SLOTS}.items()]).limit(0)
    rows = []
    for ordinal, field in zip(ordinals, df.schema.fields):
        slots = _slots(field)
        rows.append(F.struct(F.lit(ordinal).alias("ordinal"), *[
            slots.get(name, F.lit(None)).cast(dtype).alias(name) for name, dtype in _SLOTS.items()]))
    filled = F.coalesce(*[F.when(F.col(s).isNotNull(), True) for s in ("l", "d", "s", "t")])
    return (spread(df) if deal else df).select(F.inline(F.array(*rows))).where(filled)


def value_counts(df: DataFrame, ordinals: list[int] | None = None, deal: bool = True) -> DataFrame:
    """The distinct cells with their ``weight``."""
    return cells(df, ordinals, deal).groupBy("ordinal", *_SLOTS).agg(F.count("*").alias("weight"))


@contextmanager
def counted(df: DataFrame, ordinals: list[int] | None = None, deal: bool = True):
    """Value counts kept on the executors while several aggregates read them."""
    counts = value_counts(df, ordinals, deal).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield counts
    finally:
        counts.unpersist()


def number() -> Column:
    return F.coalesce("d", F.col("l").cast("double"), F.expr("try_cast(s AS double)"))


def text() -> Column:
    return F.coalesce("s", F.col("l").cast("string"), F.col("d").cast("string"),
                      F.col("t").cast("string"))


def original_texts(df: DataFrame, top: DataFrame) -> DataFrame:
    """Swap digests back for their texts in a short (ordinal, rank, value, ...) table.

    Rescans only the columns that have a digest among their top values.
    """
    found = top.where("long_text IS NOT NULL").select("ordinal", "value").collect()
    if not found:
        return top.drop("long_text")
    names = df.columns
    texts = None
    for ordinal in sorted({r.ordinal for r in found}):
        digests = [r.value for r in found if r.ordinal == ordinal]
        source = normalize(df.select(col(names[ordinal])))
        seen = (source.select(col(names[ordinal]).cast("string").alias("original"))
                .withColumn("value", F.sha2("original", 256)).where(F.col("value").isin(digests))
                .groupBy("value").agg(F.any_value("original").alias("original"))
                .withColumn("ordinal", F.lit(ordinal)))
        texts = seen if texts is None else texts.unionByName(seen)
    return (top.join(texts, ["ordinal", "value"], "left")
            .withColumn("value", F.coalesce("original", "value")).drop("original", "long_text"))
