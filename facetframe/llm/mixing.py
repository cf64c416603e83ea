"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage
from .common import WORD, emit, row_hash, running, small

#: No document is taken more often than this, so no source gets more than this times its size.
MOST_COPIES = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source (``source``, ``source_size``): ``target``, the words the mix shall take from it.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. Targets share the total of all sizes;
    none is above MOST_COPIES times its source's size, and what is cut there goes to the others by weight.
    In the order of cap over weight the cut sources are a prefix, so running totals give the level exactly:
    a source is cut if the level that the rest would have together with it exceeds its own cap.
    """
    ordered = sizes.withColumns({"__last": F.col("source").isNull(), "__one": F.lit(1).cast("long")})
    ranked = running(cut_lineage(ordered), [], ["__last", "source"], {"__rank": "__one"})
    weighed = ranked.withColumn("weight", F.col("__rank") % 3 + 1).withColumn(
        "__cap", F.col("source_size") * F.lit(MOST_COPIES))
    by_ratio = weighed.withColumn("__ratio", F.col("__cap") / F.col("weight"))
    cumulated = running(cut_lineage(by_ratio), [], ["__ratio", "__rank"],
                        {"__caps": "__cap", "__weights": "weight"})
    total = cumulated.agg(F.sum("source_size").alias("__all"), F.sum("weight").alias("__weight"))
    level = cumulated.join(F.broadcast(total)).withColumn(       # one row
        "__cut", (F.col("__all") - F.col("__caps")) / (F.col("__weight") - F.col("__weights")) * F.col("weight")
        > F.col("__cap"))
    level = cut_lineage(level)
    rest = level.agg(F.first("__all").alias("__t"),
                     F.coalesce(F.sum(F.when(F.col("__cut"), F.col("__cap"))), F.lit(0)).alias("__c"),
                     F.coalesce(F.sum(F.when(~F.col("__cut"), F.col("weight"))), F.lit(0)).alias("__w"))
    shared = F.when(F.col("__cut"), F.col("__cap").cast("double")).otherwise(
        (F.col("__t") - F.col("__c")) / F.col("__w") * F.col("weight"))
    return level.join(F.broadcast(rest)).select("source", "source_size", "weight", shared.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The one random offset of a source, a multiple of 2^-20 in [0, 1), the same in every run."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id",
             seed: int = 7) -> DataFrame:
    """Per row: __id, __hash, source, size, source_size, target, copies.

    Every row of a source has the same expected number of copies, target over source size. Rows stand in the
    order of their sizes inside the source; the expected copies are summed up, one random offset is added, and
    a row is emitted once for every integer the sum passes in it. In size order the words taken differ from
    the target by about the largest document of the source at most.

    Null text has size 0; null sources are one source; a source without words has target 0 and no copies.
    An empty table gives an empty result. Equal rows may get different numbers of copies.
    """
    rows = docs.select(col(id_col).alias("__id"), row_hash(docs).alias("__hash"),
                       col(source).cast("string").alias("source"),
                       F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = cut_lineage(rows)
    targets = cut_lineage(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    placed = running(rows.withColumn("__one", F.lit(1).cast("long")), ["source"], ["size", "__id", "__hash"],
                     {"__at": "__one"})
    rate = targets.select(F.col("source").alias("__s"), "source_size", "target",
                          F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                          .otherwise(F.lit(0.0)).alias("__rate"), offset(F.col("source"), seed).alias("__offset"))
    joined = placed.join(small(rate), F.col("source").eqNullSafe(F.col("__s")))
    passed = (F.floor(F.col("__offset") + (F.col("__at") + 1) * F.col("__rate"))
              - F.floor(F.col("__offset") + F.col("__at") * F.col("__rate")))
    return joined.select("__id", "__hash", "source", "size", "source_size", "target", passed.cast("long").alias("copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id",
        seed: int = 7) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as ``mix_plan`` says."""
    plan = mix_plan(docs, text, source, id_col, seed)
    return emit(docs, id_col, plan.groupBy("__id", "__hash").agg(F.sum("copies").alias("__times")))
