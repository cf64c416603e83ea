"""Exact quantiles that do not need a whole group in one task.

Works on *weighted values*: a DataFrame of (keys..., value, weight). Groups with
few distinct values use the built-in aggregate, which keeps them in memory. In groups
with many, a histogram of exact counts tells which bucket holds each wanted rank, and
the search repeats inside that bucket until it is small; only its rows are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import INFINITY, pin

RANKED_VALUES = 100_000     # distinct values of one group that one task may hold
BUCKETS = 2048                # buckets per histogram round


def value_totals(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: total weight, rows, and the smallest and largest finite value."""
    finite = F.when(F.abs("value") != F.lit(INFINITY), F.col("value"))
    return weighted.groupBy(*keys).agg(
        F.sum("weight").cast("long").alias("total"), F.count("*").alias("inside"),
        F.min(finite).alias("low"), F.max(finite).alias("high"))


def _within(weighted: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Values inside their group's brackets; brackets has one row per key and p."""
    b = F.broadcast(brackets.withColumnsRenamed({k: f"_b_{k}" for k in keys}))
    same = reduce(lambda x, y: x & y, [weighted[k].eqNullSafe(F.col(f"_b_{k}")) for k in keys])
    inside = F.col("value").between(F.col("low"), F.col("high")) | F.col("whole")
    return weighted.join(b, same & inside).drop(*[f"_b_{k}" for k in keys])


def _narrow(weighted: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """One round: count per bucket, keep the bucket(s) that hold the rank."""
    group = keys + ["p", "rank", "part", "below"]
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    # halved so that the width of a bracket cannot overflow
    place = F.try_divide(value / 2 - low / 2, high / 2 - low / 2) * BUCKETS
    bucket = (F.when(value == F.lit(-INFINITY), -1).when(value == F.lit(INFINITY), BUCKETS)
              .otherwise(F.least(F.floor(F.coalesce(place, F.lit(0.0))), F.lit(BUCKETS - 1))))
    finite = F.when(F.abs("value") != F.lit(INFINITY), value)
    buckets = pin(_within(weighted, brackets, keys).groupBy(*group, bucket.alias("bucket"))
                  .agg(F.sum("weight").alias("weight"), F.count("*").alias("inside"),
                       F.coalesce(F.min(finite), F.min(value)).alias("low"),
                       F.coalesce(F.max(finite), F.max(value)).alias("high")))
    upto = F.col("below") + F.sum("weight").over(W.partitionBy(*keys, "p").orderBy("bucket"))
    return pin(buckets.withColumn("upto", upto)
               .withColumn("before", F.col("upto") - F.col("weight"))
               .where((F.col("upto") > F.col("rank")) & (F.col("before") <= F.col("rank") + 1))
               .groupBy(*keys, "p", "rank", "part")
               .agg(F.min("before").alias("below"), F.min("low").alias("low"),
                    F.max("high").alias("high"), F.sum("inside").alias("inside"))
               .withColumn("whole", F.lit(False)))


def quantiles(weighted: DataFrame, keys: list[str], probs: list[float],
              totals: DataFrame | None = None, limit: int = RANKED_VALUES) -> DataFrame:
    """(keys..., p, quantile) with linear interpolation between order statistics.

    ``keys`` must have few distinct combinations (columns, or columns x groups).
    ``totals`` is the pinned result of ``value_totals`` when the caller has it.
    """
    totals = pin(value_totals(weighted, keys)) if totals is None else totals
    few, many = totals.where(F.col("inside") <= limit), totals.where(F.col("inside") > limit)
    if many.isEmpty():
        return _held(weighted, keys, probs)
    named = F.broadcast(few.select(*[F.col(k).alias(f"_f_{k}") for k in keys]))
    same = reduce(lambda x, y: x & y, [weighted[k].eqNullSafe(F.col(f"_f_{k}")) for k in keys])
    small = weighted.join(named, same, "left_semi")
    return _held(small, keys, probs).unionByName(_searched(weighted, many, keys, probs, limit))


def _held(weighted: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    cut = F.percentile("value", F.array(*[F.lit(float(p)) for p in probs]), F.col("weight"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"), F.col("cut").alias("quantile"))
    return (weighted.groupBy(*keys).agg(cut.alias("cut"))
            .select(*keys, F.inline(pairs).alias("p", "quantile")))


def _searched(weighted: DataFrame, totals: DataFrame, keys: list[str], probs: list[float],
              limit: int) -> DataFrame:
    place = (F.col("total") - 1) * F.col("p")
    brackets = (totals.select(*keys, "total", "inside", "low", "high")
                .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
                .withColumn("rank", F.floor(place).cast("long"))
                .withColumn("part", place - F.floor(place))
                .withColumn("below", F.lit(0).cast("long"))
                .withColumn("whole", F.lit(True)).drop("total"))
    widest = totals.agg(F.max("inside")).first()[0] or 0
    while widest > limit:
        tighter = _narrow(weighted, brackets, keys)
        now = tighter.where("low < high").agg(F.max("inside")).first()[0] or 0
        brackets = tighter
        if now == widest:
            break
        widest = now
    running = (W.partitionBy(*keys, "p").orderBy("value")
               .rowsBetween(W.unboundedPreceding, 0))
    hits = (_within(weighted, brackets, keys)
            .groupBy(*keys, "p", "rank", "part", "below", "value")
            .agg(F.sum("weight").alias("weight"))
            .withColumn("upto", F.col("below") + F.sum("weight").over(running))
            .where((F.col("upto") > F.col("rank"))
                   & (F.col("upto") - F.col("weight") <= F.col("rank") + 1)))
    # the value at rank and the one after it (the same value where copies span both)
    first = F.min("value")
    after = F.min(F.when(F.col("upto") > F.col("rank") + 1, F.col("value")))
    return (hits.groupBy(*keys, "p", "part").agg(first.alias("a"), F.coalesce(after, first).alias("b"))
            .select(*keys, "p", F.when((F.col("part") == 0) | (F.col("a") == F.col("b")), F.col("a"))
                    .otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile")))
