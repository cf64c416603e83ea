"""Statistics that the usual reports promise beside the core ones: rank correlation,
histograms, entropy, interquartile range, and tests of group differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import INFINITY, col, normalize, pin
from ..functions.tails import p_of_f_ratio
from .cells import counted
from .correlation import coefficients

RANK_SPLITS = 64              # value ranges ranked side by side


def average_ranks(weighted: DataFrame, keys: list[str], splits: int = RANK_SPLITS) -> DataFrame:
    """(keys..., value, weight, rank): mean rank of each distinct value.

    Values are cut into ranges; ranges are ranked side by side and shifted by what lies
    before them, so no task sorts a whole column.
    """
    grid = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    borders = weighted.groupBy(*keys).agg(F.percentile_approx("value", grid, F.lit(1000)).alias("borders"))
    part = F.size(F.filter("borders", lambda b: b < F.col("value")))
    cut = weighted.join(F.broadcast(borders), keys).withColumn("part", part).drop("borders")  # one row per key
    sizes = pin(cut.groupBy(*keys, "part").agg(F.sum("weight").alias("n")))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("part")
                                        .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.withColumn("before", before).drop("n")
    inside = F.sum("weight").over(W.partitionBy(*keys, "part").orderBy("value")
                                  .rowsBetween(W.unboundedPreceding, 0))
    last = F.col("before") + F.col("inside")
    return (cut.withColumn("inside", inside).join(F.broadcast(shifts), keys + ["part"])
            .select(*keys, "value", "weight", (last - (F.col("weight") - 1) / 2.0).alias("rank")))


def spearman_pairs(df: DataFrame, columns: list[str], min_correlation: float = 0.0) -> DataFrame:
    """(column_x, column_y, rho, sample_size): Pearson correlation of average ranks,
    each pair ranked over the rows where both are present."""
    df = normalize(df.select(*[col(c).cast("double").alias(c) for c in sorted(columns)]))
    parts = []
    for i, x in enumerate(sorted(columns)):
        for y in sorted(columns)[i + 1:]:
            both = (df.where(col(x).isNotNull() & col(y).isNotNull())
                    .groupBy(col(x).alias("x"), col(y).alias("y")).agg(F.count("*").alias("weight")))
            ranked = both
            for side in ("x", "y"):
                values = both.groupBy(F.lit(0).alias("k"), F.col(side).alias("value")).agg(
                    F.sum("weight").alias("weight"))
                ranks = average_ranks(values, ["k"]).select(F.col("value").alias(side),
                                                            F.col("rank").alias(f"rank_{side}"))
                ranked = ranked.join(ranks, side)
            w, a, b = F.col("weight"), F.col("rank_x"), F.col("rank_y")
            n = F.sum(w)
            middle = (n + 1) / 2.0                        # mean of any average ranks
            sums = ranked.agg(n.cast("long").alias("n"),
                              (F.sum(w * a * a) - n * middle * middle).alias("sxx"),
                              (F.sum(w * b * b) - n * middle * middle).alias("syy"),
                              (F.sum(w * a * b) - n * middle * middle).alias("sxy"))
            parts.append(sums.select(F.lit(x).alias("column_x"), F.lit(y).alias("column_y"), "*"))
    sums = reduce(lambda a, b: a.unionByName(b), parts)
    return (coefficients(sums).where(F.abs("r") >= min_correlation)
            .select("column_x", "column_y", F.col("r").alias("rho"), F.col("n").alias("sample_size")))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, count): equal-width bins from the smallest to the largest finite value."""
    value = col(column).cast("double")
    finite = normalize(df.select(value.alias("v"))).where(
        F.col("v").isNotNull() & (F.abs("v") != F.lit(INFINITY)))
    low, high = finite.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return finite.select(F.lit(0).alias("bin"), F.col("v").alias("low"), F.col("v").alias("high"),
                             F.lit(0).cast("long").alias("count"))
    width = (high - low) / bins
    place = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
    return (finite.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("count"))
            .select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
                    (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "count"))


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, entropy): bits per value of the non-null values."""
    chosen = df.select(*[col(c) for c in columns])
    spark = df.sparkSession
    with counted(chosen) as counts:
        totals = counts.groupBy("ordinal").agg(F.sum("weight").alias("total"))
        p = F.col("weight") / F.col("total")
        bits = (counts.join(F.broadcast(totals), "ordinal").groupBy("ordinal")
                .agg((-F.sum(p * F.log2(p))).alias("entropy")))
        names = spark.createDataFrame(list(enumerate(columns)), "ordinal int, column string")
        return pin(names.join(bits, "ordinal", "left").select(
            "column", (F.coalesce("entropy", F.lit(0.0)) + F.lit(0.0)).alias("entropy")))


def iqr(profile: DataFrame) -> DataFrame:
    """(column, iqr) of the numerical columns of a profile."""
    n = F.col("numerical")
    return profile.where(n.isNotNull()).select("column", (n["q75"] - n["q25"]).alias("iqr"))


def anova(df: DataFrame, categorical: str, numerical: str) -> DataFrame:
    """One row (groups, rows, ss_between, ss_within, f, p_value): one-way analysis of variance."""
    rows = normalize(df.select(col(categorical).alias("g"), col(numerical).cast("double").alias("v")))
    groups = (rows.where(F.col("g").isNotNull() & F.col("v").isNotNull()).groupBy("g")
              .agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")))
    grand = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    totals = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), grand.alias("grand"),
                        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("squares"),
                        F.sum(F.col("n") * F.col("var")).alias("ss_within"))
    between = F.greatest(F.col("squares") - F.col("rows") * F.col("grand") * F.col("grand"), F.lit(0.0))
    df1, df2 = F.col("groups") - 1, F.col("rows") - F.col("groups")
    f = F.try_divide(F.try_divide(F.col("ss_between"), df1), F.try_divide(F.col("ss_within"), df2))
    return (totals.withColumn("ss_between", between).withColumn("f", f)
            .withColumn("p_value", p_of_f_ratio(F.col("f"), df1, df2))
            .select("groups", "rows", "ss_between", "ss_within", "f", "p_value"))


def kruskal(df: DataFrame, categorical: str, numerical: str) -> DataFrame:
    """One row (groups, rows, h): Kruskal-Wallis H with tie correction."""
    rows = normalize(df.select(col(categorical).alias("g"), col(numerical).cast("double").alias("v")))
    counts = (rows.where(F.col("g").isNotNull() & F.col("v").isNotNull())
              .groupBy("g", "v").agg(F.count("*").alias("n")))
    values = counts.groupBy(F.lit(0).alias("k"), F.col("v").alias("value")).agg(F.sum("n").alias("weight"))
    ranks = average_ranks(values, ["k"])
    t = F.col("weight").cast("double")
    ties = ranks.agg(F.sum(t * t * t - t).alias("ties"), F.sum("weight").alias("total"))
    sums = (counts.join(ranks.select(F.col("value").alias("v"), "rank"), "v").groupBy("g")
            .agg(F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum("n").alias("n")))
    groups = sums.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"),
                      F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    n = F.col("rows").cast("double")
    h = 12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    correction = 1.0 - F.col("ties") / (n * n * n - n)
    return (groups.join(F.broadcast(ties), groups["rows"] == ties["total"])
            .select("groups", "rows", F.try_divide(h, correction).alias("h")))
