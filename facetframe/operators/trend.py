"""Numbers over time: period means and their linear trend."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..functions.columns import col, is_numeric, normalize
from ..functions.tails import p_of_correlation

# The longest span in days that is read by day and by week.
DAILY_SPAN = 60
WEEKLY_SPAN = 365
DIRECTION_P = 0.1
STRONG_R2 = 0.6


def period_end(ts: Column, frequency: str) -> Column:
    """The date that names a period: the day, the Sunday, or the last day of the month."""
    if frequency == "daily":
        return F.to_date(ts)
    if frequency == "weekly":
        return F.date_add(F.to_date(F.date_trunc("week", ts)), 6)
    return F.last_day(F.to_date(ts))


def frequency_of(span_days: int) -> str:
    return "daily" if span_days <= DAILY_SPAN else "weekly" if span_days <= WEEKLY_SPAN else "monthly"


def _moments(df: DataFrame, date: str, day_first: bool) -> Column:
    c = col(date)
    if isinstance(df.schema[date].dataType, T.StringType):
        return dates.parse_text(c, day_first).cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


def period_means(df: DataFrame, date: str, values: list[str], day_first: bool = False,
                 min_periods: int = 3) -> DataFrame:
    """(datetime_column, numerical_column, period_frequency, period, mean, start_date, end_date).

    The span of the date column chooses days, weeks or months; empty periods are absent.
    """
    df = normalize(df)
    dated = (df.withColumn("_ts", _moments(df, date, day_first)).where(F.col("_ts").isNotNull())
             .select("_ts", *[col(v) for v in values]))
    span = dated.agg(F.min("_ts").alias("low"), F.max("_ts").alias("high"), F.count("*").alias("n")).first()
    days = (span.high - span.low).days if span.n else 0
    frequency = frequency_of(days)
    enough = F.lit(span.n >= min_periods)
    means = (dated.where(enough).groupBy(period_end(F.col("_ts"), frequency).alias("period"))
             .agg(*[F.struct(F.avg(col(v).cast("double")).alias("mean"), F.count(col(v)).alias("n")).alias(v)
                    for v in values]))
    tall = F.inline(F.array(*[
        F.struct(F.lit(v).alias("numerical_column"), col(v)["mean"].alias("mean"), col(v)["n"].alias("n"))
        for v in values]))
    return means.select("period", tall).where(F.col("n") > 0).select(
        F.lit(date).alias("datetime_column"), "numerical_column",
        F.lit(frequency).alias("period_frequency"), "period", "mean",
        F.lit(span.low.date() if span.n else None).cast("date").alias("start_date"),
        F.lit(span.high.date() if span.n else None).cast("date").alias("end_date"))


def trend_direction(slope: Column, r2: Column, p: Column, r2_threshold: float = 0.25) -> Column:
    moving = (r2 >= r2_threshold) & (p < DIRECTION_P)
    return F.when(moving, F.when(slope > 0, "increasing").otherwise("decreasing")).otherwise("stable")


def trend_fit(means: DataFrame, min_periods: int = 3, r2_threshold: float = 0.25) -> DataFrame:
    """Least squares line of the period means over the period number 0, 1, 2, ...

    (datetime_column, numerical_column, period_frequency, periods_count, slope, r_squared,
    p_value, direction, start_date, end_date, importance); constant series have no line.
    """
    series = ["datetime_column", "numerical_column", "period_frequency", "start_date", "end_date"]
    # periods per series are bounded by the calendar, not by the rows
    place = F.row_number().over(W.partitionBy(*series).orderBy("period")) - 1
    fitted = (means.withColumn("x", place.cast("double")).groupBy(*series).agg(
        F.count("*").alias("periods_count"), F.regr_slope("mean", "x").alias("slope"),
        F.regr_r2("mean", "x").alias("r2"), F.min("mean").alias("low"), F.max("mean").alias("high"))
        .where((F.col("periods_count") >= min_periods) & (F.col("low") != F.col("high")))
        .withColumn("p", p_of_correlation(F.sqrt("r2"), F.col("periods_count"))))
    slope, r2 = F.col("slope"), F.col("r2")
    return (fitted.withColumn("direction", trend_direction(slope, r2, F.col("p"), r2_threshold))
            .select("datetime_column", "numerical_column", "period_frequency", "periods_count",
                    F.round(slope, 4).alias("slope"), F.round(r2, 4).alias("r_squared"),
                    F.round("p", 6).alias("p_value"), "direction", "start_date", "end_date",
                    F.when(F.col("direction") != "stable",
                           F.when(r2 >= STRONG_R2, "HIGH").otherwise("MEDIUM")).alias("importance")))


def trends(df: DataFrame, profile: DataFrame, min_periods: int = 3, r2_threshold: float = 0.25,
           max_numerical: int = 5, day_first: tuple[str, ...] = ()) -> DataFrame:
    """Every datetime column against the first few varying numerical columns."""
    rows = profile.orderBy("ordinal").collect()
    moments = sorted(r.column for r in rows if r.semantic_type == "datetime")
    numbers = [r.column for r in rows if r.semantic_type == "numerical" and r.unique_count > 1
               and r.missing_percentage < 100.0
               and is_numeric(df.schema[r.column].dataType)][:max_numerical]
    if not moments or not numbers:
        empty = ("datetime_column string, numerical_column string, period_frequency string, "
                 "periods_count long, slope double, r_squared double, p_value double, direction string, "
                 "start_date date, end_date date, importance string")
        return df.sparkSession.createDataFrame([], empty)
    tables = [period_means(df, m, numbers, m in day_first, min_periods) for m in moments]
    return trend_fit(reduce(lambda a, b: a.unionByName(b), tables), min_periods, r2_threshold)
