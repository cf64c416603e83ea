"""Column and table profiles.

Numbers never leave their task: one scan takes counts, sums and bounds, the next ones the moments and histograms whose
buckets narrow the quantiles down, and different values are counted by bitmaps or 8-byte digests (``functions/ranks``).
Text, boolean and time columns are reduced to *value counts*, one row per (column, distinct value) with its weight,
combined map-side, so a value that fills a third of the table arrives as one row per task. Types, modes, top values
and spans are small aggregates over these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.columns import col, dealt, finite_or_null, is_float, is_numeric, normalize, percent_of, pin, spread
from ..functions.ranks import BUCKETS, distinct_counts, number_summary
from .cells import cells, counted, original_texts, text
from .semantic import (SEMANTIC_TYPES, ColumnKind, boolean_name, column_kinds, identifier_name, kinds_from,
                       kinds_table)

# Text that counts as true; all other text counts as false.
TRUE_WORDS = ("true", "t", "yes", "y", "1")


# --------------------------------------------------------------------------- per type

def _numerical(df: DataFrame, ordinals: list[int], buckets: int = BUCKETS, deal: bool = True) -> DataFrame:
    """(ordinal, infinite, numerical) from rounds over the raw rows."""
    probs = [0.25, 0.5, 0.75]
    found = number_summary(df, ordinals, probs, buckets, deal)
    names = ("count", "infinite", "mean", "min", "max", "m2", "m3", "m4")
    rows = [(o, *[None if f[n] is None else f[n] if n in names[:2] else float(f[n]) for n in names], *map(f["quantiles"].get, probs))
            for o, f in found.items()]
    spread_out = df.sparkSession.createDataFrame(rows, "ordinal int, total long, infinite long, " + ", ".join(
        f"{c} double" for c in (*names[2:], "q25", "q50", "q75")))
    n, m2 = F.col("total").cast("double"), F.col("m2")
    variance = F.when(n > 1, m2 / F.greatest(n - 1, F.lit(1.0)))
    flat = m2 == 0
    # bias-adjusted third and fourth standardised moments
    skew = F.when(n >= 3, F.when(flat, 0.0).otherwise(
        F.try_divide(n * F.sqrt(n - 1) * F.col("m3"), (n - 2) * F.pow(m2, F.lit(1.5)))))
    kurt = F.when(n >= 4, F.when(flat, 0.0).otherwise(
        F.try_divide(n * (n + 1) * (n - 1) * F.col("m4"), (n - 2) * (n - 3) * m2 * m2)
        - F.try_divide(3 * (n - 1) * (n - 1), (n - 2) * (n - 3))))
    clean = {
        "mean": F.col("mean"), "median": F.col("q50"), "std": F.sqrt(variance), "variance": variance,
        "min": F.col("min"), "max": F.col("max"), "q25": F.col("q25"), "q50": F.col("q50"),
        "q75": F.col("q75"), "skewness": skew, "kurtosis": kurt}
    return spread_out.select(
        "ordinal", F.col("infinite").cast("long").alias("infinite"),
        F.struct(F.col("total").cast("long").alias("count"),
                 *[finite_or_null(c).alias(name) for name, c in clean.items()]).alias("numerical"))


def _top_values(df: DataFrame, counts: DataFrame, top_n: int) -> DataFrame:
    """(ordinal, rank, value, frequency); each task keeps only its own top before the shuffle.

    Among equally frequent values the smaller text is first (long texts: the smaller digest).
    """
    order = W.partitionBy("ordinal").orderBy(F.desc("frequency"), F.asc("value"))
    top = pin(counts.select("ordinal", text().alias("value"), F.col("weight").alias("frequency"), "long_text")
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n))
    return original_texts(df, top)


def _categorical(top: DataFrame) -> DataFrame:
    ranked = F.sort_array(F.collect_list(F.struct("rank", "value", "frequency")))   # top_n entries
    return top.groupBy("ordinal").agg(ranked.alias("r")).select("ordinal", F.struct(
        F.col("r")[0]["value"].alias("most_frequent"),
        F.col("r")[0]["frequency"].alias("most_frequent_frequency"),
        F.transform("r", lambda x: F.struct(x["value"].alias("value"), x["frequency"].alias("frequency")))
        .alias("top_values")).alias("categorical"))


def iso_text(ts: Column) -> Column:
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", plain).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def _time_of_day(ts: Column) -> Column:
    """Microseconds since midnight."""
    return ((F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long") * 1_000_000
            + F.date_format(ts, "SSSSSS").cast("long"))


def span_text(low: Column, high: Column) -> Column:
    """``12 days``, or ``12 days 03:04:05[.000006]`` when it is not whole days."""
    day = 86_400_000_000
    micros = F.datediff(high, low).cast("long") * day + _time_of_day(high) - _time_of_day(low)
    rest = F.pmod(micros, F.lit(day))
    second = F.expr("1000000")
    seconds = F.floor(rest / second).cast("long")
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("long"),
                            F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("long"),
                            F.pmod(seconds, F.lit(60)))
    fraction = F.pmod(rest, F.lit(1_000_000))
    days = F.concat(F.floor(micros / day).cast("long").cast("string"), F.lit(" days"))
    return (F.when(rest == 0, days)
            .when(fraction == 0, F.concat(days, F.lit(" "), clock))
            .otherwise(F.concat(days, F.lit(" "), clock, F.format_string(".%06d", fraction))))


def _datetime(counts: DataFrame, kinds: list[ColumnKind]) -> DataFrame:
    written_day_first = F.col("ordinal").isin([k.ordinal for k in kinds if k.day_first])
    parsed = dates.parse_text(F.col("s"), prefer_day_first=written_day_first)
    times = counts.select("ordinal", F.coalesce("t", parsed.cast("timestamp_ntz")).alias("ts"))
    # typed values are distinct already, different texts may name the same moment
    unique = F.count("ts") if all(k.physical_type != "string" for k in kinds) else F.count_distinct("ts")
    return (times.groupBy("ordinal").agg(F.min("ts").alias("low"), F.max("ts").alias("high"),
                                         unique.alias("unique_count"))
            .select("ordinal", F.struct(
                iso_text(F.col("low")).alias("min"), iso_text(F.col("high")).alias("max"),
                F.col("unique_count"), span_text(F.col("low"), F.col("high")).alias("time_span"),
                F.datediff("high", "low").alias("span_days")).alias("datetime")))


def _boolean(counts: DataFrame) -> DataFrame:
    yes = F.coalesce(F.col("l") != 0, F.col("d") != 0,
                     F.lower(F.trim("s")).isin(*TRUE_WORDS), F.lit(True))
    return (counts.groupBy("ordinal").agg(
        F.sum(F.when(yes, F.col("weight")).otherwise(0)).alias("true_count"),
        F.sum("weight").alias("present"))
        .select("ordinal", F.struct(
            F.col("true_count"), (F.col("present") - F.col("true_count")).alias("false_count"),
            percent_of(F.col("true_count"), F.col("present")).alias("true_percentage"),
            percent_of(F.col("present") - F.col("true_count"), F.col("present"))
            .alias("false_percentage")).alias("boolean")))


# --------------------------------------------------------------------------- operators

def _by_value(df: DataFrame) -> tuple[list[int], list[int]]:
    """Columns that are reduced to value counts, and the numbers among the others whose name asks for a look at the values."""
    plain = [i for i, f in enumerate(df.schema.fields) if is_numeric(f.dataType) and not boolean_name(f.name)]
    return ([i for i in range(len(df.columns)) if i not in set(plain)],
            [i for i in plain if identifier_name(df.columns[i])])


def _kinds(df: DataFrame, counts: DataFrame, looked_at: list[int]) -> list[ColumnKind]:
    """The types of all columns, from value counts and the raw cells of a few columns."""
    return kinds_from(df, counts.unionByName(cells(df, looked_at, deal=False).withColumn("weight", F.lit(1).cast("long"))))


def _common(df: DataFrame, counts: DataFrame, kinds: list[ColumnKind], counted_ordinals: list[int]) -> DataFrame:
    """Totals of each column of dealt rows: those of ``counted_ordinals`` from the value counts, others from the rows."""
    sizes = {r.ordinal: (r.present, r.different) for r in counts.groupBy("ordinal").agg(
        F.sum("weight").alias("present"), F.count("*").alias("different")).collect()}
    clean = normalize(df)
    sizes |= distinct_counts(clean, [i for i in range(len(df.columns)) if i not in set(counted_ordinals)], deal=False)
    total, zero = F.lit(df.count()).cast("long"), F.lit(0).cast("long")
    seen = df.sparkSession.createDataFrame([(o, *v) for o, v in sizes.items()], "ordinal int, present long, different long")
    missing, unique = total - F.coalesce("present", zero), F.coalesce("different", zero)
    return kinds_table(df.sparkSession, kinds).join(F.broadcast(seen), "ordinal", "left").select(
        "ordinal", "column", "physical_type", "semantic_type", total.alias("row_count"),
        missing.alias("missing_count"), percent_of(missing, total).alias("missing_percentage"),
        unique.alias("unique_count"), percent_of(unique, total).alias("unique_percentage"))


def _together(parts: list[DataFrame]) -> DataFrame:
    """Put the per-type results of each column side by side; one small shuffle."""
    tall = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return tall.groupBy("ordinal").agg(*[F.any_value(c, ignoreNulls=True).alias(c)
                                         for c in tall.columns if c != "ordinal"])


def column_profile(df: DataFrame, top_n: int = 10) -> DataFrame:
    """One row per column: common figures and one filled struct for its semantic type.

    A few scans of the numbers without a shuffle of rows, and one shuffle of the value counts of the other columns.
    """
    by_value, looked_at = _by_value(df)
    with dealt(df) as df, counted(df, by_value, deal=False) as counts:
        kinds = _kinds(df, counts, looked_at)

        def of(semantic_type: str) -> tuple[list[ColumnKind], DataFrame]:
            chosen = [k for k in kinds if k.semantic_type == semantic_type]
            return chosen, counts.where(F.col("ordinal").isin([k.ordinal for k in chosen]))

        times, time_counts = of("datetime")
        out = _together([
            _common(df, counts, kinds, by_value),
            _numerical(df, [k.ordinal for k in kinds if k.semantic_type == "numerical"], deal=False),
            _categorical(_top_values(df, of("categorical")[1], top_n)),
            _datetime(time_counts, times),
            _boolean(of("boolean")[1])])
        keyed = F.when(F.col("semantic_type") == "identifier", F.struct(
            ((F.col("unique_count") == F.col("row_count")) & (F.col("missing_count") == 0))
            .alias("is_unique")))
        return pin(out.select(
            "ordinal", "column", "physical_type", "semantic_type", "row_count", "missing_count",
            "missing_percentage", "unique_count", "unique_percentage",
            F.coalesce("infinite", F.lit(0).cast("long")).alias("infinite_count"),
            "numerical", "categorical", "datetime", "boolean", keyed.alias("identifier"))
            .orderBy("ordinal"))


def _chosen(df: DataFrame, columns: list[str] | None, semantic_type: str) -> DataFrame:
    """The given columns, or all of one semantic type, in table order."""
    if columns is None:
        columns = [k.column for k in column_kinds(df) if k.semantic_type == semantic_type]
    return df.select(*[col(c) for c in columns])


def _as_given(df: DataFrame, semantic_type: str) -> list[ColumnKind]:
    return [ColumnKind(i, f.name, f.dataType.simpleString(), semantic_type)
            for i, f in enumerate(df.schema.fields)]


def common_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Total, missing and distinct counts of each column, any type."""
    df = df if columns is None else df.select(*[col(c) for c in columns])
    by_value, looked_at = _by_value(df)
    with dealt(df) as df, counted(df, by_value, deal=False) as counts:
        return pin(_common(df, counts, _kinds(df, counts, looked_at), by_value).orderBy("ordinal"))


def numerical_stats(df: DataFrame, columns: list[str] | None = None,
                    buckets: int = BUCKETS) -> DataFrame:
    """(column, count, mean, median, std, variance, min, max, q25, q50, q75, skewness,
    kurtosis, infinite_count); sample moments, linear quantiles."""
    df = _chosen(df, columns, "numerical")
    names = kinds_table(df.sparkSession, _as_given(df, "numerical"))
    stats = names.join(_numerical(df, list(range(len(df.columns))), buckets), "ordinal", "left").orderBy("ordinal")
    return pin(stats.select("column", "numerical.*", F.coalesce("infinite", F.lit(0).cast("long")).alias("infinite_count"))
               .withColumn("count", F.coalesce("count", F.lit(0).cast("long"))))


def categorical_stats(df: DataFrame, columns: list[str] | None = None, top_n: int = 10) -> DataFrame:
    """(column, unique_count, missing_count, missing_percentage, most_frequent,
    most_frequent_frequency, top_values)."""
    df = _chosen(df, columns, "categorical")
    every = list(range(len(df.columns)))
    with counted(df) as counts:
        return pin(_common(df, counts, _as_given(df, "categorical"), every)
                   .join(_categorical(_top_values(df, counts, top_n)), "ordinal", "left")
                   .orderBy("ordinal")
                   .select("column", "unique_count", "missing_count", "missing_percentage",
                           "categorical.*"))


def top_values(df: DataFrame, columns: list[str], top_n: int = 10) -> DataFrame:
    """(column, rank, value, frequency): most frequent first, ties by value."""
    df = _chosen(df, columns, "categorical")
    with counted(df) as counts:
        names = kinds_table(df.sparkSession, _as_given(df, "categorical"))
        return pin(names.join(_top_values(df, counts, top_n), "ordinal")
                   .select("column", "rank", "value", "frequency"))


def datetime_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing_count, missing_percentage, min, max, unique_count, time_span, span_days)."""
    df = _chosen(df, columns, "datetime")
    every = list(range(len(df.columns)))
    with counted(df) as counts:
        kinds = kinds_from(df, counts)
        return pin(_common(df, counts, kinds, every).drop("unique_count")
                   .join(_datetime(counts, kinds), "ordinal", "left").orderBy("ordinal")
                   .select("column", "missing_count", "missing_percentage", "datetime.min",
                           "datetime.max",
                           F.coalesce("datetime.unique_count", F.lit(0).cast("long")).alias("unique_count"),
                           "datetime.time_span", "datetime.span_days"))


def boolean_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, true_count, false_count, missing_count, true_percentage, false_percentage)."""
    df = _chosen(df, columns, "boolean")
    rows = df.count()
    zero = F.lit(0).cast("long")
    true, false = (F.coalesce(f"boolean.{n}_count", zero) for n in ("true", "false"))
    with counted(df) as counts:
        names = kinds_table(df.sparkSession, _as_given(df, "boolean"))
        return pin(names.join(_boolean(counts), "ordinal", "left").orderBy("ordinal").select(
            "column", true.alias("true_count"), false.alias("false_count"),
            (F.lit(rows) - true - false).cast("long").alias("missing_count"),
            *[F.coalesce(f"boolean.{n}_percentage", F.lit(0.0)).alias(f"{n}_percentage")
              for n in ("true", "false")]))


def identifier_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, unique_count, unique_percentage, missing_count, missing_percentage, is_unique)."""
    stats = common_stats(_chosen(df, columns, "identifier"))
    return stats.select("column", "unique_count", "unique_percentage", "missing_count",
                        "missing_percentage",
                        ((F.col("unique_count") == F.col("row_count"))
                         & (F.col("missing_count") == 0)).alias("is_unique"))


def row_digest(df: DataFrame) -> tuple[Column, Column]:
    """128 bits over all values of a row, nulls told apart by position."""
    parts = []
    for field in df.schema.fields:
        c = col(field.name)
        parts += [c.isNull(), (c + F.lit(0.0)) if is_float(field.dataType) else c]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *reversed(parts))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, duplicate_rows, duplicate_percentage): rows beyond the first of each group.

    Rows are compared by a 128-bit digest, so the shuffle carries 24 bytes per
    distinct row whatever the row's width, and copies combine before it.
    """
    df = normalize(df)
    first, second = row_digest(df)
    rows, extra = F.sum("n"), F.sum(F.col("n") - 1)
    zero = F.lit(0).cast("long")
    return (spread(df).select(first.alias("a"), second.alias("b"))
            .groupBy("a", "b").agg(F.count("*").alias("n"))
            .agg(F.coalesce(rows, zero).alias("rows"), F.coalesce(extra, zero).alias("duplicate_rows"))
            .select("rows", "duplicate_rows",
                    percent_of(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_percentage")))


def dataset_profile(df: DataFrame, profile: DataFrame | None = None, name: str = "dataset") -> DataFrame:
    """One row: size, missing cells, duplicate rows and columns per semantic type."""
    profile = column_profile(df) if profile is None else profile
    kinds = SEMANTIC_TYPES
    cells = F.col("row_count") * F.col("column_count")
    table = profile.agg(
        F.max("row_count").alias("row_count"), F.count("*").alias("column_count"),
        F.sum("missing_count").alias("missing_cells"),
        *[F.count_if(F.col("semantic_type") == k).alias(f"{k}_columns") for k in kinds])
    return pin(table.join(F.broadcast(duplicate_rows(df)).drop("rows")).select(
        F.lit(name).alias("dataset_name"), "row_count", "column_count", cells.alias("total_cells"),
        "missing_cells", percent_of(F.col("missing_cells"), cells).alias("missing_percentage"),
        "duplicate_rows", "duplicate_percentage", *[f"{k}_columns" for k in kinds]))
