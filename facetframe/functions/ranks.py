"""Moments, order statistics and distinct counts of whole columns, without a shuffle of their values.

A scan reduces each task's rows to one row of sums, or to counts of histogram buckets, before anything moves: what is
shuffled is columns x buckets x tasks at most, whatever the rows. Order statistics are exact: a round of the histogram
leaves the one bucket that holds a rank, and the next round divides the range between its smallest and largest value,
until these are equal. A round takes the digits of log2(BUCKETS) bits, so rounds do not grow with the rows.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import INFINITY, col, dealt, estimated_bytes, is_float, is_time

BUCKETS = 2048
#: Columns of one scan; a wider table takes several.
TOGETHER = 64


def number_of(field: T.StructField) -> Column:
    """A column as a double: null where it is missing, NaN or no number."""
    c = col(field.name)
    if isinstance(field.dataType, (T.IntegralType, T.DecimalType, T.BooleanType)):
        return c.cast("double")
    c = c.cast("double") if is_float(field.dataType) else c.try_cast("double")
    return F.when(~F.isnan(c), c)


def _totals(rows: DataFrame, n: int) -> list[dict]:
    """Per column x0, x1, ...: count, mean, bounds, and the infinities."""
    out = []
    for i in range(n):
        x = F.col(f"x{i}")
        finite = F.when(F.abs(x) != F.lit(INFINITY), x)
        out += [F.count(x).alias(f"count{i}"), F.avg(x).alias(f"mean{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                F.min(finite).alias(f"low{i}"), F.max(finite).alias(f"high{i}"),
                F.count_if(x == F.lit(-INFINITY)).alias(f"under{i}"), F.count_if(x == F.lit(INFINITY)).alias(f"over{i}")]
    found = rows.agg(*out).first()
    names = ("count", "mean", "min", "max", "low", "high", "under", "over")
    return [{name: found[f"{name}{i}"] for name in names} for i in range(n)]


def _slot(x: Column, brackets: list[tuple[float, float]], buckets: int) -> Column:
    """Bucket of a value: ``buckets`` of them to each bracket, null outside of all."""
    slot = F.lit(None).cast("int")
    for j, (low, high) in reversed(list(enumerate(brackets))):
        # halved so that the width of a bracket cannot overflow
        place = F.try_divide(x / 2 - F.lit(low / 2), F.lit(high / 2 - low / 2)) * buckets
        inside = F.least(F.floor(F.coalesce(place, F.lit(0.0))), F.lit(buckets - 1)).cast("int") + F.lit(j * buckets)
        slot = F.when(x.between(F.lit(low), F.lit(high)), inside).otherwise(slot)
    return slot


def _histogram(rows: DataFrame, brackets: dict[int, list[tuple[float, float]]], means: list[float | None] | None, buckets: int) -> list:
    """(i, slot, n, low, high, and with ``means`` the sums m2, m3, m4) of the values in the brackets of each column."""
    cells = []
    for i in sorted(brackets):
        x = F.col(f"x{i}")
        slot = _slot(x, brackets[i], buckets)
        e = x - F.lit(means[i]) if means else F.lit(None).cast("double")
        # with means all values count, those outside of the brackets in a bucket of their own
        cells.append(F.when(x.isNotNull(), F.struct(
            F.lit(i).alias("i"), (F.coalesce(slot, F.lit(-1)) if means else slot).alias("slot"), x.alias("x"), e.alias("e"))))
    if not cells:
        return []
    tall = rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("slot IS NOT NULL")
    moments = [F.sum(reduce(lambda a, b: a * b, [F.col("e")] * k)).alias(f"m{k}") for k in (2, 3, 4)] if means else []
    return tall.groupBy("i", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), *moments).collect()


def number_summary(df: DataFrame, ordinals: list[int], probs: list[float], buckets: int = BUCKETS,
                   deal: bool = True) -> dict[int, dict]:
    """Per ordinal of ``df``: count, infinite, mean, min, max, m2, m3, m4 (sums of powers around the mean) and, by
    ``probs``, the linearly interpolated quantiles; columns without a number are left out."""
    fields, out = df.schema.fields, {}
    for at in range(0, len(ordinals), TOGETHER):
        chosen = ordinals[at:at + TOGETHER]
        with dealt(df.select(*[number_of(fields[o]).alias(f"x{i}") for i, o in enumerate(chosen)]), deal) as rows:
            totals = _totals(rows, len(chosen))
            filled = [i for i, t in enumerate(totals) if t["count"]]
            wanted = {i: sorted({r for p in probs for r in _ranks(totals[i]["count"], p)}) for i in filled}
            found, moments = _order_statistics(rows, totals, wanted, buckets)
        for i in filled:
            t = totals[i]
            cut = {}
            for p in probs:
                place = (t["count"] - 1) * p
                a, b = (found[i][r] for r in _ranks(t["count"], p))
                part = place - int(place)
                cut[p] = a if part == 0 or a == b else a + (b - a) * part
            out[chosen[i]] = {"count": t["count"], "infinite": t["under"] + t["over"], "mean": t["mean"], "min": t["min"],
                              "max": t["max"], **moments[i], "quantiles": cut}
    return out


def _ranks(n: int, p: float) -> tuple[int, int]:
    k = int((n - 1) * p)
    return k, min(k + 1, n - 1)


def _order_statistics(rows: DataFrame, totals: list[dict], wanted: dict[int, list[int]], buckets: int) -> tuple[dict, dict]:
    """The values at the wanted ranks of each column, and the moments, which the first round brings along."""
    found: dict[int, dict[int, float]] = defaultdict(dict)
    open_: dict[int, dict[int, tuple[int, float, float]]] = defaultdict(dict)        # rank: values below, bracket
    for i, ranks in wanted.items():
        t = totals[i]
        for r in ranks:
            if r < t["under"] or r >= t["count"] - t["over"]:
                found[i][r] = -INFINITY if r < t["under"] else INFINITY
            else:
                open_[i][r] = (t["under"], t["low"], t["high"])
    moments: dict[int, dict[str, float]] = {i: dict.fromkeys(("m2", "m3", "m4"), 0.0) for i in wanted}
    means: list[float | None] | None = [t["mean"] for t in totals]
    brackets = {i: sorted({b[1:] for b in open_[i].values()}) for i in wanted}
    while brackets:
        counted = defaultdict(list)
        for r in _histogram(rows, brackets, means, buckets):
            if means:
                for m in ("m2", "m3", "m4"):
                    moments[r.i][m] += r[m]
            if r.slot >= 0:
                counted[r.i, r.slot // buckets].append(r)
        means = None
        for i, ranks in open_.items():
            for rank, (below, low, high) in list(ranks.items()):
                held = below
                for r in sorted(counted[i, brackets[i].index((low, high))], key=lambda r: r.slot):
                    if held + r.n > rank:
                        break
                    held += r.n
                if r.low == r.high:
                    found[i][rank] = r.low
                    del ranks[rank]
                elif (r.low, r.high) == (low, high):         # neighbouring numbers: too near for a quotient
                    found[i][rank] = _listed(rows, i, low, high, rank - below)
                    del ranks[rank]
                else:
                    ranks[rank] = (held, r.low, r.high)
        brackets = {i: sorted({b[1:] for b in ranks.values()}) for i, ranks in open_.items() if ranks}
    return found, moments


def _listed(rows: DataFrame, i: int, low: float, high: float, rank: int) -> float:
    """The value at ``rank`` between two numbers with hardly a number between them."""
    x = F.col(f"x{i}")
    for r in rows.where(x.between(F.lit(low), F.lit(high))).groupBy(x.alias("x")).count().orderBy("x").collect():
        if rank < r["count"]:
            return r.x
        rank -= r["count"]
    raise AssertionError("rank outside of its bracket")


# ------------------------------------------------------------------------------------------------ distinct values

#: Bits of one word of a bitmap. Longs are combined by hash; the built-in bitmaps of 4 KB would sort all rows of a task.
WORD_BITS = 64
#: Bytes a task reads, about; only decides whether numbers travel as words of bits or as digests.
TASK_BYTES = 128 << 20


def _digest(c: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """Two 64-bit digests of a value. The first tells values of up to eight bytes apart without fail."""
    if is_float(dtype):
        return F.xxhash64(c.cast("double") + F.lit(0.0)), F.lit(0).cast("long")
    if is_time(dtype) or isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return F.xxhash64(c), F.lit(0).cast("long")
    return F.xxhash64(c.cast("string")), F.xxhash64(F.lit("second"), c.cast("string"))


def distinct_counts(df: DataFrame, ordinals: list[int], deal: bool = True) -> dict[int, tuple[int, int]]:
    """Per ordinal of a normalized ``df``: the non-null values, and how many different ones there are; exact.

    Whole numbers in a range that is narrow for the rows of a task are marked in words, a bit a number. Other values
    are told apart by 8-byte digests, combined inside each task first. Texts have a second digest; where one first
    digest has two second ones, the texts themselves are counted.
    """
    fields, out = df.schema.fields, {}
    for at in range(0, len(ordinals), TOGETHER):
        chosen = ordinals[at:at + TOGETHER]
        with dealt(df.select(*[col(fields[o].name).alias(f"c{o}") for o in chosen]), deal) as rows:
            out.update(_distinct(rows, {o: fields[o].dataType for o in chosen}))
    return out


def _marked(tall: DataFrame) -> DataFrame:
    """(o, word, bits) with a bit set for each number v >= 0 of column o: a word a task at most for WORD_BITS numbers."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("v") % WORD_BITS).cast("int"))
    return tall.groupBy("o", F.expr(f"v div {WORD_BITS}").alias("word")).agg(F.bit_or(bit).alias("bits"))


def _distinct(rows: DataFrame, types: dict[int, T.DataType]) -> dict[int, tuple[int, int]]:
    whole = [o for o, t in types.items() if isinstance(t, (T.IntegralType, T.BooleanType))]
    value = {o: F.col(f"c{o}") for o in types}
    seen = rows.agg(*[F.count(value[o]).alias(f"n{o}") for o in types], *[
        e for o in whole for e in (F.min(value[o].cast("long")).alias(f"a{o}"), F.max(value[o].cast("long")).alias(f"b{o}"))]).first()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, estimated_bytes(rows) // TASK_BYTES)
    mapped = [o for o in whole if seen[f"n{o}"] and seen[f"b{o}"] - seen[f"a{o}"] <= 64 * seen[f"n{o}"] // tasks]
    out = {o: (seen[f"n{o}"], 0) for o in types}
    if mapped:
        cells = [F.struct(F.lit(o).alias("o"), (value[o].cast("long") - F.lit(seen[f"a{o}"])).alias("v")) for o in mapped]
        tall = rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("v IS NOT NULL")
        for r in _marked(tall).groupBy("o").agg(F.sum(F.bit_count("bits")).alias("n")).collect():
            out[r.o] = (out[r.o][0], r.n)
    rest = [o for o in types if o not in mapped and seen[f"n{o}"]]
    if rest:
        cells = []
        for o in rest:
            a, b = _digest(value[o], types[o])
            cells.append(F.when(value[o].isNotNull(), F.struct(F.lit(o).alias("o"), a.alias("a"), b.alias("b"))))
        tall = rows.select(F.explode(F.array(*cells)).alias("c")).where("c IS NOT NULL").select("c.*")
        digests = tall.groupBy("o", "a").agg((F.min("b") != F.max("b")).alias("clash"))
        for r in digests.groupBy("o").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("clash"), F.col("a"))).alias("clashes")).collect():
            out[r.o] = (out[r.o][0], r.n)
            if r.clashes:
                met = rows.where(_digest(value[r.o], types[r.o])[0].isin(r.clashes)).agg(F.count_distinct(value[r.o])).first()[0]
                out[r.o] = (out[r.o][0], r.n - len(r.clashes) + met)
    return out
