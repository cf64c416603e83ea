"""Blocks of close rows in any metric, with bounds from pivots.

A few far-apart rows of a bounded sample serve as pivots. A place is described by its distances to them; by
the triangle inequality two places are at least as far apart as any of these distances differ, and at most as
far as any two of them sum to. Places are cut into bounded blocks, first by nearest pivot, then by quantiles
of the distance that varies most in the block, and a block keeps the range of each distance. Pivots decide
how much is compared, never what is found.

Runs of blocks form groups, GROUPS of them until these get too large. Two groups meet in one task, which compares the
blocks that may be close tile by tile. So a row travels as often as there are groups, not once for each block it meets,
and what is shuffled grows with the rows even where every block is close to every other.

Cosine distances are taken between directions: half the squared Euclidean distance of unit vectors, which
orders pairs alike. A row without direction (all zero) is at distance 1 from all directions and 0 from its like.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage
from .browse import OrderIndex

PIVOTS = 16                   # also the fan-out of the split tree
GROUPS = 16                   # groups of blocks, more only where one would have over GROUP_ROWS places
GROUP_ROWS = 65_536
TILE = 4096                   # places that a block is compared with at a time
PIVOT_SAMPLE = 4096           # places the pivots are chosen from
SLACK = 1e-12                 # relative rounding of a difference of two distances

# names of one metric
ALIASES = {"minkowski": "euclidean", "l2": "euclidean", "cityblock": "manhattan", "l1": "manhattan"}
METRICS = ("euclidean", "manhattan", "chebyshev", "cosine")


def metric_name(metric: str) -> str:
    name = ALIASES.get(metric, metric)
    if name not in METRICS:
        raise ValueError(f"unknown metric {metric!r}: one of {', '.join(METRICS)}")
    return name


def point_of(features: list[str], metric: str) -> Column:
    """The row as an array; a direction with a last coordinate for rows without one, if cosine."""
    # adding 0.0 makes -0.0 and 0.0 the same place
    point = F.array(*[col(f).cast("double") + F.lit(0.0) for f in features])
    if metric != "cosine":
        return point
    norm = F.sqrt(F.aggregate(point, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(point, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)) + F.lit(0.0))
    return F.concat(unit, F.array(F.when(norm > 0, 0.0).otherwise(1.0)))


def reported(gap: Column, metric: str) -> Column:
    """A distance of points as the metric names it."""
    return gap * gap / 2.0 if metric == "cosine" else gap


def radius_of(eps: float, metric: str) -> float:
    """The distance of points that the metric calls ``eps``."""
    return math.sqrt(2.0 * eps) if metric == "cosine" else eps


def gaps(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances between the rows of two bounded matrices, without cancellation."""
    out = np.zeros((len(a), len(b)))
    wide, b = max(1, 16_384 // max(len(b), 1)), np.ascontiguousarray(b.T)
    diff = np.empty((wide, b.shape[1]))
    for at in range(0, len(a), wide):                     # parts that stay in the cache
        rows, part = a[at:at + wide], out[at:at + wide]
        gap = diff[:len(rows)]
        for i in range(a.shape[1]):
            np.subtract(rows[:, i, None], b[i], out=gap)
            if metric in ("manhattan", "chebyshev"):
                np.abs(gap, out=gap)
                (np.add if metric == "manhattan" else np.maximum)(part, gap, out=part)
            else:
                np.multiply(gap, gap, out=gap)
                np.add(part, gap, out=part)
    return out if metric in ("manhattan", "chebyshev") else np.sqrt(out, out=out)


def rough_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared Euclidean distances by one matrix product, and a bound of their error for each row of ``a``."""
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    long_a, long_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    error = 1e-14 * (a.shape[1] + 8) * (long_a + long_b.max(initial=0.0))
    left = np.column_stack([-2.0 * a, long_a, np.ones(len(a))])
    return left @ np.column_stack([b, np.ones(len(b)), long_b]).T, error


def pair_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of ``a`` to the same row of ``b``, added up as in ``gaps``."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        diff = a[:, i] - b[:, i]
        out += diff * diff
    return np.sqrt(out)


def within(a: np.ndarray, b: np.ndarray, radius: float, metric: str) -> np.ndarray:
    """Which pairs are at most ``radius`` apart; only pairs near the border are measured one by one."""
    if metric in ("manhattan", "chebyshev"):
        return gaps(a, b, metric) <= radius
    squares, error = rough_squares(a, b)
    error = error + 1e-14 * radius * radius
    close = squares <= radius * radius - error[:, None]
    i, j = np.nonzero(~close & (squares <= radius * radius + error[:, None]))
    if len(i):
        close[i, j] = pair_gaps(a[i], b[j]) <= radius
    return close


def _far_apart(points: np.ndarray, metric: str) -> np.ndarray:
    """Up to PIVOTS rows, each the farthest from those before it."""
    chosen = [0]
    nearest = gaps(points, points[:1], metric)[:, 0]
    while len(chosen) < min(PIVOTS, len(points)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, gaps(points, points[chosen[-1:]], metric)[:, 0])
    return points[chosen]


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    if not len(lists):
        return np.zeros((0, 1))
    return pa.concat_arrays([c.flatten() for c in lists.chunks]).to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class Part:
    """A group's rows (block, place, point, at and others) in a task, ordered by block; a row is known by its number."""

    def __init__(self, table: pa.Table):
        block = table["block"].to_numpy()
        self.order = np.argsort(block, kind="stable")
        self.table, self.rows = table, len(block)
        self.points, at = matrix(table["point"])[self.order], matrix(table["at"])[self.order]
        block = block[self.order]
        self.starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if self.rows else np.zeros(0, dtype=int)
        self.ends = np.r_[self.starts[1:], self.rows]
        if self.rows:
            self.low, self.high = np.minimum.reduceat(at, self.starts), np.maximum.reduceat(at, self.starts)

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()[self.order]

    def named(self, rows: np.ndarray) -> pa.ChunkedArray:
        return self.table["place"].take(pa.array(self.order[rows]))

    def ranks(self) -> np.ndarray:
        """Where each row's place comes among all places in order."""
        out = np.empty(self.rows, dtype=np.int64)
        out[pc.sort_indices(self.table["place"]).to_numpy()] = np.arange(self.rows)
        return out[self.order]

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        for u, (start, end) in enumerate(zip(self.starts, self.ends)):
            yield u, np.arange(start, end)

    def tiles(self, u: int, other: Part, reach: np.ndarray | float) -> Iterator[np.ndarray]:
        """The rows of ``other``, some at a time, in blocks that may be at most ``reach`` (one for each) from block ``u``."""
        apart = np.maximum(other.low - self.high[u], self.low[u] - other.high).max(axis=1)
        # rounding of the pivot distances must not undercut the reach
        met = np.flatnonzero(apart <= reach + SLACK * (self.high[u].max() + reach))
        if len(met):
            rows = np.concatenate([np.arange(other.starts[i], other.ends[i]) for i in met])
            for at in range(0, len(rows), TILE):
                yield rows[at:at + TILE]


def meet_groups(left: DataFrame, right: DataFrame, pairs: DataFrame, compare: Callable[[pa.Table, pa.Table | None], pa.Table],
                schema: str, itself: bool = False) -> DataFrame:
    """``compare`` on the rows of two groups for each pair (a, b) of them; in itself a group meets None unless told otherwise."""
    laid = left.join(pairs, left["group"] == pairs["a"]).drop("group")
    # fresh names throughout: both sides may stem from the same table
    others = right.select(*[F.col(c).alias(f"near_{c}") for c in right.columns]).join(
        pairs.select(F.col("a").alias("near_a"), F.col("b").alias("near_b")).where(F.lit(itself) | F.expr("near_a <> near_b")),
        F.col("near_group") == F.col("near_b")).drop("near_group")

    def run(pair: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        one, other = one.drop_columns(["a", "b"]), other.drop_columns(["near_a", "near_b"])
        if pair[0] == pair[1] and not itself:
            return compare(one, None)
        return compare(one, other.rename_columns([c.removeprefix("near_") for c in other.column_names]))

    return laid.groupBy("a", "b").cogroup(others.groupBy("near_a", "near_b")).applyInArrow(run, schema)


class Blocks:
    """``placed`` (place, point, copies, at, node, block, group); ``at`` has the pivot distances.

    ``enough(k)`` gives, per pivot, a distance within which more than ``k`` rows lie (infinite if none is known).
    """

    def __init__(self, places: DataFrame, metric: str, block_rows: int):
        self.metric = metric
        # the rows with the smallest hashes: a bounded sample that a rerun draws alike
        sample = (places.select("point", "copies", F.xxhash64("place").alias("h"))
                  .orderBy("h", "point").limit(PIVOT_SAMPLE).toPandas())
        self.places = places.count()
        points = np.stack(sample["point"]) if len(sample) else np.zeros((1, 1))
        self.pivots = _far_apart(points, metric)
        self._sampled = gaps(points, self.pivots, metric)
        self._copies = sample["copies"].to_numpy() if len(sample) else np.zeros(1, dtype=int)
        self.placed = self._grouped(self._cut(places, block_rows), block_rows)

    def _grouped(self, placed: DataFrame, block_rows: int) -> DataFrame:
        """Adds ``group``: equally many places in the order of the tree."""
        blocks = math.ceil(self.places / block_rows)
        self.groups = max(1, min(GROUPS, blocks), math.ceil(self.places / GROUP_ROWS))
        if self.groups == 1:
            return cut_lineage(placed.withColumn("group", F.lit(0)))
        ordered = OrderIndex(placed.select("node", "block", "place", "point", "copies", "at"), "node").numbered("position")
        group = F.floor(F.col("position") * F.lit(self.groups) / F.lit(self.places)).cast("int")
        return ordered.withColumn("group", group).drop("position")

    def pairs(self, reach: Column, mutual: bool = True, seekers: DataFrame | None = None) -> DataFrame:
        """(a, b) for groups that may hold places at most the larger ``reach`` of both apart; ``mutual``: a <= b only.

        The reach is a column of ``seekers``, by default of ``placed``.
        """
        every = range(len(self.pivots))
        box = (self.placed if seekers is None else seekers).groupBy("group").agg(
            F.max(reach).alias("reach"), F.array(*[F.min(F.col("at")[i]) for i in every]).alias("low"),
            F.array(*[F.max(F.col("at")[i]) for i in every]).alias("high"))
        box = cut_lineage(box)
        first = F.col("group") if mutual else F.lit(0)
        mine = box.select(F.col("group").alias("a"), "reach", "low", "high",
                          F.explode(F.sequence(first, F.lit(self.groups - 1))).alias("b"))
        other = box.select(F.col("group").alias("b"), F.col("reach").alias("near_reach"), F.col("low").alias("near_low"),
                           F.col("high").alias("near_high"))
        return cut_lineage(mine.join(other, "b").where(_apart(F.col("low"), F.col("high")) <= F.greatest("reach", "near_reach"))
                           .select("a", "b"))

    def members(self, *columns: str) -> DataFrame:
        """The rows as ``Part`` takes them, with further columns."""
        return self.placed.select("group", F.xxhash64("block").alias("block"), "place", "point", "at", *columns)

    def enough(self, k: int) -> list[float]:
        out = []
        for i in range(len(self.pivots)):
            order = np.argsort(self._sampled[:, i], kind="stable")
            filled = np.flatnonzero(np.cumsum(self._copies[order]) > k)
            out.append(float(self._sampled[order[filled[0]], i]) if len(filled) else math.inf)
        return out

    def _cut(self, places: DataFrame, block_rows: int) -> DataFrame:
        pivots, metric = self.pivots, self.metric

        @F.pandas_udf("array<double>")
        def to_pivots(points: pd.Series) -> pd.Series:
            if points.empty:
                return pd.Series([], dtype=object)
            return pd.Series(list(gaps(np.stack(points), pivots, metric)))

        out = places.withColumn("at", to_pivots("point"))
        self.depth = 0
        if self.places <= block_rows:
            return out.withColumn("node", F.lit(0).cast("long")).withColumn("block", F.lit("0-0"))
        out = cut_lineage(out.withColumn("node", F.array_position("at", F.array_min("at")) - 1))
        self.depth = 1
        spread = F.array(*[F.var_pop(F.col("at")[i]) for i in range(len(pivots))])
        cuts = F.array(*[F.lit(i / PIVOTS) for i in range(1, PIVOTS)])
        for _ in range(math.ceil(math.log(self.places / block_rows, PIVOTS))):
            ways = out.groupBy("node").agg(
                F.count("*").alias("n"), (F.array_position(spread, F.array_max(spread))).cast("int").alias("widest"))
            value = F.element_at("at", F.col("widest"))
            borders = (out.join(ways, "node").groupBy("node").agg(
                F.first("widest").alias("widest"), F.first("n").alias("n"),
                F.percentile_approx(value, cuts, F.lit(1000)).alias("borders")))
            # a small node stays whole, others get as many parts as they need
            parts = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / F.lit(float(block_rows))))
            branch = F.floor(F.size(F.filter("borders", lambda b: b < value)) * parts / F.lit(float(PIVOTS)))
            out = cut_lineage(out.join(borders, "node")
                              .withColumn("node", (F.col("node") * PIVOTS + branch).cast("long"))
                              .drop("borders", "widest", "n"))
            self.depth += 1
        # places the pivots cannot tell apart are dealt out by hash
        sizes = out.groupBy("node").agg(F.ceil(F.count("*") / F.lit(float(block_rows))).alias("deal"))
        dealt = F.pmod(F.xxhash64("place"), F.col("deal"))
        return out.join(sizes, "node").withColumn("block", F.concat_ws("-", "node", dealt)).drop("deal")

    def near(self, seekers: DataFrame) -> DataFrame:
        """``seekers`` (block, at, reach, ...) with each ``near_block`` that may hold places in reach, the own included.

        The tree of boxes is descended for whole blocks by equi-joins, then single places are tested.
        """
        every = range(len(self.pivots))
        bounds = [F.array(*[F.min(F.col("low")[i]) for i in every]).alias("low"),
                  F.array(*[F.max(F.col("high")[i]) for i in every]).alias("high")]
        boxes = cut_lineage(self.placed.groupBy("block", "node").agg(
            F.array(*[F.min(F.col("at")[i]) for i in every]).alias("low"),
            F.array(*[F.max(F.col("at")[i]) for i in every]).alias("high")))
        levels, below = [], boxes.select("node", "low", "high")
        for _ in range(self.depth):
            below = below.groupBy("node").agg(*bounds)
            levels.append(below)
            below = below.withColumn("node", F.floor(F.col("node") / PIVOTS).cast("long"))
        widest = seekers.groupBy("block").agg(F.max("reach").alias("reach"))
        frontier = (boxes.drop("node").join(widest, "block")
                    .withColumn("node_at", F.lit(0).cast("long")))

        def step(children: DataFrame, parent: Column, name: str) -> DataFrame:
            child = children.select(parent.alias("parent"), F.col("low").alias("near_low"),
                                    F.col("high").alias("near_high"), F.col(name).alias("found"))
            return (frontier.join(child, F.col("node_at") == F.col("parent"))
                    .where(_apart(F.col("low"), F.col("high")) <= F.col("reach"))
                    .select("block", "low", "high", "reach", "near_low", "near_high", "found"))

        for level in reversed(levels):
            frontier = (step(level, F.floor(F.col("node") / PIVOTS).cast("long"), "node")
                        .select("block", "low", "high", "reach", F.col("found").alias("node_at")))
        pairs = step(boxes, F.col("node"), "block").select(
            "block", F.col("found").alias("near_block"), "near_low", "near_high")
        return (seekers.join(pairs, "block").where(_apart(F.col("at"), F.col("at")) <= F.col("reach"))
                .drop("near_low", "near_high"))


def _apart(low: Column, high: Column) -> Column:
    """The largest gap between the ranges of two boxes; no two of their places are closer."""
    return F.array_max(F.zip_with(F.zip_with(low, F.col("near_high"), lambda a, b: a - b),
                                  F.zip_with(F.col("near_low"), high, lambda a, b: a - b),
                                  lambda x, y: F.greatest(x, y, F.lit(0.0))))


def with_slack(reach: Column) -> Column:
    """A reach that rounding of the pivot distances cannot undercut."""
    return reach + F.lit(SLACK) * (F.array_max("at") + reach)
