"""Exact neighbour search over space blocks.

Rows at the same place are collapsed to one place with a number of copies. Places are
cut into blocks of bounded size, by pivots (``metric_space``) or by quantile splits of
the coordinates. A block is compared with another only when their bounding boxes are
close enough. By pivots, two bounded groups of blocks meet in a task, and a row travels once
for each group; by splits, a block meets bounded chunks of visitors, found by descending the
split tree with equi-joins. Only the wanted neighbours leave a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage
from .metric_space import (Blocks, Part, gaps, meet_groups, metric_name, pair_gaps, point_of, reported, rough_squares,
                           with_slack)

BLOCK_ROWS = 512
VISITORS = 2048               # visiting places compared with a block in one task
FANOUT = 16
MEASURED = 100_000            # pairs measured at a time


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def box_gap(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Smallest distance between two boxes; a point is a box without extent."""
    apart = F.zip_with(F.zip_with(low, other_high, lambda a, b: a - b),
                       F.zip_with(other_low, high, lambda a, b: a - b),
                       lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x))


def collapse(df: DataFrame, features: list[str], key: str,
             metric: str = "euclidean") -> tuple[DataFrame, DataFrame]:
    """(key, place) and (place, point, copies); a place is named by its smallest key."""
    rows = df.select(col(key), point_of(features, metric).alias("point"))
    places = cut_lineage(rows.groupBy("point").agg(F.min(col(key)).alias("place"), F.count("*").alias("copies")))
    return rows.join(places.select("point", "place"), "point").select(col(key), "place"), places


def assign_blocks(places: DataFrame, width: int, block_rows: int) -> tuple[DataFrame, int]:
    """Adds ``node`` (path in the split tree) and ``block``; returns the tree's depth."""
    count = places.count()
    depth = max(0, math.ceil(math.log(max(count, 1) / block_rows, FANOUT))) if count > block_rows else 0
    out = places.withColumn("node", F.lit(0).cast("long"))
    if depth:
        spread = places.agg(*[F.var_pop(F.col("point")[i]).alias(str(i)) for i in range(width)]).first()
        widest = sorted(range(width), key=lambda i: -(spread[i] or 0.0))
        cuts = F.array(*[F.lit(i / FANOUT) for i in range(1, FANOUT)])
        for level in range(depth):
            value = F.col("point")[widest[level % width]]
            borders = out.groupBy("node").agg(
                F.percentile_approx(value, cuts, F.lit(1000)).alias("borders"))
            branch = F.size(F.filter("borders", lambda b: b < value)).cast("long")
            out = (out.join(borders, "node")
                   .withColumn("node", F.col("node") * FANOUT + branch).drop("borders"))
    # equal values can leave a node too large: its places are then dealt out by hash
    sizes = out.groupBy("node").agg(F.ceil(F.count("*") / F.lit(float(block_rows))).alias("deal"))
    dealt = F.pmod(F.xxhash64("place"), F.col("deal"))
    out = (out.join(sizes, "node").withColumn("block", F.concat_ws("-", "node", dealt)).drop("deal"))
    return cut_lineage(out), depth


def _boxes(name: str):
    """Bounding box of a group of boxes."""
    def boxes(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.min(np.stack(pdf["low"]), axis=0)
        high = np.max(np.stack(pdf["high"]), axis=0)
        return pd.DataFrame({name: [keys[0]], "low": [low], "high": [high]})
    return boxes


def block_boxes(placed: DataFrame) -> DataFrame:
    """(block, node, low, high): the bounding box of each block."""
    points = placed.select("block", F.col("point").alias("low"), F.col("point").alias("high"))
    boxes = points.groupBy("block").applyInPandas(
        _boxes("block"), "block string, low array<double>, high array<double>")
    return boxes.withColumn("node", F.split("block", "-")[0].cast("long"))


def close_blocks(visitors: DataFrame, boxes: DataFrame, depth: int) -> DataFrame:
    """Pairs (visitor columns..., block) whose boxes are at most ``reach`` apart.

    ``visitors`` has low, high and reach. One equi-join per tree level.
    """
    levels, below = [], boxes.select("node", "low", "high")
    for _ in range(depth):
        below = below.groupBy("node").applyInPandas(
            _boxes("node"), "node long, low array<double>, high array<double>")
        levels.append(below)
        below = below.withColumn("node", F.floor(F.col("node") / FANOUT).cast("long"))
    mine = [c for c in visitors.columns]
    frontier = visitors.withColumn("_at", F.lit(0).cast("long"))

    def step(frontier: DataFrame, children: DataFrame, parent: Column, keep: list) -> DataFrame:
        child = children.select(parent.alias("_parent"), F.col("low").alias("_low"),
                                F.col("high").alias("_high"), *keep)
        return (frontier.join(child, F.col("_at") == F.col("_parent"))
                .where(box_gap(F.col("low"), F.col("high"), F.col("_low"), F.col("_high")) <= F.col("reach")))

    for level in reversed(levels):
        parent = F.floor(F.col("node") / FANOUT).cast("long")
        frontier = (step(frontier, level, parent, [F.col("node").alias("_next")])
                    .select(*mine, F.col("_next").alias("_at")))
    found = step(frontier, boxes, F.col("node"), [F.col("block").alias("_block")])
    return found.select(*mine, F.col("_block").alias("near_block"),
                        F.col("_low").alias("near_low"), F.col("_high").alias("near_high"))


def meet(visitors: DataFrame, placed: DataFrame, compare, schema: str) -> DataFrame:
    """Run ``compare(visitors, block)`` on each block with chunks of its visitors.

    ``visitors`` has ``near_block`` and ``visitor``. Popular blocks are copied to as many
    chunks as they need, so neither side of a task is larger than its bound.
    """
    crowd = visitors.groupBy("near_block").agg(
        F.ceil(F.count("*") / F.lit(float(VISITORS))).cast("int").alias("chunks"))
    left = (visitors.join(crowd, "near_block")
            .withColumn("chunk", F.pmod(F.xxhash64("visitor"), F.col("chunks")).cast("int")).drop("chunks"))
    # fresh names throughout: both sides may stem from the same table
    right = (placed.select(*[F.col(c).alias({"block": "near_block"}.get(c, f"near_{c}")) for c in placed.columns])
             .join(crowd.select(F.col("near_block").alias("crowded"), F.col("chunks").alias("copies_needed")),
                   F.col("near_block") == F.col("crowded"))
             .withColumn("near_chunk", F.explode(F.sequence(F.lit(0), F.col("copies_needed") - 1)))
             .drop("crowded", "copies_needed"))
    return (left.groupBy("near_block", "chunk").cogroup(right.groupBy("near_block", "near_chunk"))
            .applyInPandas(compare, schema))


def pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows of two bounded matrices, without cancellation."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        diff = a[:, i, None] - b[None, :, i]
        out += diff * diff
    return np.sqrt(out)


def _in_reach(a: np.ndarray, b: np.ndarray, reach_a: np.ndarray, reach_b: np.ndarray | None, most: int,
              metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of pairs within the reach of one of both; of many only the ``most`` nearest of each row and ties."""
    mutual = reach_b is not None
    if metric in ("manhattan", "chebyshev"):
        rough, error = gaps(a, b, metric), np.zeros(len(a))
    else:
        rough, error = rough_squares(a, b)
        reach_a, reach_b = reach_a * reach_a, reach_b * reach_b if mutual else None
    slack = 3.0 * error

    def reached() -> np.ndarray:
        close = rough <= (reach_a + slack)[:, None]
        if mutual:
            close |= rough <= reach_b + slack.max(initial=0.0)
        return close

    close = reached()
    if np.count_nonzero(close) > 4 * most * (len(a) + len(b)):
        if len(b) > most:
            reach_a = np.minimum(reach_a, np.partition(rough, most - 1, axis=1)[:, most - 1])
        if mutual and len(a) > most:
            reach_b = np.minimum(reach_b, np.partition(rough, most - 1, axis=0)[most - 1])
        close = reached()
    i, j = np.nonzero(close)
    if metric in ("manhattan", "chebyshev"):
        return i, j, rough[i, j]
    far = [pair_gaps(a[i[s:s + MEASURED]], b[j[s:s + MEASURED]]) for s in range(0, max(len(i), 1), MEASURED)]
    return i, j, np.concatenate(far)


class _Nearest:
    """The nearest neighbours of some rows among those seen so far, until ``k`` copies are gathered for each."""

    def __init__(self, reach: np.ndarray, ranks: np.ndarray, copies: np.ndarray, k: int):
        self.reach, self.ranks, self.copies, self.k = reach.copy(), ranks, copies, k
        self.found, self.waiting, self.held = [], 0, 0

    def add(self, i: np.ndarray, j: np.ndarray, far: np.ndarray, weights: np.ndarray) -> None:
        kept = (weights > 0) & (far <= self.reach[i])
        self.found.append((i[kept], j[kept], far[kept], weights[kept]))
        self.waiting += int(kept.sum())
        if self.waiting > max(self.held, 4 * self.k * len(self.reach)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """(i, j, distance, copies), nearest first; what is found later must be as near."""
        i, j, far, weights = (np.concatenate(c) for c in zip(*self.found)) if self.found else (np.zeros(0, dtype=int),) * 4
        order = np.lexsort((self.ranks[j], far, i))
        i, j, far, weights = i[order], j[order], far[order], weights[order]
        before = np.cumsum(weights) - weights
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, dtype=int)
        before = before - np.repeat(before[first], np.diff(np.r_[first, len(i)]))
        full = (before < self.k) & (before + weights >= self.k)
        self.reach[i[full]] = far[full]
        wanted = before < self.k
        cut = i[wanted], j[wanted], far[wanted], np.minimum(weights[wanted], self.k)
        self.found, self.waiting, self.held = [cut], 0, len(cut[0])
        return cut


def _table(parts: list[tuple]) -> pa.Table:
    """(place, neighbor, distance, copies) of (seekers, others, what a ``_Nearest`` of them holds)."""
    columns = []
    for seekers, others, (i, j, far, weights) in parts:
        columns.append([seekers.named(i), others.named(j), pa.chunked_array([pa.array(far, pa.float64())]),
                        pa.chunked_array([pa.array(weights, pa.int64())])])
    names = ["place", "neighbor", "distance", "copies"]
    return pa.concat_tables([pa.table(dict(zip(names, c))) for c in columns])


def _found(blocks: Blocks) -> str:
    kind = dict(blocks.placed.dtypes)["place"]
    return f"place {kind}, neighbor {kind}, distance double, copies long"


def _own(blocks: Blocks, k: int) -> DataFrame:
    """The k nearest rows of each place in its own group."""
    metric = blocks.metric

    def within_group(table: pa.Table) -> pa.Table:
        part = Part(table.drop_columns(["group"]))
        ranks, copies = part.ranks(), part.column("copies")
        cuts = []
        for u, rows in part.blocks():
            best = _Nearest(np.full(len(rows), np.inf), ranks, copies, k)

            def look(others: np.ndarray) -> None:
                # a row is not its own neighbour, but takes one of the places
                i, j, far = _in_reach(part.points[rows], part.points[others], best.reach, None, k + 1, metric)
                best.add(i, others[j], far, copies[others[j]] - (others[j] == rows[i]))

            look(rows)                                    # the own block sets the reach
            best.cut()
            for others in part.tiles(u, part, best.reach.max()):
                others = others[(others < rows[0]) | (others > rows[-1])]
                if len(others):
                    look(others)
            i, *rest = best.cut()
            cuts.append((rows[i], *rest))
        return _table([(part, part, cut) for cut in cuts])

    return blocks.members("copies").groupBy("group").applyInArrow(within_group, _found(blocks))


def _seekers(blocks: Blocks, own: DataFrame, k: int) -> DataFrame:
    """The places with ``reach``, beyond which none needs to look.

    A place needs nothing beyond its k-th neighbour in its own group, nor beyond a pivot's distance plus the
    distance within which more than k rows lie around that pivot.
    """
    gathered = own.groupBy("place").agg(F.sum("copies").alias("n"), F.max("distance").alias("d"))
    infinite = F.lit(float("inf"))
    around = F.array_min(F.zip_with("at", F.array(*[F.lit(t) for t in blocks.enough(k)]), lambda a, t: a + t))
    return (blocks.placed.join(gathered, "place", "left")
            .withColumn("reach", F.least(F.when(F.col("n") >= k, F.col("d")).otherwise(infinite), around))
            .withColumn("reach", with_slack(F.col("reach"))))


def _visits(blocks: Blocks, own: DataFrame, k: int) -> DataFrame:
    """(near_block, visitor, point, reach): which places must see which other blocks."""
    return (blocks.near(_seekers(blocks, own, k).select("block", "place", "point", "at", "reach"))
            .where(F.col("block") != F.col("near_block"))
            .select("near_block", F.col("place").alias("visitor"), "point", "reach"))


def _across(blocks: Blocks, own: DataFrame, k: int) -> DataFrame:
    """The nearest rows of each place in every other group, as far as they may be among its k nearest."""
    metric = blocks.metric
    seekers = cut_lineage(_seekers(blocks, own, k))
    rows = seekers.select("group", F.xxhash64("block").alias("block"), "place", "point", "at", "copies", "reach")
    pairs = blocks.pairs(F.col("reach"), seekers=seekers).where("a < b")

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        a, b = Part(one), Part(other)
        best_a = _Nearest(a.column("reach"), b.ranks(), b.column("copies"), k)
        best_b = _Nearest(b.column("reach"), a.ranks(), a.column("copies"), k)
        if a.rows and b.rows:
            widest = np.maximum.reduceat(best_b.reach, b.starts)
            for u, rows in a.blocks():
                for others in a.tiles(u, b, np.maximum(widest, best_a.reach[rows].max())):
                    i, j, far = _in_reach(a.points[rows], b.points[others], best_a.reach[rows], best_b.reach[others], k, metric)
                    i, j = rows[i], others[j]
                    best_a.add(i, j, far, best_a.copies[j])
                    best_b.add(j, i, far, best_b.copies[i])
        return _table([(a, b, best_a.cut()), (b, a, best_b.cut())])

    return meet_groups(rows, rows, pairs, compare, _found(blocks))


def nearest_neighbors(df: DataFrame, features: list[str], key: str, k: int, block_rows: int | None = None,
                      metric: str = "euclidean") -> tuple[DataFrame, DataFrame]:
    """((key, place), (place, neighbor, distance, copies)): the k nearest other rows.

    Neighbours are places; ``copies`` says how many of a place's rows are among the k.
    Ties at the k-th distance go to the smaller key. ``metric`` is euclidean, manhattan,
    chebyshev or cosine.
    """
    metric = metric_name(metric)
    block_rows = block_rows or max(BLOCK_ROWS, 4 * k)
    keys, places = collapse(df, features, key, metric)
    blocks = Blocks(places, metric, block_rows)
    near = own = _own(blocks, k)
    if blocks.groups > 1:
        own = cut_lineage(own)
        near = own.unionByName(_across(blocks, own, k))
    order = W.partitionBy("place").orderBy("distance", "neighbor")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    best = (near.withColumn("before", before).where(F.col("before") < k)
            .select("place", "neighbor", reported(F.col("distance"), metric).alias("distance"),
                    F.least("copies", F.lit(k) - F.col("before")).alias("copies")))
    return keys, cut_lineage(best)
