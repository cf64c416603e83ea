"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Up to so many links (1.6 MB) a graph is contracted in one task; a larger one goes through stars until it is that small or done.
FEW_LINKS = 100_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of every node in the links (a, b) of a task."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up[above]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(x) for x in list(up)], pa.int64())],
                                     names=["node", "root"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: every neighbour of a node is linked to the smallest of them, the node included.

    The large step moves the neighbours above the node, the small step those below it. Minima are
    pre-aggregated, so a node with very many links is never gathered anywhere.
    """
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).unionByName(
            least.select(F.col("a").alias("hi"), F.col("m").alias("lo")))
    return (moved.where("hi <> lo").distinct()
            .select(F.col("lo").alias("a"), F.col("hi").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs to (node, root): the smallest node of each component, for every linked node.

    Alternating large and small stars (Kiveris et al., 2014): rounds grow with the logarithm of the size.
    Each round is cut off by a checkpoint, and has some ten shuffles however few links there are, so FEW_LINKS or
    fewer are contracted in one task instead. No links give an empty table.
    """
    now = cut_lineage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                      .distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] <= FEW_LINKS:
            return now.coalesce(1).mapInArrow(_contracted, "node long, root long")
        if seen == tuple(mark):
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        seen = tuple(mark)
        now = cut_lineage(_star(_star(now, large=True), large=False))
