"""Density-based clustering (DBSCAN), exact, without listing all neighbour pairs.

In a few Euclidean dimensions space is cut into cells so small that all rows of a cell are within ``eps`` of each
other. A cell with enough rows is core as a whole, and a cell's core rows are always in
one cluster, so crowded places cost one cell each however many rows they hold. Only rows
of sparse cells are counted one by one, and clusters are components of a graph of cells.

In many dimensions or another metric there are no such cells. There places are cut into
bounded blocks by pivots, and bounded groups of blocks meet in tasks, where a block is compared
with those within ``eps`` of its range. Tasks count neighbours, join core rows they see to local
clusters, and give one link per row to its local cluster; clusters are components of these links.
Rows leave a task, pairs never do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage
from .browse import OrderIndex
from .metric_space import Blocks, Part, meet_groups, metric_name, radius_of, with_slack, within
from .neighbors import (BLOCK_ROWS, assign_blocks, block_boxes, box_gap, close_blocks, collapse,
                        distance, meet, pairwise)

NOISE = -1
GRID_WIDTH = 4                # a cell has few neighbour cells up to here
CELL_CHUNK = 4096             # places of one cell that meet in one task
BUNDLE_ROWS = 20_000          # about as many places of many small pairs of cells in one group


def _cells(places: DataFrame, eps: float, width: int) -> DataFrame:
    """Adds the cell of each place: its integer coordinates."""
    side = eps / math.sqrt(width) * (1.0 - 1e-9)
    return places.withColumn("cell", F.transform("point", lambda x: F.floor(x / side).cast("long"))), side


def _near_cells(cells: DataFrame, eps: float, side: float, width: int, block_rows: int) -> DataFrame:
    """(a, b) for distinct cells at most ``eps`` apart, both ways."""
    corners = cells.select(F.col("cell_id").alias("place"),
                           F.transform("cell", lambda i: i * F.lit(side)).alias("point"))
    placed, depth = assign_blocks(corners, width, block_rows)
    boxes = cut_lineage(block_boxes(placed))
    # corners of cells whose boxes touch the eps range are at most this far apart
    reach = eps + side * math.sqrt(width)
    pairs = close_blocks(boxes.select("block", "low", "high", F.lit(reach).alias("reach")), boxes, depth)
    visitors = (placed.join(pairs.select("block", "near_block", "near_low", "near_high"), "block")
                .where(box_gap(F.col("point"), F.col("point"), F.col("near_low"), F.col("near_high")) <= reach)
                .select("near_block", F.col("place").alias("visitor"), "point"))
    key = dict(placed.dtypes)["place"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["a", "b"])
        a, b = np.rint(np.stack(left["point"]) / side), np.rint(np.stack(right["near_point"]) / side)
        # gap of two grid cells in units of the side
        gap = np.zeros((len(a), len(b)))
        for i in range(width):
            apart = np.maximum(np.abs(a[:, i, None] - b[None, :, i]) - 1.0, 0.0)
            gap += apart * apart
        names_a, names_b = left["visitor"].to_numpy(), right["near_place"].to_numpy()
        close = (np.sqrt(gap) * side <= eps) & (names_a[:, None] != names_b[None, :])
        i, j = np.nonzero(close)
        return pd.DataFrame({"a": names_a[i], "b": names_b[j]})

    return meet(visitors, placed.select("block", "place", "point"), compare, f"a {key}, b {key}")


def _salted(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members dealt into chunks of at most about CELL_CHUNK places per cell."""
    return (members.join(sizes, "cell_id")
            .withColumn("chunk", F.pmod(F.xxhash64("place"), F.col("chunks")).cast("int")).drop("chunks"))


def _mark(edges: DataFrame) -> tuple:
    """What tells two sets of edges apart."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected (a, b) edges; a component is named by its smallest node.

    Alternates large-star and small-star steps, which need a number of rounds that is
    logarithmic in the size of a component, each a grouped minimum and an equi-join.
    """
    current = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"),
                                                       F.least("a", "b").alias("b")).distinct())
    mark = _mark(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where(F.col("b") > F.col("a")).join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b")))
                 .where("a != b").distinct())
        current, before = cut_lineage(small), mark
        mark = _mark(current)
        if mark == before:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _linked_cells(core: DataFrame, near: DataFrame, eps: float, side: float) -> DataFrame:
    """(a, b), a < b: near cells with two core places at most ``eps`` apart."""
    centre = F.transform("cell", lambda i: (i + 0.5) * F.lit(side))
    cells = core.groupBy("cell_id").agg(F.first("cell").alias("cell"), F.count("*").alias("n"))
    cells = cells.select("cell_id", "n", centre.alias("centre"))
    pairs = (near.where("a < b")
             .join(cells.withColumnsRenamed({"cell_id": "a", "n": "n_a", "centre": "centre_a"}), "a")
             .join(cells.withColumnsRenamed({"cell_id": "b", "n": "n_b", "centre": "centre_b"}), "b"))
    pairs = cut_lineage(pairs)

    def closest(mine: str, other: str) -> DataFrame:
        """The place of cell ``mine`` that lies nearest to the other cell's centre."""
        members = core.select(F.col("cell_id").alias(mine), "point")
        return (pairs.select("a", "b", F.col(f"centre_{other}").alias("to")).join(members, mine)
                .groupBy("a", "b").agg(F.min_by("point", distance(F.col("point"), F.col("to")))
                                       .alias(f"point_{mine}")))

    # most pairs of crowded cells are settled by their two facing places
    facing = (closest("a", "b").join(closest("b", "a"), ["a", "b"])
              .where(distance(F.col("point_a"), F.col("point_b")) <= eps).select("a", "b"))
    facing = cut_lineage(facing)
    open_pairs = pairs.join(facing, ["a", "b"], "left_anti").select("a", "b", "n_a", "n_b")

    def chunks(n: str):
        return F.ceil(F.col(n) / F.lit(float(CELL_CHUNK))).cast("int")

    open_pairs = (open_pairs
                  .withColumn("chunk_a", F.explode(F.sequence(F.lit(0), chunks("n_a") - 1)))
                  .withColumn("chunk_b", F.explode(F.sequence(F.lit(0), chunks("n_b") - 1)))
                  .select("a", "b", "chunk_a", "chunk_b", "n_a", "n_b"))
    open_pairs = cut_lineage(open_pairs)
    sizes = cells.select("cell_id", F.ceil(F.col("n") / F.lit(float(CELL_CHUNK))).cast("int").alias("chunks"))
    dealt = _salted(core.select("cell_id", "place", "point"), sizes)
    # pairs meet in bundles, since most are small and a group each would cost more than its distances
    load = open_pairs.agg(F.sum(F.least(F.col("n_a"), F.lit(CELL_CHUNK)) + F.least(F.col("n_b"), F.lit(CELL_CHUNK)))).first()[0]
    bundles = max(1, math.ceil((load or 0) / BUNDLE_ROWS))
    open_pairs = open_pairs.drop("n_a", "n_b").withColumn(
        "bundle", F.pmod(F.xxhash64("a", "b", "chunk_a", "chunk_b"), F.lit(bundles)))
    sides = []
    for mine in ("a", "b"):
        members = dealt.select(F.col("cell_id").alias(mine), F.col("chunk").alias(f"chunk_{mine}"), "point")
        joined = open_pairs.join(members, [mine, f"chunk_{mine}"])
        # fresh names throughout: both sides stem from the same tables
        sides.append(joined.select(*[F.col(c).alias(f"{c}_of_{mine}") for c in joined.columns]))
    group = ["a", "b", "chunk_a", "chunk_b"]
    key = dict(pairs.dtypes)["a"]

    def any_close(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["a", "b"])
        p, q = np.stack(left["point_of_a"]), np.stack(right["point_of_b"])
        theirs = right.groupby([f"{g}_of_b" for g in group], sort=False).indices
        out = []
        for pair, mine in left.groupby([f"{g}_of_a" for g in group], sort=False).indices.items():
            other = q[theirs[pair]]
            if any((pairwise(p[mine[i:i + 512]], other) <= eps).any() for i in range(0, len(mine), 512)):
                out.append(pair[:2])
        return pd.DataFrame(out, columns=["a", "b"])

    rest = (sides[0].groupBy("bundle_of_a").cogroup(sides[1].groupBy("bundle_of_b"))
            .applyInPandas(any_close, f"a {key}, b {key}"))
    return facing.unionByName(rest).distinct()


def _by_pivots(keys: DataFrame, places: DataFrame, key: str, radius: float, needed: int, metric: str,
               block_rows: int) -> DataFrame:
    """(key, cluster, is_core) in any metric; ``radius`` is the distance of points within reach."""
    blocks = Blocks(places, metric, block_rows)
    kind = dict(places.dtypes)["place"]
    reach = with_slack(F.lit(radius))
    pairs = blocks.pairs(reach)

    def close(a: Part, b: Part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of both parts within the radius."""
        if a.rows and b.rows:
            for u, rows in a.blocks():
                for others in a.tiles(u, b, radius):
                    i, j = np.nonzero(within(a.points[rows], b.points[others], radius, metric))
                    yield rows[i], others[j]

    def count(one: pa.Table, other: pa.Table | None) -> pa.Table:
        """How many rows each place has in reach in the other group."""
        a = Part(one)
        b = a if other is None else Part(other)
        n_a, n_b = np.zeros(a.rows), np.zeros(b.rows)
        of_a, of_b = a.column("copies"), b.column("copies")
        for i, j in close(a, b):
            n_a += np.bincount(i, of_b[j], minlength=a.rows)
            if b is not a:
                n_b += np.bincount(j, of_a[i], minlength=b.rows)
        out = [(p, np.flatnonzero(n), n) for p, n in ((a, n_a), (b, n_b))]
        return pa.concat_tables([pa.table({"place": p.named(rows), "n": pa.array(n[rows].astype(np.int64), pa.int64())})
                                 for p, rows, n in out])

    def link(one: pa.Table, other: pa.Table | None) -> pa.Table:
        """One row (a, b) for each place of a local cluster but one, b that one."""
        a = Part(one)
        b = a if other is None else Part(other)
        label = np.arange(a.rows + (b.rows if b is not a else 0))
        for i, j in close(a, b):
            _join(label, i, j if b is a else j + a.rows)
        names = pa.concat_tables([pa.table({"place": p.named(np.arange(p.rows))}) for p in ([a] if b is a else [a, b])])["place"]
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": names.take(pa.array(linked)), "b": names.take(pa.array(label[linked]))})

    members = blocks.members("copies")
    core = cut_lineage(meet_groups(members, members, pairs, count, f"place {kind}, n long").groupBy("place")
                       .agg(F.sum("n").alias("n")).where(F.col("n") >= needed).select("place"))
    core_members = cut_lineage(blocks.members().join(core, "place", "left_semi"))
    joined = connected_components(meet_groups(core_members, core_members, pairs, link, f"a {kind}, b {kind}"))
    labelled = (core.join(joined.withColumnRenamed("node", "place"), "place", "left")
                .select("place", F.coalesce("component", "place").alias("component")))
    # a component is named by its smallest core place
    labelled = cut_lineage(_numbered(labelled.withColumn("first_key", F.col("component"))))

    def first(one: pa.Table, other: pa.Table) -> pa.Table:
        """The first cluster with a core row in reach of each place."""
        a, b = Part(one), Part(other)
        best, clusters = np.full(a.rows, np.iinfo(np.int64).max), b.column("cluster")
        for i, j in close(a, b):
            np.minimum.at(best, i, clusters[j])
        rows = np.flatnonzero(best < np.iinfo(np.int64).max)
        return pa.table({"place": a.named(rows), "cluster": pa.array(best[rows], pa.int64())})

    loose = blocks.members().join(core, "place", "left_anti")
    border = (meet_groups(loose, core_members.join(labelled, "place"), blocks.pairs(reach, mutual=False), first,
                          f"place {kind}, cluster long", itself=True)
              .groupBy("place").agg(F.min("cluster").alias("cluster")))
    return _labels(keys, key, labelled, border)


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the components of the pairs (i, j) one label, the smallest; a label is the number of a row that has it."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _numbered(labelled: DataFrame) -> DataFrame:
    """(place, cluster): components numbered by their smallest core key, over range partitions."""
    first = labelled.groupBy("component").agg(F.min("first_key").alias("first_key"))
    numbered = OrderIndex(first, "first_key").numbered("cluster")
    return labelled.drop("first_key").join(numbered.select("component", "cluster"), "component").drop("component")


def _labels(keys: DataFrame, key: str, labelled: DataFrame, border: DataFrame) -> DataFrame:
    labels = (labelled.select("place", "cluster", F.lit(True).alias("is_core"))
              .unionByName(border.select("place", "cluster", F.lit(False).alias("is_core"))))
    return cut_lineage(keys.join(labels, "place", "left").select(
        col(key), F.coalesce("cluster", F.lit(NOISE)).cast("int").alias("cluster"),
        F.coalesce("is_core", F.lit(False)).alias("is_core")))


def dbscan(df: DataFrame, features: list[str], key: str, eps: float = 0.5, min_samples: int = 5,
           block_rows: int = BLOCK_ROWS, metric: str = "euclidean") -> DataFrame:
    """(key, cluster, is_core); cluster -1 is noise.

    ``min_samples`` counts the row itself. Clusters are numbered by their smallest core
    key; a border row within reach of several clusters joins the first of them. ``metric``
    is euclidean, manhattan, chebyshev or cosine.
    """
    metric = metric_name(metric)
    width = len(features)
    rows = df.count()
    needed = max(2, rows) if rows < min_samples else min_samples
    keys, places = collapse(df, features, key, metric)
    if metric != "euclidean" or width > GRID_WIDTH:
        return _by_pivots(keys, places, key, radius_of(eps, metric), needed, metric, block_rows)
    located, side = _cells(places, eps, width)
    cells = cut_lineage(located.groupBy("cell").agg(
        F.min("place").alias("cell_id"), F.sum("copies").alias("rows"), F.count("*").alias("n")))
    located = cut_lineage(located.join(cells, "cell"))
    near = cut_lineage(_near_cells(cells.select("cell_id", "cell"), eps, side, width, block_rows))

    # rows of sparse cells: count what lies in reach in the cells around
    sparse = located.where(F.col("rows") < needed).select("place", "point", "cell_id", "rows")
    sizes = cells.select("cell_id", F.ceil(F.col("n") / F.lit(float(CELL_CHUNK))).cast("int").alias("chunks"))
    dealt = _salted(located.select("cell_id", "place", "point", "copies"), sizes)
    around = (sparse.join(near.withColumnRenamed("a", "cell_id"), "cell_id")
              .join(sizes.withColumnRenamed("cell_id", "b"), "b")
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .select(F.col("place").alias("seeker"), F.col("point").alias("at"), F.col("b").alias("cell_id"), "chunk"))
    in_reach = distance(F.col("at"), F.col("point")) <= eps
    others = (around.join(dealt, ["cell_id", "chunk"]).where(in_reach)
              .groupBy("seeker").agg(F.sum("copies").alias("others")))
    core_sparse = (sparse.join(others, sparse["place"] == others["seeker"], "left")
                   .where(F.col("rows") + F.coalesce("others", F.lit(0)) >= needed).select("place"))
    core = cut_lineage(
        located.where(F.col("rows") >= needed).select("place", "point", "cell_id", "cell")
        .unionByName(located.join(core_sparse, "place", "left_semi").select("place", "point", "cell_id", "cell")))

    # clusters: components of linked core cells
    core_cells = core.select("cell_id").distinct()
    near_core = (near.join(core_cells.withColumnRenamed("cell_id", "a"), "a", "left_semi")
                 .join(core_cells.withColumnRenamed("cell_id", "b"), "b", "left_semi"))
    joined = connected_components(_linked_cells(core, near_core, eps, side))
    cell_cluster = (core_cells.join(joined.withColumnRenamed("node", "cell_id"), "cell_id", "left")
                    .select("cell_id", F.coalesce("component", "cell_id").alias("component")))
    labelled = core.join(cell_cluster, "cell_id")
    labelled = cut_lineage(_numbered(labelled.select("place", "point", "cell_id", "component",
                                                     F.col("place").alias("first_key"))))

    # border: other rows of sparse cells next to a core row
    loose = sparse.join(core.select("place"), "place", "left_anti")
    own = loose.select("place", "point", "cell_id", F.col("cell_id").alias("b"))
    beside = loose.join(near.withColumnRenamed("a", "cell_id"), "cell_id").select("place", "point", "cell_id", "b")
    core_dealt = _salted(labelled, sizes)
    reachable = (own.unionByName(beside).join(sizes.withColumnRenamed("cell_id", "b"), "b")
                 .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
                 .select(F.col("place").alias("seeker"), F.col("point").alias("at"),
                         F.col("b").alias("cell_id"), "chunk"))
    border = (reachable.join(core_dealt, ["cell_id", "chunk"]).where(in_reach)
              .groupBy(F.col("seeker").alias("place")).agg(F.min("cluster").alias("cluster")))
    return _labels(keys, key, labelled, border)


def noise_summary(labels: DataFrame) -> DataFrame:
    """One row: rows, clusters, noise rows and their share."""
    noise = F.count_if(F.col("cluster") == NOISE)
    return labels.agg(F.count("*").alias("rows"),
                      F.count_distinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("n_clusters"),
                      noise.alias("noise_count"),
                      F.try_divide(noise * 100.0, F.count("*")).alias("noise_percentage"))
