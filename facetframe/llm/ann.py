"""Approximate nearest neighbours by inner product, with shifted Hilbert curves.

Vectors are lifted to one norm by an extra coordinate, which turns the largest inner product into the smallest
distance, then rotated at random and cut into groups of a few coordinates. Each group, shifted by a random
offset, orders all vectors along a Hilbert curve. The orders are range-partitioned and cut into blocks; a query
visits the blocks around its own place on every curve, and what it meets is ranked by its exact score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage
from .common import running

DIMS, BITS = 8, 5
#: Distinct vectors in a block, the unit a task holds.
BLOCK = 1024
#: Rows the scales of the coordinates are taken from: those with the smallest hashes of their ids.
FITTED = 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (n, dims) on the Hilbert curve (Skilling, 2004)."""
    x = np.ascontiguousarray(cells.T.astype(np.int64))
    dims, top = len(x), 1 << (bits - 1)
    for q in (top >> i for i in range(bits - 1)):
        for i in range(dims):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(x[i] & q, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (top >> i for i in range(bits - 1)):
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> b & 1
    return key


@dataclass
class Curves:
    """The fitted parts of the index: rotations, centre and scale of each coordinate, shifts."""

    axes: np.ndarray          # (curves, dims + 1, DIMS)
    centre: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    norm: float

    @staticmethod
    def fit(sample: np.ndarray, norm: float, curves: int, seed: int) -> Curves:
        rng = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        wide = max(d, DIMS)
        axes: list[np.ndarray] = []
        while len(axes) < curves:
            turned = np.linalg.qr(rng.standard_normal((wide, wide)))[0][:d]
            axes += [turned[:, i:i + DIMS] for i in range(0, wide - DIMS + 1, DIMS)]
        out = Curves(np.stack(axes[:curves]), np.zeros((curves, DIMS)), np.ones((curves, DIMS)),
                     rng.random((curves, DIMS)), norm)
        y = np.einsum("nd,cdk->cnk", out.lifted(sample), out.axes)
        out.centre, out.scale = y.mean(axis=1), np.maximum(y.std(axis=1), 1e-9)
        return out

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return np.c_[v, np.sqrt(np.maximum(self.norm ** 2 - (v * v).sum(axis=1), 0))]

    def sought(self, v: np.ndarray) -> np.ndarray:
        return np.c_[v * (self.norm / np.sqrt((v * v).sum(axis=1)))[:, None], np.zeros(len(v))]

    def keys(self, points: np.ndarray, curve: int) -> np.ndarray:
        y = (points @ self.axes[curve] - self.centre[curve]) / self.scale[curve]
        even = (1 + np.tanh(0.8 * y)) / 2                       # about uniform for a bell-shaped coordinate
        cells = ((even + self.shift[curve]) / 2 * (1 << BITS)).astype(np.int64)
        return hilbert(np.minimum(cells, (1 << BITS) - 1), BITS)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors of doubles that are not null or zero and hold no null, NaN or infinity.

    Rows without an id cannot be named and take no part; of vectors of several lengths, those of the most
    frequent one (the longest, if equal) do.
    """
    v = col(vector).cast("array<double>")
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (usual.n if usual else 0))


def _block_scores(keep: int):
    def run(key: tuple, data: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if data.num_rows and asked.num_rows:
            ids, v = data["vid"].to_numpy(), _matrix(data["v"])
            names, q = asked["query"].to_numpy(), _matrix(asked["v"])
            k = min(keep, len(ids))
            for at in range(0, len(q), 1024):
                rough = q[at:at + 1024] @ v.T
                best = np.argpartition(-rough, k - 1, axis=1)[:, :k]
                who, hit = np.repeat(np.arange(at, at + len(rough)), k), best.ravel()
                out[0].append(names[who])
                out[1].append(ids[hit])
                out[2].append((q[who] * v[hit]).sum(axis=1))       # the same sum wherever a pair meets
        parts = [np.concatenate(o) if o else np.empty(0) for o in out]
        return pa.table({"query": pa.array(parts[0].astype(np.int64)), "vid": pa.array(parts[1].astype(np.int64)),
                         "score": pa.array(parts[2].astype(np.float64))})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
            curves: int = 16, share: float = 0.08, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (over vec_id) selects, its k nearest others.

    Each curve's window holds ``share`` of all vectors and 2 blocks at least, so small tables are searched whole.
    Equal vectors are one point with its k + 1 smallest ids; more can never be asked for, and no group of copies
    grows beyond that. Ties go to the smaller id; rows that repeat both id and vector count once.
    """
    rows = cut_lineage(usable(vectors, id_col, vector))
    first = Window.partitionBy("v").orderBy("vec_id")
    named = rows.distinct().withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1)
    points = cut_lineage(named.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
                         .select(F.get("ids", F.lit(0)).alias("vid"), "ids", "v"))
    asking = cut_lineage(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct()
                         .join(points.select("vid", "v"), "v").select("query_id", "vid"))
    found = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("sq")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not found.n:
        return vectors.sparkSession.createDataFrame([], schema)
    sample = points.orderBy(F.xxhash64("vid"), "vid").limit(FITTED).select("v").toArrow()
    index = vectors.sparkSession.sparkContext.broadcast(
        Curves.fit(_matrix(sample["v"]), float(np.sqrt(found.sq)), curves, seed))

    def keys(sought: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column(1))
                at = index.value.sought(v) if sought else index.value.lifted(v)
                for c in range(curves if len(v) else 0):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(index.value.keys(at, c)), batch.column(0)],
                                                     names=["curve", "key", "vid"])
        return run

    questions = points.join(asking.select("vid").distinct(), "vid")
    key_type = "curve int, key long, vid long"
    placed = points.select("vid", "v").mapInArrow(keys(False), key_type).withColumn("data", F.lit(1).cast("long")).unionByName(
        questions.select("vid", "v").mapInArrow(keys(True), key_type).withColumn("data", F.lit(0).cast("long")))
    order = cut_lineage(running(cut_lineage(placed), ["curve"], ["key", "data", "vid"], {"at": "data"}))
    block = F.floor(F.col("at") / BLOCK).cast("int")
    last, reach = (found.n - 1) // BLOCK, max(1, -(-int(found.n * share / 2) // BLOCK))
    data = order.where("data = 1").select("curve", block.alias("block"), "vid").join(points.select("vid", "v"), "vid")
    data = data.select(*[F.col(c).alias(c) for c in data.columns])
    visits = order.where("data = 0").select("curve", F.explode(F.sequence(
        F.greatest(block - reach, F.lit(0)), F.least(block + reach, F.lit(last)))).alias("block"), "vid").join(
        questions.select("vid", "v"), "vid")
    visits = visits.select(*[F.col(c).alias("query" if c == "vid" else c) for c in visits.columns])
    met = data.groupBy("curve", "block").cogroup(visits.groupBy("curve", "block")).applyInArrow(
        _block_scores(k + 1), "query long, vid long, score double")
    once = met.groupBy("query", "vid").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vid")
    top = once.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k + 1)
    listed = top.join(points.select("vid", "ids"), "vid").select("query", "score", F.explode("ids").alias("vec_id"))
    ordered = listed.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("far"), "vec_id", "score"))), 1, k + 1).alias("hits"))
    answers = asking.join(ordered, asking.vid == ordered.query).select(
        "query_id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k).alias("hits"))
    return answers.select("query_id", F.posexplode("hits").alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
