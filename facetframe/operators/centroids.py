"""Several k-means runs at once over one kept table of row blocks.

The runs start from the centres that Spark's k-means|| draws and move by Lloyd's rule, all of them in the same scan: a
step is one job however many runs there are, and only the sums of each run's clusters leave a task. Rows are dealt to all
cores and held once, as matrices of bounded size; a run that has settled takes no part in further steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.ranks import TASK_BYTES
from ..session import ship_package
from .features import assemble

#: A run has settled when no centre moves further than this.
TOLERANCE = 1e-4
BLOCK_BYTES = 1 << 20
PARALLEL_RUNS = 8


@dataclass
class Run:
    """Centres, and the figures of the rows that are nearest to each."""
    centres: np.ndarray
    sizes: np.ndarray | None = None
    inertia: float = 0.0


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, less the square of the row: enough to compare."""
    return np.einsum("ij,ij->i", centres, centres) - 2.0 * (x @ centres.T)


class Points:
    """The rows as matrices, shifted so that their places are near zero."""

    def __init__(self, vectors: DataFrame, width: int, rows: int):
        self.vectors, self.width, self.rows = vectors, width, rows
        self.blocks: DataFrame | None = None
        self.shift = np.zeros(width)

    def starts(self, wanted: list[tuple[int, int]]) -> list[np.ndarray]:
        """Centres by k-means|| for each (k, seed)."""
        def start(one: tuple[int, int]) -> np.ndarray:
            model = KMeans(k=one[0], seed=one[1], maxIter=0).fit(self.vectors)
            return np.array([list(c) for c in model.clusterCenters()])

        # independent draws from the same cached vectors share the cluster
        with ThreadPoolExecutor(min(len(wanted), PARALLEL_RUNS)) as pool:
            return list(pool.map(start, wanted))

    def _cut(self) -> None:
        width, shift, size = self.width, self.shift, max(1, BLOCK_BYTES // (8 * self.width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - shift
                for at in range(0, len(x), size):
                    yield pa.RecordBatch.from_arrays([pa.array([x[at:at + size].tobytes()], pa.binary())], names=["block"])

        self.blocks = self.vectors.select(vector_to_array("features").alias("point")).mapInArrow(run, "block binary").persist(
            StorageLevel.MEMORY_AND_DISK)
        self.blocks.count()
        self.vectors.unpersist()

    def scan(self, measure, shape: tuple[int, ...]) -> np.ndarray:
        """The sum of ``measure(matrix)`` over all blocks; one array of ``shape`` leaves a task."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for block in batch.column(0):
                    total += measure(np.frombuffer(block.as_buffer(), np.float64).reshape(-1, width))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        out = np.zeros(shape)
        for r in self.blocks.mapInArrow(run, "total binary").collect():      # in the order of the partitions
            out += np.frombuffer(r.total, np.float64).reshape(shape)
        return out

    def _sums(self, runs: list[np.ndarray], costs: bool = False) -> list[np.ndarray]:
        """Per run and cluster: rows, their distances squared (if asked for), the sum of their squares, their sum."""
        ends, width = np.cumsum([len(r) for r in runs]).tolist(), self.width
        stacked = np.vstack(runs)

        def measure(x: np.ndarray) -> np.ndarray:
            total, squares = np.zeros((len(stacked), 3 + width)), _squares(x, stacked)
            rows = np.arange(len(x))
            own = np.einsum("ij,ij->i", x, x) if costs else None
            for a, b in zip([0, *ends], ends):
                label = squares[:, a:b].argmin(axis=1)
                total[a:b, 0] = np.bincount(label, minlength=b - a)
                if costs:
                    e = x - stacked[a + label]
                    total[a:b, 1] = np.bincount(label, np.einsum("ij,ij->i", e, e), b - a)
                    total[a:b, 2] = np.bincount(label, own, b - a)
                member = np.zeros((b - a, len(x)))
                member[label, rows] = 1.0
                total[a:b, 3:] = member @ x
            return total

        found = self.scan(measure, (len(stacked), 3 + width))
        return [found[a:b] for a, b in zip([0, *ends], ends)]

    def fit(self, wanted: list[tuple[int, int]], max_iter: int) -> list[Run]:
        """One settled run for each (k, seed); a cluster that loses all its rows keeps its centre."""
        starts = self.starts(wanted)
        self.shift = np.mean([s.mean(axis=0) for s in starts], axis=0)
        self._cut()
        centres = [s - self.shift for s in starts]
        moving = list(range(len(centres)))
        for _ in range(max_iter):
            if not moving:
                break
            still = []
            for i, found in zip(moving, self._sums([centres[i] for i in moving])):
                sizes = found[:, :1]
                new = np.where(sizes > 0, found[:, 3:] / np.maximum(sizes, 1.0), centres[i])
                if (np.square(new - centres[i]).sum(axis=1) > TOLERANCE * TOLERANCE).any():
                    still.append(i)
                centres[i] = new
            moving = still
        return [Run(c + self.shift, f[:, 0], float(f[:, 1].sum())) for c, f in zip(centres, self._sums(centres, costs=True))]

    def silhouettes(self, runs: list[Run]) -> list[float | None]:
        """Mean silhouette of squared Euclidean distances of each run; None unless 2 <= clusters < rows."""
        width = self.width
        every = [r.centres - self.shift for r in runs]
        found = self._sums(every, costs=True)
        places = [np.flatnonzero(f[:, 0] > 0) for f in found]

        def measure(x: np.ndarray) -> np.ndarray:
            total, own = np.zeros(len(every)), np.einsum("ij,ij->i", x, x)
            rows = np.arange(len(x))
            for i, (centres, f, kept) in enumerate(zip(every, found, places)):
                if len(kept) < 2:
                    continue
                # a centre without rows is nearest to none
                label = _squares(x, centres[kept]).argmin(axis=1)
                sizes, squares, sums = f[kept, 0], f[kept, 2], f[kept, 3:]
                mean = np.maximum(own[:, None] + squares / sizes - 2.0 * (x @ (sums / sizes[:, None]).T), 0.0)
                a = mean[rows, label] * sizes[label] / np.maximum(sizes[label] - 1.0, 1.0)
                mean[rows, label] = np.inf
                b = mean.min(axis=1)
                high = np.maximum(a, b)
                total[i] += np.where((sizes[label] > 1) & (high > 0), (b - a) / np.where(high > 0, high, 1.0), 0.0).sum()
            return total

        totals = self.scan(measure, (len(every),))
        return [float(t) / self.rows if 2 <= len(p) < self.rows else None for t, p in zip(totals, places)]


@contextmanager
def points_of(df: DataFrame, features: list[str]) -> Iterator[Points]:
    """The rows dealt to all cores and kept for many scans, whatever their size and their reader's splits."""
    ship_package(df.sparkSession)
    slim = df.select(*[col(f) for f in features])
    rows = slim.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, 8 * rows * len(features) // TASK_BYTES)
    vectors = assemble(slim, features).select("features").repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    points = Points(vectors, len(features), rows)
    try:
        yield points
    finally:
        vectors.unpersist()
        if points.blocks is not None:
            points.blocks.unpersist()


def nearest_centre(df: DataFrame, features: list[str], centres: np.ndarray, shift: np.ndarray, column: str) -> DataFrame:
    """Add the number of the nearest centre, the first of equally near ones."""
    width, moved = len(features), centres - shift

    @F.arrow_udf("int")
    def nearest(points: pa.Array) -> pa.Array:
        x = points.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - shift
        squares = np.einsum("ij,ij->i", moved, moved) - 2.0 * (x @ moved.T)
        return pa.array(squares.argmin(axis=1), pa.int32())

    return df.withColumn(column, nearest(F.array(*[col(f).cast("double") for f in features])))
