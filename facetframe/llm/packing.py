"""Packing of documents into training sequences by cutting-stock column generation.

A document's ids are cut at every full sequence; what is left of it is an item, shorter than a sequence. Lengths are
rounded up to classes, GRID to a sequence, so the histogram of items is a table of at most GRID rows at any corpus size.
Over it the cutting-stock problem is solved as Gilmore and Gomory did: a linear program over patterns (how many items
of each class fill a sequence), whose columns are priced by knapsack dynamic programming with the dual values of the
classes. The patterns' figures are rounded down; the few items left are filled up one sequence at a time by the same
kind of dynamic programming. The patterns are then laid over the items of each class in the order of their rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage
from .common import written
from .tokens import encode_texts

#: Length classes to a sequence. An item's class is at most 1/GRID of a sequence above its length.
GRID = 128
#: The linear program ends after so many columns at the latest; this decides about padding only.
MOST_COLUMNS = 20_000


def _priced(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The pattern of the largest value, by knapsack dynamic programming."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    for w in range(1, capacity + 1):
        k = int(np.searchsorted(sizes, w, side="right"))
        best[w] = best[w - 1]
        if k:
            at = best[w - sizes[:k]] + values[:k]
            i = int(np.argmax(at))
            if at[i] > best[w]:
                best[w], last[w] = at[i], i
    pattern, w = np.zeros(len(sizes), dtype=np.int64), capacity
    while w:
        if last[w] < 0:
            w -= 1
        else:
            pattern[last[w]] += 1
            w -= int(sizes[last[w]])
    return pattern


def _relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and how often each is used in the best linear solution, by the revised simplex method."""
    m, times = len(sizes), capacity // sizes
    patterns = [np.where(np.arange(m) == i, times, 0) for i in range(m)]
    inverse, used = np.diag(1.0 / times), demand / times
    for _ in range(MOST_COLUMNS):
        values = inverse.sum(axis=0)
        pattern = _priced(values, sizes, capacity)
        if values @ pattern <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1.0), np.inf)
        leaves = int(np.argmin(ratio))
        used = used - ratio[leaves] * step
        used[leaves] = ratio[leaves]
        used = np.maximum(used, 0.0)
        row = inverse[leaves] / step[leaves]
        inverse = inverse - np.outer(step, row)
        inverse[leaves] = row
        patterns[leaves] = pattern
    return patterns, used


def _filled(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Sequences for the items that rounding leaves, each filled up as far as they can, long ones first.

    There are fewer than two items of a class for every pattern, whatever the size of the corpus.
    """
    left, out = left.copy(), []
    while left.any():
        pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
        first = int(np.flatnonzero(left)[-1])
        pattern[first], room = 1, capacity - int(sizes[first])
        left[first] -= 1
        # which totals can be reached with the items left, each class in its turn; the last class that made it
        reach = np.full(room + 1, -1, dtype=np.int64)
        taken = np.zeros(room + 1, dtype=np.int64)
        reach[0] = len(sizes)
        for i in range(len(sizes) - 1, -1, -1):
            size, n = int(sizes[i]), int(left[i])
            if not n or size > room or reach[room] >= 0:
                continue
            taken[:] = 0
            for w in range(size, room + 1):
                if reach[w] < 0 <= reach[w - size] and taken[w - size] < n:
                    reach[w], taken[w] = i, taken[w - size] + 1
        w = int(np.flatnonzero(reach >= 0)[-1])
        while w:
            i = int(reach[w])
            pattern[i] += 1
            left[i] -= 1
            w -= int(sizes[i])
        out.append(pattern)
    return out


def cut_patterns(histogram: dict[int, int], capacity: int = GRID) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """Classes, and (pattern, sequences) that use up exactly the items of ``histogram`` (class: number)."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(x)] for x in sizes], dtype=np.int64)
    if not len(sizes):
        return sizes, []
    patterns, used = _relaxed(sizes, left.astype(float), capacity)
    out = []
    for pattern, x in sorted(zip(patterns, used), key=lambda p: -p[1]):
        whole = min([int(x + 1e-6), *(int(left[i]) // int(pattern[i]) for i in np.flatnonzero(pattern))])
        if whole > 0:
            out.append((pattern, whole))
            left = left - whole * pattern
    return sizes, out + [(p, 1) for p in _filled(sizes, left, capacity)]


def _slots(sizes: np.ndarray, patterns: list[tuple[np.ndarray, int]]) -> dict[int, np.ndarray]:
    """Per class the rows (first rank, first sequence, items in a sequence), in the order of the ranks."""
    slots: dict[int, list[tuple[int, int, int]]] = {int(x): [] for x in sizes}
    ranks, sequence = dict.fromkeys(slots, 0), 0
    for pattern, times in patterns:
        for i in np.flatnonzero(pattern):
            size, n = int(sizes[i]), int(pattern[i])
            slots[size].append((ranks[size], sequence, n))
            ranks[size] += n * times
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in slots.items()}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text: str) -> DataFrame:
    """(part, place, doc_id, start, length, doc_tokens, ids) of every document, cut at full sequences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = batch.slice(at, 128)
                coded = [np.append(c, np.uint32(end_id)) for c in encode_texts([t or "" for t in rows.column(1).to_pylist()], tokenizer)]
                totals = np.array([len(c) for c in coded])
                pieces = -(-totals // capacity)
                starts = capacity * np.concatenate([np.arange(p) for p in pieces])
                of = np.repeat(np.arange(len(coded)), pieces)
                sizes = np.minimum(capacity, totals[of] - starts)
                ids = [coded[d][s:s + n].astype("<u4").tobytes() for d, s, n in zip(of.tolist(), starts.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(of), part, np.int32)), pa.array(place + np.arange(len(of))), rows.column(0).take(pa.array(of)),
                     pa.array(starts), pa.array(sizes), pa.array(totals[of]), pa.array(ids, pa.binary())],
                    names=["part", "place", "doc_id", "start", "length", "doc_tokens", "ids"])
                place += len(of)

    slim = docs.select(col(id_col).cast("long").alias("doc_id"), col(text).alias("text"))
    return slim.mapInArrow(run, "part int, place long, doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id",
         text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pieces, places): the written pieces with their ids, and where each stands.

    ``pieces`` has part, place, doc_id, start, length, doc_tokens and ids (little-endian unsigned 32-bit integers);
    ``places`` has part, place, sequence_id and offset. Every document ends with ``end_id``. A row is a document,
    repeated rows and rows of null id included; null text is an empty text. Sequences are numbered from 0 without
    gaps. An empty table gives empty results. Only the histogram of classes, at most GRID rows, is collected.
    Ranks come from totals per part and class, so no task holds all items of a class.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, id_col, text), "pieces")
    grid = min(GRID, capacity)
    slim = pieces.select("part", "place", "length", F.ceil(F.col("length") * F.lit(grid) / F.lit(capacity)).cast("int").alias("class"))
    counts = cut_lineage(slim.groupBy("part", "class").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["class"]: r.n for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(*cut_patterns(histogram, grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rank = (batch.column(i).to_numpy() for i in (3, 4))
            sequence = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                at, table = np.flatnonzero(sizes == size), slots[size]
                slot = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
                sequence[at] = slot[:, 1] + (rank[at] - slot[:, 0]) // slot[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sequence)], names=["part", "place", "length", "sequence_id"])

    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col("part").alias("__part"), F.col("class").alias("__class"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("part", "class").orderBy("place")) - 1
    ranked = slim.withColumn("__in", inside).join(firsts, (F.col("part") == F.col("__part")) & (F.col("class") == F.col("__class")))
    placed = ranked.select("part", "place", "length", "class", (F.col("__first") + F.col("__in")).cast("long").alias("rank")).mapInArrow(
        run, "part int, place long, length long, sequence_id long")
    ahead = Window.partitionBy("sequence_id").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)   # one sequence
    return pieces, placed.select("part", "place", "sequence_id",
                                 F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"))


def sequences(pieces: DataFrame, places: DataFrame, capacity: int = 1024) -> DataFrame:
    """(sequence_id, ids, padded): the packed sequences themselves, and the length that each is to be padded to.

    A sequence whose length is a power of two stays as it is, any other is padded to ``capacity``.
    """
    both = pieces.select("part", "place", "ids").join(places, ["part", "place"])
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))          # at most a sequence long
    joined = both.groupBy("sequence_id").agg(ordered.alias("held")).select("sequence_id", F.aggregate(
        "held", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    size = (F.octet_length("ids") / 4).cast("int")
    return joined.withColumn("padded", F.when(F.bit_count(size) == 1, size).otherwise(F.lit(capacity)))


def packed_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; checksums are of the written ids."""
    pieces, places = pack(docs, tokenizer, capacity, end_id, id_col, text)
    slim = pieces.select("part", "place", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return slim.join(places, ["part", "place"]).drop("part", "place")
