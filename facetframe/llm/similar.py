"""Near-duplicates by the exact Jaccard similarity of shingle sets, with a prefix-filtered inverted index.

Two sets with a Jaccard similarity of 4/5 or more share a shingle among the first n - ceil(4n/5) + 1 of each, in
whatever order all shingles are put. The order here has common shingles last, so postings are short where texts
are not alike. The list of common ones comes from a sample; it decides about speed only, never about results.

In short postings all pairs are tallied: what two prefixes have in common bounds what the sets can have, so most pairs
go by their count. In a long posting each text meets the leader of its length class. Texts of a long posting that are
not connected after that meet the others of it in blocks of bounded size. Each set has a parity map, which is much
smaller: the bits in which two maps differ are at most as many as the shingles in which the sets do, so pairs of
unlike sets go without a look at the sets, and none of like ones. What is left is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..session import cut_lineage
from .common import emit, row_hash, small, written
from .components import components

SHINGLE = 5
SEED = 42
#: All pairs of a posting with up to so many texts are candidates.
FEW = 32
#: One in so many different sets is sampled; a shingle that is expected in COMMON sets is a common one.
SAMPLED = 8
COMMON = 32
MOST_COMMON = 50_000
#: Texts of a long posting that meet in one go: so many that are not connected, and so many others.
BLOCK = 2_000
#: A parity map has at most so many words of 64 bits; in longer texts it excludes less.
WIDEST = 1_024


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the different five-word shingles; a shorter text is one, one without words none."""
    words = (text or b"").lower().split()        # both in ASCII terms
    if not words:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - SHINGLE + 1
    shingles = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)])) if n > 0 else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=max(n, 1)))


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 of a set: by hash, and after those the ``common`` ones (sorted) by ``rank``."""
    k = len(hashes) + -4 * len(hashes) // 5 + 1 if len(hashes) else 0
    if not len(common):
        return hashes[:k]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    hit = common[at] == hashes
    rare = hashes[~hit][:k]
    places = at[hit]
    return np.r_[rare, common[places[np.argsort(rank[places])]][:k - len(rare)]]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of batches whose last column is the text, and the sets of their texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            yield part, [shingle_set(t.as_py()) for t in part.column(part.num_columns - 1)]


def parity_map(hashes: np.ndarray) -> bytes:
    """A bit for each value of the low bits of a hash: whether an odd number of the set's hashes has it; about 4 bits a hash."""
    words = min(WIDEST, 1 << max(0, (len(hashes) - 1) // 16).bit_length())
    at = (hashes & np.uint64(64 * words - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * words).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Parity maps (one a row) made over to fewer words."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _matrix(maps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(maps), dtype="<u8").reshape(len(maps), -1)


def _close(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and maps may have a similarity of 4/5: they differ in a ninth of na + nb at most."""
    words = min(a.shape[1], b.shape[1])
    return 9 * np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum(axis=1, dtype=np.int64) <= na.astype(np.int64) + nb


def set_prints(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(__id, __hash, key, n, map, sample): digest, size and parity map of each row's set; ``sample`` is a sampled set itself."""
    slim = docs.select(col(id_col).alias("__id"), row_hash(docs).alias("__hash"), col(text).cast("binary").alias("__text"))
    sampled = SAMPLED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sliced(batches):
            keys = np.array([_key(s) for s in sets], dtype=np.uint64)
            sample = _lists([s if k % sampled == 0 else s[:0] for s, k in zip(sets, keys.tolist())])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array(keys.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([parity_map(s) for s in sets], pa.binary()), sample],
                names=["__id", "__hash", "key", "n", "map", "sample"])

    schema = slim.drop("__text").schema.add("key", "long").add("n", "integer").add("map", "binary")
    return slim.mapInArrow(run, schema.add("sample", T.ArrayType(T.LongType())))


def common_shingles(prints: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many different sets, sorted, and the rank of each by its count."""
    counted = prints.where(F.size("sample") > 0).groupBy("key").agg(F.first("sample").alias("sample")).select(
        F.explode("sample").alias("h")).groupBy("h").count()
    rows = counted.where(F.col("count") * SAMPLED >= COMMON).orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()
    found = np.array([r.h for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], -order


def postings(docs: DataFrame, text: str, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(h, key, n): the prefix of every different set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sliced(batches):
            heads = [prefix(s, common, rank) for s in sets]
            sizes = [len(p) for p in heads]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(heads).view(np.int64)),
                 pa.array(np.repeat(np.array([_key(s) for s in sets], dtype=np.uint64), sizes).view(np.int64)),
                 pa.array(np.repeat(np.array([len(s) for s in sets], dtype=np.int32), sizes))], names=["h", "key", "n"])

    rows = docs.select(col(text).cast("binary").alias("__text")).mapInArrow(run, "h long, key long, n int")
    return rows.groupBy("h", "key").agg(F.first("n").alias("n"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows that arrive sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if held and held[-1].column(0)[-1].as_py() == keys[-1] and last == 0:
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch.slice(0, last)])
        if table.num_rows:
            yield table
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _candidates(few: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(long, a, b, na, nb) from postings sorted by h, n and key; ``long`` is h in postings of over ``few`` texts.

    A long posting gives a row for each text with the shortest of its length class, the shortest one's own included.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            h, key, n = (table.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            sizes = np.diff(np.r_[starts, len(h)])
            of = np.repeat(sizes, sizes)
            a, b, where = [], [], []                    # places of rows
            for step in range(1, few):
                i = np.flatnonzero((h[step:] == h[:-step]) & (of[step:] <= few))
                i = i[4 * n[i + step].astype(np.int64) <= 5 * n[i].astype(np.int64)]
                a.append(i)
                b.append(i + step)
            short = sum(map(len, a))
            for start, size in zip(starts[sizes > few], sizes[sizes > few]):
                at, end = start, start + size
                while at < end:
                    to = at + int(np.searchsorted(n[at:end], 5 * int(n[at]) // 4, side="right"))
                    a.append(np.full(to - at, at))
                    b.append(np.arange(at, to))
                    at = to
                where.append(np.full(size, h[start]))
            flat, a, b = np.concatenate([np.zeros(short, np.int64), *where]), np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat, mask=np.arange(len(flat)) < short), *map(pa.array, (key[a], key[b], n[a], n[b]))],
                names=["long", "a", "b", "na", "nb"])

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (a, b, na, nb, amap, bmap) whose parity maps let them be similar."""
    for batch in batches:
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        maps = [batch.column(i).to_pylist() for i in (4, 5)]
        widths = np.array([[len(m) for m in side] for side in maps], dtype=np.int64).reshape(2, -1)
        keep = np.zeros(batch.num_rows, dtype=bool)
        for pair in np.unique(widths, axis=1).T:
            at = np.flatnonzero((widths == pair[:, None]).all(axis=0))
            a, b = (_matrix([side[i] for i in at]) for side in maps)
            keep[at] = _close(a, b, na[at], nb[at])
        yield batch.select([0, 1]).filter(pa.array(keep))


def _forest(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> list[int]:
    """The places of pairs (a, b), taken in this order, that connect what is not connected yet."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    kept, most = [], len(np.union1d(a, b)) - 1
    for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            kept.append(i)
            if len(kept) == most:
                break
    return kept


def _meetings(thin: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) that may be similar from rows (block, outside, key, root, n, map) sorted by block.

    In a block the rows ``outside`` meet the others that have a different root. With ``thin`` a block gives a forest
    of the closest pairs, fewer than it has roots: if all of them are similar, they connect all that its pairs could.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            block, outside, key, root, n = (table.column(i).to_numpy() for i in range(5))
            maps = table.column(5).to_pylist()
            ends = np.r_[np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
            for start, end in zip(np.r_[0, ends[:-1]], ends):
                at = np.arange(start, end)
                width = np.array([len(maps[i]) for i in at]) // 8
                others = {w: at[(width == w) & ~outside[at]] for w in np.unique(width).tolist()}
                tables = {w: _matrix([maps[i] for i in rows]) for w, rows in others.items() if len(rows)}
                found = []
                for x in at[outside[at]]:
                    own = _matrix([maps[x]])
                    for w, matrix in tables.items():
                        rows = others[w]
                        may = np.flatnonzero((root[rows] != root[x]) & (4 * n[rows].astype(np.int64) <= 5 * int(n[x]))
                                             & (4 * int(n[x]) <= 5 * n[rows].astype(np.int64)))
                        words = min(w, own.shape[1])
                        off = np.bitwise_count(_folded(matrix[may], words) ^ _folded(own, words)).sum(axis=1, dtype=np.int64)
                        near = np.flatnonzero(9 * off <= n[rows[may]].astype(np.int64) + int(n[x]))
                        if thin:                    # the closest of each root
                            near = near[np.argsort(off[near], kind="stable")]
                            near = near[np.unique(root[rows[may[near]]], return_index=True)[1]]
                        found.append((np.full(len(near), x), rows[may[near]], off[near]))
                if not found:
                    continue
                x, y, off = (np.concatenate(part) for part in zip(*found))
                if thin and len(x):
                    kept = _forest(root[x], root[y], np.argsort(off, kind="stable"))
                    x, y = x[kept], y[kept]
                flip = key[x] > key[y]
                yield pa.RecordBatch.from_arrays([pa.array(key[np.where(flip, y, x)]), pa.array(key[np.where(flip, x, y)])],
                                                 names=["a", "b"])

    return run


def meetings(members: DataFrame, thin: bool) -> DataFrame:
    """Pairs (a, b) of members (h, key, root, n, map) of a posting that may connect two of its components.

    All components but the largest are outside; their members meet all members. Both are cut into blocks by key, so
    that a task holds two blocks whatever the posting's length.
    """
    parts = members.groupBy("h", "root").count()
    tops = parts.groupBy("h").agg(F.max_by("root", F.struct("count", "root")).alias("top"), F.max("count").alias("largest"),
                                  F.sum("count").alias("all"))
    cuts = cut_lineage(tops.select("h", "top", F.ceil((F.col("all") - F.col("largest")) / BLOCK).alias("out"),
                                   F.ceil(F.col("all") / BLOCK).alias("whole")))
    placed = members.join(small(cuts), "h")

    def rows(outside: bool) -> DataFrame:
        own, other = ("out", "whole") if outside else ("whole", "out")
        mine = F.pmod(F.xxhash64("key"), F.col(own))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        laid = placed.where("root <> top") if outside else placed
        laid = laid.withColumn("mine", mine).withColumn("each", each)
        pair = ("mine", "each") if outside else ("each", "mine")
        return laid.select(F.xxhash64("h", *pair).alias("block"), F.lit(outside).alias("outside"), "key", "root", "n", "map")

    met = rows(True).unionByName(rows(False)).repartition("block").sortWithinPartitions("block").mapInArrow(
        _meetings(thin), "a long, b long")
    return met.distinct()


def _sets(docs: DataFrame, rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(key, set) of the rows (key, __nid, __nhash)."""
    slim = docs.select(col(id_col).alias("__id"), row_hash(docs).alias("__hash"), col(text).cast("binary").alias("__text"))
    texts = slim.join(small(rows), (F.col("__hash") == F.col("__nhash")) & F.col("__id").eqNullSafe(F.col("__nid")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sliced(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets)], names=["key", "set"])

    return texts.select("key", "__text").mapInArrow(run, "key long, set array<long>").groupBy("key").agg(
        F.first("set").alias("set"))


def _like(a: Column, b: Column) -> Column:
    return 9 * F.size(F.array_intersect(a, b)) >= 4 * (F.size(a) + F.size(b))


def _may(both: Column, na: Column, nb: Column) -> Column:
    """Whether sets of these sizes with ``both`` shingles common to their prefixes can have a similarity of 4/5.

    Of the two prefixes one ends first in the order; what its set shares beyond it is in its remaining ceil(4n/5) - 1.
    """
    rest = F.greatest(*[F.ceil(4 * n / 5) - 1 for n in (na, nb)])
    return 9 * (both + rest) >= 4 * (na + nb)


def similar_links(docs: DataFrame, own: DataFrame, common: tuple[np.ndarray, np.ndarray], id_col: str, text: str) -> DataFrame:
    """Links (a, b) that connect the different sets (``own``: key, first, n, map) just as all pairs of 4/5 or more do."""
    index = postings(docs, text, *common).repartition("h").sortWithinPartitions("h", "n", "key")
    met = written(index.mapInArrow(_candidates(FEW), "long long, a long, b long, na int, nb int"), "candidates")

    maps = own.select("key", "n", "map")

    def verified(pairs: DataFrame) -> DataFrame:
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        rows = keys.join(own, "key").select("key", F.col("first.id").alias("__nid"), F.col("first.tie").alias("__nhash"))
        sets = written(_sets(docs, cut_lineage(rows), id_col, text), "shingle-sets")
        left, right = (sets.select(F.col("key").alias(k), F.col("set").alias(f"{k}_set")) for k in ("a", "b"))
        return cut_lineage(pairs.join(right, "b").join(left, "a").where(
            _like(F.col("a_set"), F.col("b_set"))).select("a", "b"))

    # a pair that also shares a long posting may have too low a count here; it is compared in that posting
    counted = met.where("long is null").groupBy("a", "b", "na", "nb").count().where(_may(F.col("count"), F.col("na"), F.col("nb")))
    leaders = met.where("long is not null and a <> b").select("a", "b", "na", "nb")
    pairs = counted.drop("count").unionByName(leaders).distinct()
    for k in ("a", "b"):
        pairs = pairs.join(maps.select(F.col("key").alias(k), F.col("map").alias(f"{k}map")), k)
    pairs = cut_lineage(pairs.select("a", "b", "na", "nb", "amap", "bmap").mapInArrow(_near, "a long, b long"))
    links = verified(pairs)

    members = cut_lineage(met.where("long is not null").select(F.col("long").alias("h"), F.col("b").alias("key")))

    def apart(links: DataFrame) -> DataFrame:
        """Members (h, key, root, n, map) of the postings that hold several components; equal postings once."""
        roots = components(links)
        rooted = cut_lineage(members.join(roots, F.col("key") == F.col("node"), "left").select(
            "h", "key", F.coalesce("root", "key").alias("root")))
        several = rooted.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("key").alias("n"),
                                          F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("all"))
        several = cut_lineage(several.where("least <> most").groupBy("n", "all").agg(F.min("h").alias("h")).select("h"))
        return rooted.join(small(several), "h", "left_semi").join(maps, "key")

    # the closest pairs first; all others only between components that those leave apart
    tried = cut_lineage(meetings(apart(links), thin=True))
    if tried.isEmpty():
        return links
    links = cut_lineage(links.unionByName(verified(tried)))
    rest = cut_lineage(meetings(apart(links), thin=False).join(tried, ["a", "b"], "left_anti"))
    return links if rest.isEmpty() else links.unionByName(verified(rest))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group connected by Jaccard similarities of 4/5 or more: the smallest id, of equal ids one.

    Texts without words are equal to each other. Null ids are larger than any id.
    """
    prints = cut_lineage(set_prints(docs, id_col, text))
    first = F.min(F.struct(F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"), F.col("__hash").alias("tie")))
    own = cut_lineage(prints.groupBy("key").agg(first.alias("first"), F.first("n").alias("n"), F.first("map").alias("map")))
    roots = components(similar_links(docs, own, common_shingles(prints), id_col, text))
    of = own.join(roots, own.key == roots.node, "left").select("first", F.coalesce("root", "key").alias("root"))
    kept = of.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.id").alias("__id"), F.col("first.tie").alias("__hash"))
    return emit(docs, id_col, kept.withColumn("__times", F.lit(1).cast("long")))
