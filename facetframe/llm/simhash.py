"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in 3 bits or fewer agree in at least 5 of their 8 bytes. A posting of the
index holds the fingerprints that agree in the four byte positions of a plane. The 14 planes below (the Steiner
system S(3,4,8)) have the property that whichever 3 positions differ, one plane avoids them all, so every pair
with 5 agreeing bytes meets in a posting, and postings are as short as 32 fixed bits make them. In a posting
the agreeing bytes of a pair are tallied, pairs with 5 or more stay, and their bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage
from .common import emit, row_hash, small
from .components import components

MOST_BITS = 3
LEAST_BYTES = 5
SHINGLE = 3
SEED = 42
#: A posting with more fingerprints than this is divided again, see ``divided``.
POSTING = 2_000
#: Sets of four positions 0..7 (as corners of a cube) whose sum is zero: 14 planes.
PLANES = [(a, b, c, a ^ b ^ c) for a in range(8) for b in range(a + 1, 8) for c in range(b + 1, 8) if a ^ b ^ c > c]


def fingerprint(text: bytes | None) -> int:
    """SimHash of a text over its 3-word shingles, repeats counted; 0 without words."""
    words = (text or b"").lower().split()        # both in ASCII terms
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
        n = len(words) - SHINGLE + 1
    ones = np.zeros(64, dtype=np.int64)
    left = n
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    while left:
        part = np.fromiter(hashes, dtype=">u8", count=min(left, 8192))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        left -= len(part)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: Column, keep: list[Column], name: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint of ``text`` as a signed long; one pass, no shuffle."""
    slim = df.select(*keep, text.cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([fingerprint(t.as_py()) for t in part.column("__text")], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fps.view(np.int64))],
                                                 names=[*part.schema.names[:-1], name])

    schema = slim.drop("__text").schema.add(name, "long")
    return slim.mapInArrow(run, schema)


def _index(fps: DataFrame) -> DataFrame:
    """(key, fp) with the key of every plane."""
    byte = [F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = []
    for k, plane in enumerate(PLANES):
        key = F.lit(k << 32)
        for place, p in enumerate(plane):
            key = key + F.shiftleft(byte[p], 8 * place)
        keys.append(key)
    return fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("key", "fp")


def divided(postings: DataFrame, parts: list[int]) -> DataFrame:
    """The postings cut by each of some sets of bits: fingerprints stay together where they agree in the set.

    With more disjoint sets than MOST_BITS covering what can differ, near pairs still meet in one of them.
    """
    keys = [F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))) for i, mask in enumerate(parts)]
    return postings.select("fp", F.explode(F.array(*keys)).alias("key")).select("key", "fp")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


#: Four sets of two bytes, then four sets of every fourth bit. After both at most 18 bits of a posting are free.
DIVISIONS = [[_signed(0xFFFF << 16 * i) for i in range(4)], [_signed(0x1111111111111111 << i) for i in range(4)]]


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs agree in LEAST_BYTES bytes and then differ in MOST_BITS bits at most."""
    x = np.bitwise_xor(a, b)
    equal = np.zeros(x.shape, dtype=np.int8)
    for p in range(8):
        equal += (x >> np.uint64(8 * p)) & np.uint64(255) == 0
    kept = equal >= LEAST_BYTES
    kept[kept] = np.bitwise_count(x[kept]) <= MOST_BITS
    return kept


def _spread(group: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect a large posting just as all its near pairs do: each fingerprint is reached once."""
    out, rest = [], group
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            hit = near(rest, at)
            found, rest = rest[hit], rest[~hit]
            out += [(at, f) for f in found]
            front += list(found)
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside postings; the rows arrive sorted by key, and a posting may run over several batches."""
    held_keys, held = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

    def found(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
        sizes = np.diff(np.r_[starts, len(keys)])
        a, b = [], []
        for step in range(1, 8):                       # postings of up to 8: every pair, by distance
            i = np.flatnonzero((keys[step:] == keys[:-step]) & (np.repeat(sizes, sizes)[step:] <= 8))
            hit = near(fps[i], fps[i + step])
            a.append(fps[i][hit])
            b.append(fps[i + step][hit])
        for start, n in zip(starts[sizes > 8], sizes[sizes > 8]):
            pairs = np.array(_spread(fps[start:start + n]), dtype=np.uint64).reshape(-1, 2)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)),
                                              pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    for batch in batches:
        keys = np.r_[held_keys, batch.column(0).to_numpy()]
        fps = np.r_[held, batch.column(1).to_numpy().view(np.uint64)]
        last = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        yield from found(keys[:last], fps[:last])
        held_keys, held = keys[last:], fps[last:]
    yield from found(held_keys, held)


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (``fp``) just as all pairs within MOST_BITS do."""
    found, postings = None, _index(fps)
    for parts in [*DIVISIONS, None]:
        over = None
        if parts:
            over = cut_lineage(postings.groupBy("key").count().where(F.col("count") > POSTING).select("key"))
            over = None if over.isEmpty() else small(over)
        usual = postings.join(over, "key", "left_anti") if over is not None else postings
        links = usual.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")
        found = links if found is None else found.unionByName(links)
        if over is None:
            break
        postings = cut_lineage(divided(postings.join(over, "key", "left_semi"), parts))
    return found


def near_duplicates(prints: DataFrame, id_col: str = "__id", tie: str = "__hash") -> DataFrame:
    """Per distinct fingerprint (``fp``): component root, and the smallest (id, tie) of all its rows.

    ``prints`` has one row per document and must be checkpointed or written. Null ids are larger than any id.
    """
    first = F.min(F.struct(col(id_col).isNull().alias("no_id"), col(id_col).alias("id"), col(tie).alias("tie")))
    own = cut_lineage(prints.groupBy("fp").agg(first.alias("own")))
    roots = components(near_links(own.select("fp")))
    of = own.join(roots, own.fp == roots.node, "left").select(
        "fp", "own", F.coalesce("root", "fp").alias("root"))
    best = of.groupBy("root").agg(F.min("own").alias("first"))
    return cut_lineage(of.join(best, "root").select("fp", "root", "first"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest id linked to it, itself included).

    Null and empty texts have fingerprint zero and are linked like others. Repeated rows are rows of their own.
    component_id is null only where no row of the component has an id.
    """
    prints = cut_lineage(fingerprints(docs, col(text), [col(id_col).alias("__id"), F.lit(0).alias("__hash")]))
    groups = near_duplicates(prints).select("fp", F.col("first.id").alias("component_id"))
    return prints.join(groups, "fp").select(
        F.col("__id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows but those of a component whose (id, hash of the row) is not the component's smallest; no text is shuffled.

    Rows equal in all columns stay together. Only the list of dropped rows is written; up to a bound it is broadcast.
    """
    prints = cut_lineage(fingerprints(docs, col(text), [col(id_col).alias("__id"), row_hash(docs).alias("__hash")]))
    first = near_duplicates(prints).select("fp", F.col("first.id").alias("__kept"), F.col("first.tie").alias("__tie"))
    dropped = prints.join(first, "fp").where(
        ~(F.col("__id").eqNullSafe(F.col("__kept")) & (F.col("__hash") == F.col("__tie"))))
    dropped = cut_lineage(dropped.select(F.col("__id").alias("__did"), F.col("__hash").alias("__dhash")).distinct())
    return docs.join(small(dropped), (row_hash(docs) == F.col("__dhash")) & col(id_col).eqNullSafe(F.col("__did")), "left_anti")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: that with the smallest id, and of equal ids one."""
    prints = cut_lineage(fingerprints(docs, col(text), [col(id_col).alias("__id"), row_hash(docs).alias("__hash")]))
    kept = near_duplicates(prints).select(F.col("first.id").alias("__id"), F.col("first.tie").alias("__hash")).distinct()
    return emit(docs, id_col, kept.withColumn("__times", F.lit(1).cast("long")))
