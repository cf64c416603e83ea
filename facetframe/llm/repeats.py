"""Repeated passages, found in suffix arrays of bounded blocks.

Every string of LEAST bytes has a leading anchor: of its GRAM-byte substrings the one with the smallest hash, the
leftmost if several. Equal strings have equal anchors at equal places, so the starts of a text fall into runs
("units") that share an anchor occurrence, and repeats are only sought among units with equal anchors ("key").

- Units of a key that all have the same text need no search: they are copies of each other, or single.
- For the rest the distinct texts of some keys are put together in a block. From the Burrows-Wheeler transform of
  the block, interval expansion finds the common prefix of each suffix and the one before, in the order of their
  length (Beller, Gog, Ohlebusch and Schnattinger, 2013), and stops at LEAST: what is open then is a repeat.
- A key with very many distinct texts is divided: by narrower runs, and by what all starts of a run have in
  common. The last division has one start a unit, where equal keys are equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage, cut_lineage_in_place
from .common import written

LEAST = 400
GRAM = 32
#: Starts of a unit when a key is divided once, and once more.
WIDTHS = (32, 1)
#: A key with more distinct texts than this is divided; a unit has at most LEAST - GRAM + 1 starts.
MOST_TEXTS = 1_000
#: Common prefixes up to here are read off the sorting; a double of the symbols sorted first.
FIRST = 28
#: Bytes of text a block aims at.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of every GRAM-byte substring."""
    n = len(text)
    total = np.r_[np.uint64(0), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)]
    h = (total[GRAM:] - total[:-GRAM]) * _powers(_INVERSE, n - GRAM + 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def units(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, number of starts, distance of the anchor from the start, and key of each unit of a text."""
    if len(text) < LEAST:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    h = _gram_hashes(np.frombuffer(text, np.uint8))
    ranked = h >> np.uint64(31) << np.uint64(31) | np.arange(len(h), dtype=np.uint64)      # a text has less than 2 GB
    w = LEAST - GRAM + 1
    blocks = np.full((-(-len(h) // w), w), np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks.ravel()[:len(h)] = ranked
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(text) - LEAST + 1
    anchor = (np.minimum(right[:n], left[w - 1:w - 1 + n]) & np.uint64((1 << 31) - 1)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return start, np.diff(np.r_[start, n]), anchor[start] - start, h[anchor[start]].view(np.int64)


def _digest(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


UNIT = "row long, start int, owned int, lead int, key long, digest long"
_NAMES = ["row", "start", "owned", "lead", "key", "digest"]


def _unit_batch(row: int, start, owned, lead, key, digest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(start), row, np.int64)), *[pa.array(np.asarray(x, np.int32)) for x in (start, owned, lead)],
         pa.array(np.asarray(key, np.int64)), pa.array(np.asarray(digest, np.int64))], names=_NAMES)


def _all_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for row, packed in zip(batch.column(0), batch.column(1)):
            text = unpack.decompress(packed.as_py())
            start, owned, lead, key = units(text)
            if len(start):
                digest = [_digest(text[s:s + n + LEAST - 1]) for s, n in zip(start.tolist(), owned.tolist())]
                yield _unit_batch(row.as_py(), start, owned, lead, key, digest)


def _narrower(width: int):
    """Units of rows (packed text, list of units) cut to ``width`` places of the anchor; the key takes in the common text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row, packed, listed in zip(*[batch.column(i) for i in range(3)]):
                text, out = unpack.decompress(packed.as_py()), []
                for u in listed.as_py():
                    anchor, at, end = u["start"] + u["lead"], u["start"], u["start"] + u["owned"]
                    while at < end:
                        part = (anchor - at) // width                       # places part*width .. of the anchor
                        stop = min(end, anchor - part * width + 1)
                        common = text[anchor - part * width:anchor - part * width - (width - 1) + LEAST]
                        out.append((at, stop - at, anchor - at, _digest(b"%d:%d:" % (u["key"], part) + common),
                                    _digest(text[at:stop - 1 + LEAST])))
                        at = stop
                yield _unit_batch(row.as_py(), *zip(*out))
    return run


def _suffixes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of symbols below 512, sorted by more than LEAST symbols, by doubling the sorted length.

    With it, the places that differ from the one before in the first FIRST / 2 and the first FIRST symbols.
    """
    n, h = len(s), 7
    wide = np.r_[s, np.zeros(h, s.dtype)].astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = key << 9 | wide[k:k + n]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        border = np.r_[True, ranked[1:] != ranked[:-1]]
        place = np.cumsum(border)
        if h == FIRST // 2:
            shorter = border
        elif h == FIRST:
            borders = shorter, border
        if h > LEAST:
            return order, *borders
        rank = np.empty(n, np.int64)
        rank[order] = place
        key = rank * (n + 1)
        key[:n - h] += rank[h:]
        h *= 2


def long_prefixes(s: np.ndarray, order: np.ndarray, shorter: np.ndarray, short: np.ndarray) -> np.ndarray:
    """For each place of the suffix array, whether it shares LEAST symbols with the place before.

    Breadth first over the length: a border of value l at place j puts one of value l + 1 wherever backward
    extension by a symbol parts what stands on its two sides, unless a shorter one is there.
    The values below FIRST are known from sorting (``short``); of these the ones from FIRST / 2 (not ``shorter``)
    are expanded together first, and what they find open has the value FIRST.
    """
    last = s[order - 1]
    back = np.argsort(last, kind="stable")              # the place of a suffix without its first symbol
    lead = np.empty_like(back)
    lead[back] = np.arange(len(back))
    open_ = ~short
    same = np.r_[False, last[1:] == last[:-1]]
    # places whose shorter suffixes stand side by side get their value from one border, the others from a range
    k = np.flatnonzero(open_)
    k = k[back[k] != back[k - 1] + 1]
    low, high = back[k - 1] + 1, back[k]
    border = np.flatnonzero(short & ~shorter)
    for _ in range(FIRST, LEAST):
        beside = lead[border[same[border]]]
        hit = np.searchsorted(border, high, "right") > np.searchsorted(border, low)
        border = np.concatenate([beside[open_[beside]], k[hit]])
        border.sort()
        open_[border] = False
        k, low, high = k[~hit], low[~hit], high[~hit]
        if not len(border):
            break
    return open_


def block_repeats(texts: list[bytes], owned: list[int], times: list[int]) -> list[np.ndarray]:
    """For each text, which of its first ``owned`` starts begin a string of LEAST bytes that occurs again.

    ``times`` counts the occurrences a text stands for. Strings do not run over the end of a text.
    """
    sizes = np.array([len(t) for t in texts]) + 1
    begin = np.cumsum(sizes) - sizes
    s = np.zeros(int(sizes.sum()), np.int16)
    weight = np.zeros(len(s), np.int64)
    for at, t, n, c in zip(begin, texts, owned, times):
        s[at:at + len(t)] = np.frombuffer(t, np.uint8).astype(np.int16) + 1
        weight[at:at + n] = c
    order, *borders = _suffixes(s)
    run = np.cumsum(~long_prefixes(s, order, *borders))
    total = np.bincount(run, weights=weight[order])
    repeated = np.empty(len(s), bool)
    repeated[order] = total[run] > 1
    return [repeated[at:at + n] for at, n in zip(begin, owned)]


def _search(key: tuple, table: pa.Table) -> pa.Table:
    texts, owned, times = (table[c].to_pylist() for c in ("text", "owned", "times"))
    spans = []
    for hit, n in zip(block_repeats(texts, owned, times), owned):
        edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        spans.append([{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2])])
    return pa.table({"key": table["key"], "digest": table["digest"],
                     "spans": pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))})


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for row, packed, found in zip(*[batch.column(i) for i in range(3)]):
            text = unpack.decompress(packed.as_py())
            merged: list[list[int]] = []
            for s in sorted(found.as_py() or [], key=lambda s: s["lo"]):
                if merged and s["lo"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["hi"])
                else:
                    merged.append([s["lo"], s["hi"]])
            kept, at = [], 0
            for lo, hi in merged:
                kept.append(text[at:lo])
                at = hi
            kept.append(text[at:])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row.as_py()], pa.int64()), pa.array([len(text)], pa.int64()),
                 pa.array([[{"lo": a, "hi": b} for a, b in merged]], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                 pa.array([b"".join(kept)], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack.compress(t.as_py()) for t in batch.column(2)], pa.binary())],
                                         names=["row", "id", "packed"])


def _with_text(texts: DataFrame, unit_rows: DataFrame, *more: str) -> DataFrame:
    """(row, packed, list of that row's units); a text is not shuffled for it."""
    listed = unit_rows.groupBy("row").agg(F.collect_list(F.struct("start", "owned", "lead", "key", "digest", *more)).alias("listed"))
    return texts.select("row", "packed").join(listed, "row").select("row", "packed", "listed")


def _block_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for _, packed, listed in zip(*[batch.column(i) for i in range(3)]):
            text, listed = unpack.decompress(packed.as_py()), listed.as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([u["key"] for u in listed], pa.int64()), pa.array([u["digest"] for u in listed], pa.int64()),
                 pa.array([u["owned"] for u in listed], pa.int32()), pa.array([u["times"] for u in listed], pa.int64()),
                 pa.array([text[u["start"]:u["start"] + u["owned"] + LEAST - 1] for u in listed], pa.binary())],
                names=["key", "digest", "owned", "times", "text"])


def _level(texts: DataFrame, found: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Covered spans (row, lo, hi) of the units that can be decided now, and the units left for a division."""
    seen = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    # dealt once more, so that the join may split a key that very many units have
    pairs = seen.where("n > 1").withColumnRenamed("key", "__key").repartition("low")
    several = found.join(pairs, F.col("key") == F.col("__key")).drop("__key")
    several = cut_lineage(several.withColumn("alike", F.col("low") == F.col("high")).drop("n", "low", "high"))
    covered = several.where("alike").select("row", F.col("start").alias("lo"), (F.col("start") + F.col("owned") + (LEAST - 1)).alias("hi"))
    if last:                # one start a unit: equal keys are equal texts
        return covered, None
    mixed = several.where("NOT alike").drop("alike")
    distinct = cut_lineage(mixed.groupBy("key", "digest").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "start", "owned", "lead")).alias("one")).select("key", "digest", "times", "one.*"))
    crowded = cut_lineage(distinct.groupBy("key").count().where(F.col("count") > MOST_TEXTS).select(F.col("key").alias("__key")))
    over = not crowded.isEmpty()
    searched = distinct.join(crowded, F.col("key") == F.col("__key"), "left_anti") if over else distinct
    size = searched.agg(F.sum(F.col("owned") + LEAST)).first()[0] or 0
    in_blocks = _with_text(texts, searched, "times").mapInArrow(_block_texts, "key long, digest long, owned int, times long, text binary")
    block = F.pmod(F.xxhash64("key"), F.lit(int(size // BLOCK_BYTES) + 1))
    hits = cut_lineage(in_blocks.withColumn("block", block).groupBy("block").applyInArrow(
        _search, "key long, digest long, spans array<struct<lo:int,hi:int>>").where(F.size("spans") > 0))
    hits = hits.select(F.col("key").alias("__key"), F.col("digest").alias("__digest"), "spans")
    part = mixed.join(hits, (F.col("key") == F.col("__key")) & (F.col("digest") == F.col("__digest"))).select(
        "row", "start", F.explode("spans").alias("s"))
    covered = covered.unionByName(part.select("row", (F.col("start") + F.col("s.lo")).alias("lo"),
                                              (F.col("start") + F.col("s.hi") + (LEAST - 1)).alias("hi")))
    left = mixed.join(crowded, F.col("key") == F.col("__key"), "left_semi") if over else None
    return covered, left


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, spans (removed byte ranges, maximal), kept (the remaining bytes).

    A byte is removed if a string of LEAST bytes covers it that starts anywhere else too, in this or another text;
    texts are taken as given, so all copies go. Null and empty texts are empty. Rows that repeat an id are texts
    of their own.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("id"),
                         F.coalesce(col(text).cast("binary"), F.lit(b"")).alias("text")).mapInArrow(
        _pack, "row long, id long, packed binary")
    texts = cut_lineage_in_place(packed.repartition(partitions, "row"))  # later joins by row leave the texts in place
    found, spans = written(texts.select("row", "packed").mapInArrow(_all_units, UNIT), "units"), None
    for width in (*WIDTHS, None):
        covered, left = _level(texts, found, last=width is None)
        spans = covered if spans is None else spans.unionByName(covered)
        if left is None:
            break
        found = _with_text(texts, left).mapInArrow(_narrower(width), UNIT)
    listed = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    named = texts.join(listed, "row", "left").select("id", "packed", "found")
    return named.mapInArrow(_cut_out, "doc_id long, n_bytes long, spans array<struct<lo:int,hi:int>>, kept binary")


def repeat_digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes",
                          F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"]).alias("n_removed"),
                          F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
