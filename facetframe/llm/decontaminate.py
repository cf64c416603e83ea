"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Items are partitioned by their number of distinct shingles, up to 1, 2, 4, 8, ... An item's sketch are its smallest
shingle hashes (bottom-k MinHash). k follows from the upper size u of the partition: a document that contains the
share t of an item misses at most (1 - t) of its shingles, so among (1 - t) u + 1 of them at least one is in
the document. So no leak is lost, however long the document; sketches are a fifth of the items at 0.8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage
from .common import row_hash, small

SHINGLE = 5
LEAST_SHARE = 0.8


def _words(text: Column) -> Column:
    """Letters and digits in lower case; everything else separates."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(words: Column) -> Column:
    """1-based starts of the shingles; a shorter text is one shingle, one without words none."""
    return F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))))


def _shingles(words: Column) -> Column:
    return F.array_distinct(F.transform(_starts(words), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def _hashes(word_hashes: Column) -> Column:
    """A hash for each shingle, from the hashes of its words; past the end of a short text stand nulls."""
    return F.transform(_starts(word_hashes), lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(-1, SHINGLE - 1)]))


def _hashed(df: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """``keep`` and h, the hashes of all shingles.

    Take ``explode_outer`` of it: for ``explode`` Spark puts a test of the array's size, with all of its
    computation written out in it, before the projections.
    """
    words = df.select(*keep, F.transform(_words(text), lambda w: F.xxhash64(w)).alias("__w"))
    return words.select(*[c for c in words.columns if c != "__w"], _hashes(F.col("__w")).alias("h"))


def sketches(items: DataFrame, item_id: str, text: str, least_share: float = LEAST_SHARE) -> DataFrame:
    """(h, item): the inverted index of the items' sketches."""
    hashed = _hashed(items, [col(item_id).alias("item")], col(text)).select("item", F.array_sort(F.array_distinct("h")).alias("h"))
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.size("h"))))
    k = F.floor(upper * F.lit(1 - least_share) + F.lit(1e-9)).cast("int") + 1
    return hashed.where(F.size("h") > 0).select(F.explode_outer(F.slice("h", F.lit(1), k)).alias("h"), "item").distinct()


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """Pairs (__id, __hash, item, matched, n_shingles, containment) with containment of at least ``least_share``.

    Shingles are five words. A text with fewer words is one shingle, so it is only found in texts with the same
    words; one without words contains nothing and is in nothing. Null texts are empty. Repeated items share
    an id's best value. Equal rows of ``docs`` are found once.
    """
    items = items.select(col(item_id).alias("item"), col(item_text).alias("item_text"))
    index = small(cut_lineage(sketches(items, "item", "item_text", least_share)))
    slim = docs.select(col(id_col).alias("__id"), row_hash(docs).alias("__hash"), col(text).alias("__text"))
    met = _hashed(slim, [F.col("__id"), F.col("__hash")], F.col("__text")).select(
        "__id", "__hash", F.explode_outer("h").alias("h")).join(index, "h")
    pairs = small(cut_lineage(met.groupBy("__id", "__hash", "item").agg(F.lit(1).alias("one")).select(
        F.col("__id").alias("__pid"), F.col("__hash").alias("__phash"), "item")))
    texts = items.select(F.col("item").alias("__item"), _words(F.col("item_text")).alias("w")).select(
        "__item", _shingles(F.col("w")).alias("item_shingles"))
    found = slim.join(pairs, (F.col("__hash") == F.col("__phash")) & F.col("__id").eqNullSafe(F.col("__pid")))
    both = found.select("__id", "__hash", "item", _words(F.col("__text")).alias("w")).select(
        "__id", "__hash", "item", _shingles(F.col("w")).alias("shingles")).join(
        small(cut_lineage(texts)), F.col("item").eqNullSafe(F.col("__item")))
    share = both.select("__id", "__hash", "item", F.size(F.array_intersect("shingles", "item_shingles")).cast("long").alias("matched"),
                        F.size("item_shingles").cast("long").alias("n_shingles"))
    share = share.withColumn("containment", F.col("matched") / F.col("n_shingles"))
    return share.where(F.col("containment") >= least_share).groupBy("__id", "__hash", "item").agg(
        F.max_by(F.struct("matched", "n_shingles", "containment"), "containment").alias("best")).select(
        "__id", "__hash", "item", "best.*")


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    leaks = find_leaks(docs, items, id_col, text, **names).select(
        F.col("__id").alias("__lid"), F.col("__hash").alias("__lhash")).distinct()
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("__row"), col(id_col).alias("__id"),
                       row_hash(docs).alias("__hash"))
    return rows.join(small(cut_lineage(leaks)), (F.col("__hash") == F.col("__lhash"))
                     & F.col("__id").eqNullSafe(F.col("__lid")), "left_anti").select("__row.*")
