"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .common import running
from ..session import cut_lineage


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def regular_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards 0.. in racks of ``per_rack``, and these in regions of ``racks``."""
    return [Leaf(s // (per_rack * racks), s // per_rack, s) for s in range(shards)]


def with_region(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a rack and a region of its own.

    No other subtree changes its weight, so rows move only into the new shard. A shard added to an existing
    rack raises the weights of that rack and region instead, and rows may then also move inside that region.
    """
    return [*tree, Leaf(max((x.region for x in tree), default=-1) + 1, max((x.rack for x in tree), default=-1) + 1,
                        max((x.shard for x in tree), default=-1) + 1, weight)]


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    """Exponential draw of a node for a key; the smallest of several wins in proportion to the weights."""
    h = F.xxhash64(key, F.lit(f"{level}{node}"))
    uniform = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2 ** 53))
    return -F.log(uniform) / F.lit(weight)


def _choice(key: Column, level: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct(_draw(key, level, n, w), F.lit(n).alias("node")) for n, w in sorted(weights.items())]
    return F.least(*draws)["node"]


def _by_parent(leaves: list[Leaf], parent: str, child: str) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = {}
    for x in leaves:
        below = out.setdefault(getattr(x, parent), {})
        below[getattr(x, child)] = below.get(getattr(x, child), 0.0) + x.weight
    return out


def tree_shard(df: DataFrame, key: Column, tree: list[Leaf], name: str) -> DataFrame:
    """``df`` with the shard of ``key``: a draw among regions, then the racks of the one drawn, then its shards.

    Each row is tried at regions + racks of a region + shards of a rack. Changing a leaf's weight changes the
    draws of its own rack and region only. A null key is a key like any other. Leaves weigh above 0.
    """
    if any(x.weight <= 0 for x in tree) or not tree:
        raise ValueError("a tree has leaves, and their weights are above 0")
    regions: dict[int, float] = {}
    for x in tree:
        regions[x.region] = regions.get(x.region, 0.0) + x.weight
    out = df.withColumn("__region", _choice(key, "region", regions))
    for parent, child in (("region", "rack"), ("rack", "shard")):
        at = None
        for p, below in sorted(_by_parent(tree, parent, child).items()):
            here = F.col(f"__{parent}") == p
            at = (F.when if at is None else at.when)(here, _choice(key, child, below))
        out = out.withColumn(f"__{child}", at)
    return out.withColumn(name, F.col("__shard").cast("int")).drop("__region", "__rack", "__shard")


def shard(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, id_col: str = "doc_id",
          text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot and, with a second tree, grown_shard.

    size is the UTF-8 length of the text plus 8; null text counts as empty. slot numbers the rows of a shard
    from 0 in the order of id and text checksum. Repeated rows fall into the same shard, in slots of their own.
    """
    rows = docs.select(col(id_col).alias("doc_id"),
                       (F.coalesce(F.octet_length(col(text)), F.lit(0)) + 8).cast("long").alias("size"),
                       F.crc32(F.coalesce(col(text), F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    rows = tree_shard(rows, F.col("doc_id"), tree, "shard")
    rows = tree_shard(rows, F.col("doc_id"), grown, "grown_shard") if grown else rows.withColumn(
        "grown_shard", F.lit(None).cast("int"))
    placed = running(cut_lineage(rows.withColumn("__one", F.lit(1).cast("long"))), ["shard"],
                     ["doc_id", "text_crc32"], {"slot": "__one"})
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, tree: list[Leaf], path: str, id_col: str = "doc_id") -> None:
    """Write the rows to ``path``/shard=N; rows of a shard may fill several files."""
    tree_shard(docs, col(id_col), tree, "shard").write.partitionBy("shard").parquet(path)
