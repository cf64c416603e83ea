import zlib
from collections import Counter

import pytest

from facetframe.llm.sharding import Leaf, regular_tree, shard, tree_shard, with_region
from pyspark.sql import functions as F


def test_rows_slots_and_growth(spark, odd, odd_rows, none):
    tree = regular_tree(24)
    got = shard(odd, tree, with_region(tree)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard(none, tree).count() == 0


def test_shares_and_movement(spark):
    rows = spark.range(40_000)
    tree = regular_tree(24)
    grown = with_region(tree)
    both = tree_shard(tree_shard(rows, F.col("id"), tree, "old"), F.col("id"), grown, "new").cache()
    counts = {r.old: r["count"] for r in both.groupBy("old").count().collect()}
    assert set(counts) == set(range(24)) and all(abs(n - 40_000 / 24) < 6 * (40_000 / 24) ** 0.5 for n in counts.values())
    assert both.where("old <> new AND new <> 24").count() == 0
    assert abs(both.where("new = 24").count() - 1_600) < 250
    heavier = [Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]      # in region 0
    moved = tree_shard(both, F.col("id"), heavier, "other").where("old <> other")
    assert moved.where("other >= 8").count() == 0 and moved.count() > 0
    both.unpersist()


def test_trees_are_checked(odd):
    with pytest.raises(ValueError):
        tree_shard(odd, F.col("doc_id"), [Leaf(0, 0, 0, 0.0)], "s")
