import re
from collections import Counter

import pytest

from facetframe.llm.mixing import mix, mix_plan


def plain_targets(sizes):
    """Share the total by weight, cut at three times, share the rest again, until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]]
        if not over:
            return {**fixed, **{s: rest * weight[s] / sum(weight[x] for x in free) for s in free}}
        fixed.update({s: 3 * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 5, None: 2}, {"a": 1, "b": 1, "c": 1}, {"z": 0, "y": 7}])
def test_targets(spark, sizes):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id int, text string, source string")
    got = {r.source: r for r in mix_plan(docs).collect()}
    want = plain_targets(sizes)
    for s in sizes:
        assert got[s].target == pytest.approx(want[s], rel=1e-12) and got[s].source_size == sizes[s]


def test_plan_and_emitted_rows(odd, odd_rows, none):
    plan = mix_plan(odd)
    rows = plan.collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mix_plan(odd.repartition(2)).collect()), key=repr)
    assert Counter((r.source, r.size) for r in rows) == Counter((r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in odd_rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 2 * max(r.size for r in own)
        assert all(0 <= r.copies <= 3 for r in own)
    mixed = mix(odd)
    assert mixed.columns == odd.columns
    want = Counter()
    for r in rows:
        want[r["__id"], r.source, r.size] += r.copies
    got = Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in mixed.collect())
    assert got == +want
    assert mix(none).count() == 0 and mix_plan(none).count() == 0
