import random

import numpy as np
import pytest

from facetframe.llm import similar
from facetframe.llm.similar import drop_similar, parity_map, prefix, shingle_set

DOC = "doc_id long, text string, other int"


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows):
    """The smallest id of each group that all pairs with a Jaccard similarity of 0.8 or more connect."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    return sorted(min(g) for g in groups.values())


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.randrange(10 ** 6)}"
    return " ".join(words)


def corpus(rng):
    """Light and heavy edits of 30 to 300 words, one large group of near copies, a line in many texts, odd texts."""
    texts = [None, "", "  ", "one", "One", "two words", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(30, 300))]
        texts += [" ".join(base)] + [edited(rng, base, rng.choice([1, 1, 2, 3, 5, len(base) // 30])) for _ in range(4)]
    crowd = [f"c{i}" for i in range(80)]
    texts += [edited(rng, crowd, rng.choice([0, 1, 1, 2, 3])) for _ in range(90)]
    line = " ".join(f"line{i}" for i in range(12))
    texts += [line + " " + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(rng.randint(1, 40))) for _ in range(90)]
    rng.shuffle(texts)
    return [(i, t, 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("few, common, block", [(32, 500, 2000), (2, 16, 7)])
def test_groups_equal_brute_force(spark, monkeypatch, few, common, block):
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "COMMON", common)
    monkeypatch.setattr(similar, "SAMPLED", 2 if common < 500 else 16)
    rows = corpus(random.Random(few))
    kept = drop_similar(spark.createDataFrame(rows, DOC).repartition(4))
    assert kept.columns == ["doc_id", "text", "other"]
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_brute_force(rows)


def test_light_edits_do_not_stay_in_the_corpus(spark):
    import corpus_pipeline
    rng = random.Random(1)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(40)]
    rows = [(i, " ".join(b), 0) for i, b in enumerate(base)] + [(100 + i, edited(rng, b, 3), 0) for i, b in enumerate(base)]
    out = dict(corpus_pipeline.STAGES)["simhash_near_duplicates"](spark, spark.createDataFrame(rows, DOC), "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(40))


def test_odd_rows(spark, odd, none):
    kept = drop_similar(odd)
    assert kept.columns == odd.columns and drop_similar(none).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert ids and len(ids) == len(set(ids))


def test_prefix_is_as_long_as_needed():
    none = np.zeros(0, np.uint64)
    for n in range(1, 60):
        s = shingle_set(" ".join(f"x{i}" for i in range(n + 4)).encode())
        assert len(s) == n and len(prefix(s, none, none)) == n - -(-4 * n // 5) + 1
        common = np.sort(s[::2])
        head = prefix(s, common, np.arange(len(common)))
        assert len(head) == len(set(head.tolist())) == n - -(-4 * n // 5) + 1


def test_parity_maps_never_part_similar_sets():
    rng = np.random.default_rng(3)
    for n in (1, 2, 16, 17, 200, 5000, 100_000):
        a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        for changed in sorted({0, n // 20, n // 9, n // 6, n // 2}):
            b = np.unique(np.r_[a[changed:], rng.integers(0, 2 ** 63, changed // 2, dtype=np.uint64)])
            if not len(b):
                continue
            both, size = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            x, y = (similar._matrix([parity_map(s)]) for s in (a, b))
            assert x.shape[1] <= similar.WIDEST
            close = similar._close(x, y, np.array([len(a)], np.int32), np.array([len(b)], np.int32))[0]
            assert close or 5 * both < 4 * size
            if n >= 200 and changed == n // 2:
                assert not close


def test_texts_outside_the_large_component_of_a_posting(spark, monkeypatch):
    """Chains of edits: many texts are far from the leader, near to a neighbour; others share the common part only."""
    monkeypatch.setattr(similar, "FEW", 4)
    monkeypatch.setattr(similar, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"k{i}" for i in range(120)]
    texts, now = [], list(base)
    for _ in range(60):
        texts.append(" ".join(now))
        at = rng.randrange(len(now))
        now = now[:at] + [f"z{rng.randrange(10 ** 6)}"] + now[at + 1:]
    texts += [" ".join(base[:rng.choice([60, 70, 80])] + [f"y{rng.randrange(10 ** 6)}" for _ in range(rng.randint(5, 60))])
              for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    kept = drop_similar(spark.createDataFrame(rows, DOC).repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_brute_force(rows)
