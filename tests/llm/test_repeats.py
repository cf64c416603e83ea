import hashlib
import random
import re
from collections import Counter

import pytest

from facetframe.llm import repeats
from facetframe.llm.repeats import LEAST, block_repeats, remove_repeats, repeat_digest, units


def brute(texts):
    """(n_bytes, n_removed, n_spans, digest of the rest) per text."""
    seen = Counter(t[i:i + LEAST] for t in texts for i in range(len(t) - LEAST + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - LEAST + 1):
            if seen[t[i:i + LEAST]] > 1:
                mask[i:i + LEAST] = b"\1" * LEAST
        runs = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        out.append((len(t), sum(mask), runs, hashlib.sha256(bytes(b for b, m in zip(t, mask) if not m)).hexdigest()))
    return out


def corpus(rng):
    alpha = "abcdefghij klmnop é\n"
    some = lambda n: "".join(rng.choice(alpha) for _ in range(n))          # noqa: E731
    passage, line = some(430), some(120)
    texts = [some(rng.randint(0, 900)) for _ in range(10)]
    texts += [some(rng.randint(0, 300)) + passage + some(rng.randint(0, 300)) for _ in range(12)]
    texts += [some(200) + line + some(200) for _ in range(12)]
    whole = some(1500)
    texts += [whole, whole] + [whole[:k] + "#" + whole[k + 1:] for k in (10, 700, 701, 1100, 1490)]
    texts += ["a" * 399, "a" * 400, "a" * 401, "b" * 900, ("cd" * 300), some(50) * 20, some(LEAST - 1), passage[:399], "", None]
    return texts


@pytest.mark.parametrize("most", [1_000, 2])
def test_equal_to_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_TEXTS", most)
    texts = corpus(random.Random(11))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, key int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_digest(remove_repeats(docs)).collect()}
    want = brute([(t or "").encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want


def test_nulls_copies_and_empty_tables(odd, odd_rows, none):
    got = Counter(tuple(r)[1:] for r in repeat_digest(remove_repeats(odd)).collect())
    assert got == Counter(brute([(r[1] or "").encode() for r in odd_rows]))
    assert remove_repeats(none).count() == 0


def test_block_search():
    rng = random.Random(4)
    texts = [t.encode() for t in corpus(rng) if t and len(t.encode()) >= LEAST]
    seen = Counter(t[i:i + LEAST] for t in texts for i in range(len(t) - LEAST + 1))
    owned = [len(t) - LEAST + 1 for t in texts]
    for t, hit in zip(texts, block_repeats(texts, owned, [1] * len(texts))):
        assert hit.tolist() == [seen[t[i:i + LEAST]] > 1 for i in range(len(hit))]
    assert block_repeats(texts[:1], owned[:1], [2])[0].all()


def test_units_depend_on_the_text_alone():
    rng = random.Random(6)
    text = bytes(rng.choice(b"abc ") for _ in range(3000))
    key = {}
    for offset in (0, 1, 77):
        start, owned, lead, keys = units(bytes(offset) + text)
        assert owned.sum() == len(text) + offset - LEAST + 1
        for s, n, far, k in zip(start.tolist(), owned.tolist(), lead.tolist(), keys.tolist()):
            for i in range(max(s, offset), s + n):
                assert key.setdefault(i - offset, (k, s + far - i)) == (k, s + far - i)


def test_texts_are_shuffled_once(spark):
    """Joins by row bring the units to the texts; before, every join shuffled all texts again."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(random.Random(2)))], "doc_id long, text string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    plan = remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Scan ExistingRDD\[[^\n]*packed", plan) and spark.conf.get("spark.sql.adaptive.enabled") == before
    assert not re.search(r"Exchange[^\n]*\n[^\n]*Scan ExistingRDD\[[^\n]*packed", plan)
