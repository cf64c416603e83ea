import itertools

import numpy as np

from facetframe.llm import ann
from facetframe.llm.ann import BITS, hilbert, nearest
from pyspark.sql import functions as F

VECTOR = "vec_id long, embedding array<float>, rank int, v string"


def brute(rows, k):
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    use = list({(i, tuple(v)): (i, v) for i, v in use}.values())
    out = {}
    for q, v in use:
        if q % 20 == 0:
            out[q] = sorted((-float(np.float32(v).astype(float) @ np.float32(w).astype(float)), i) for i, w in use if i != q)[:k]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(12) * (1 + i % 5)]) for i in range(300)]
    rows += [(300 + i, [1.0] * 12) for i in range(90)] + [(400, None), (420, [0.0] * 12), (440, [None] + [1.0] * 11),
             (460, [float("nan")] * 12), (480, [float("inf")] * 12), (None, [1.0] * 12), (500, [1.0] * 3), rows[20], rows[21]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTOR).repartition(3)
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, curves=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute([(i, v) for i, v in rows if i != 500], 20)
    assert set(got) == set(want)
    for q, hits in want.items():
        have = sorted(got[q])
        assert [h[0] for h in have] == list(range(1, 21)) and [h[1] for h in have] == [i for _, i in hits]
        assert np.allclose([h[2] for h in have], [-s for s, _ in hits], rtol=1e-12)


def test_few_and_none(spark):
    rows = [(20, [1.0, 2.0], 1, "x"), (40, [1.0, 2.0], 1, "x"), (3, [2.0, 1.0], 1, "x")]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(spark.createDataFrame(rows, VECTOR), F.col("vec_id") % 20 == 0, curves=2).collect())
    assert got == [(20, 1, 40), (20, 2, 3), (40, 1, 20), (40, 2, 3)]
    assert nearest(spark.createDataFrame([], VECTOR), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)             # so that windows are a part of the table
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    got = {}
    for r in nearest(docs, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist()))
        total += 20
    assert hits / total >= 0.9


def test_hilbert_steps_to_neighbours():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    key = hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    assert BITS * ann.DIMS < 63
