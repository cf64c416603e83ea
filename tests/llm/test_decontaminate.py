import re

from facetframe.llm.decontaminate import drop_leaks, find_leaks, sketches

ITEM = "item_id long, text string, doc_id long"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pairs_equal_brute_force(spark, odd, odd_rows, none):
    text = next(r[1] for r in odd_rows if r[0] == 10)
    part = " ".join(text.split()[5000:5040])
    broken = part.split()
    broken[20] = "changed"                                       # 31 of 36 shingles stay
    items = [(1, part.upper().replace(" ", ", "), 1), (2, " ".join(broken), 1), (3, None, 1), (4, "", 1), (5, "yes", 1),
             (6, " ".join(part.split()[:20] + ["other"] * 15), 1), (7, "the and", 1), (8, part, 2), (8, "nothing of it", 2)]
    got = {(r["__id"], r.item): (r.matched, r.n_shingles) for r in find_leaks(odd, spark.createDataFrame(items, ITEM)).collect()}
    want = {}
    for d in odd_rows:
        for i, t, _ in items:
            q, have = shingles(t), shingles(d[1])
            if q and len(q & have) >= 0.8 * len(q):
                want[d[0], i] = (len(q & have), len(q))
    assert got == want and {(10, 1), (10, 2), (4, 5), (16, 7), (10, 8)} <= set(want) and (10, 6) not in want
    kept = drop_leaks(odd, spark.createDataFrame(items, ITEM))
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(
        (d[0] is None, d[0] or 0) for d in odd_rows if not any(x == d[0] for x, _ in want))
    assert find_leaks(none, spark.createDataFrame(items, ITEM)).count() == 0
    assert drop_leaks(odd, spark.createDataFrame([], ITEM)).count() == len(odd_rows)


def test_sketch_is_long_enough(spark):
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n)), 0) for n in (5, 6, 9, 14, 40, 69, 200)]
    sizes = {r.item: r["count"] for r in sketches(spark.createDataFrame(items, ITEM), "item_id", "text").groupBy("item").count().collect()}
    for n, _, _ in items:
        q = n - 4
        assert sizes[n] > q - -(-q * 4 // 5)                        # one more than may be missing
