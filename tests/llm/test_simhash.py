import random
from collections import Counter

import xxhash

from facetframe.llm import components as components_module
from facetframe.llm import simhash
from facetframe.llm.components import components
from facetframe.llm.simhash import drop_near_duplicates, fingerprint, near_links, simhash_components


def plain_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Root per distinct fingerprint, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    listed = sorted(root)
    for i, a in enumerate(listed):
        for b in listed[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    return {p: find(p) for p in listed}


def test_fingerprint_equals_the_definition(odd_rows):
    for r in odd_rows:
        assert fingerprint(r[1].encode() if r[1] else r[1]) == plain_print(r[1])


def test_components_of_documents(odd, odd_rows, none):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(odd).collect())
    prints = [plain_print(r[1]) for r in odd_rows]
    root = plain_components(prints)
    least = {}
    for r, p in zip(odd_rows, prints):
        if r[0] is not None:
            least[root[p]] = min(r[0], least.get(root[p], r[0]))
    assert got == Counter((r[0], f"{p:016x}", least[root[p]]) for r, p in zip(odd_rows, prints))
    assert simhash_components(none).count() == 0


def test_one_document_of_each_group_stays(odd, none):
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    groups = {r.component_id for r in simhash_components(odd).collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == groups
    assert drop_near_duplicates(none).count() == 0


def test_crowded_postings_lose_no_link(spark, monkeypatch):
    """A cloud of near fingerprints, chains and strangers, with postings divided at every size."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 300:
        p = centre
        for b in rng.sample(range(24), rng.randint(0, 6)):
            p ^= 1 << b
        prints.add(p)
    at = rng.getrandbits(64)
    for _ in range(60):                          # a chain, three bits a step
        for b in rng.sample(range(64), 3):
            at ^= 1 << b
        prints.add(at)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    want = plain_components(list(prints))
    sizes = Counter(want.values())
    for most in (2_000, 20):
        monkeypatch.setattr(simhash, "POSTING", most)
        found = {r.node: r.root for r in components(near_links(df)).collect()}
        groups = Counter(found.values())
        assert sorted(groups.values()) == sorted(n for n in sizes.values() if n > 1)
        for a, b in zip(sorted(prints), sorted(prints)[1:]):
            if want[a] == want[b]:
                assert found[signed[a]] == found[signed[b]]


def test_planes_cover_every_way_to_differ():
    from itertools import combinations
    assert len(simhash.PLANES) == 14
    assert all(any(not set(p) & set(d) for p in simhash.PLANES) for d in combinations(range(8), 3))


def test_rows_without_copies_are_the_first_of_their_components(odd, none):
    kept = simhash.without_copies(odd)
    assert kept.columns == odd.columns and simhash.without_copies(none).count() == 0
    got = sorted(set(map(str, kept.collect())))
    assert got == sorted(map(str, simhash.drop_near_duplicates(odd).collect()))


def test_components_of_few_links_take_no_rounds(spark, monkeypatch):
    """Chains, rings and stars: the same components in one task, through stars, and through stars until few links are left."""
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(-40, 40)] + [(100 + i, 100 + (i + 1) % 30) for i in range(30)] + [(500, 500 + i) for i in range(50)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7), (9000, 9000)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    rounds = []
    star = components_module._star
    monkeypatch.setattr(components_module, "_star", lambda *a, **b: rounds.append(1) or star(*a, **b))
    got = {}
    for few in (100_000, 0, 150):
        monkeypatch.setattr(components_module, "FEW_LINKS", few)
        got[few] = sorted(map(tuple, components(df).collect()))
        assert bool(rounds) == (few < 100_000)
    assert got[100_000] == got[0] == got[150] and len({r for _, r in got[0]}) > 3
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()
