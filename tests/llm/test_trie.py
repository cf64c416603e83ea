import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from facetframe.llm import trie
from facetframe.llm.trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, one map<string,int>"


def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", x or ""))
    built = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 4, sorted(convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), []))
        built[c] = tuple((r, x) for _, r, x in base[:h] + sorted(own)[h:])
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids.update(k[:-1] for k in members if k)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
            leaves[k[:d]] += not kids[k]
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(
        ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest()) for k, m in members.items())


def conversations(seed, n, vocabulary, length):
    """Conversations with few different turns, missing bases, gaps, ties, nulls, repeated rows and negative ids."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), n):
        for t in range(rng.randint(1, length)):
            rows.append((c, rng.choice([t, t, t, 0, None]), rng.choice(["user", "assistant", None]) if t else "system",
                         rng.choice(vocabulary) if t else "you are helpful", "x", 1, {"k": 1}))
    rows += [rows[3]] * 3 + [(None, 1, "user", "no conversation", None, None, None)]
    return rows


def result(spark, rows, **options):
    return Counter(map(tuple, conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()))


@pytest.mark.parametrize("seed,n,vocabulary,length", [(1, 120, ["yes", "no", "", None, "a b  c\td"], 6), (2, 60, ["yes " * 40, "no"], 3)])
def test_nodes_equal_brute_force(spark, seed, n, vocabulary, length):
    rows = conversations(seed, n, vocabulary, length)
    assert result(spark, rows) == brute(rows)


def test_equal_conversations_a_long_one_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    monkeypatch.setattr(trie, "HOT", 20)                    # many nodes count as hot
    rows = [(c, t, "user", f"turn {t}", None, None, None) for c in range(90) for t in range(4)]
    rows += [(500, t, "user", f"turn {t % 3}", None, None, None) for t in range(150)]
    assert result(spark, rows) == brute(rows)


def test_clashing_fingerprints_get_more_lanes(spark):
    rows = conversations(3, 40, ["yes", "no", "maybe"], 4)
    turns = trie._turns(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text")
    assert trie._clashes(trie._members(turns, 1, 3), turns)
    assert result(spark, rows, lanes=1, prime=251) == brute(rows)


def test_no_conversations(spark):
    assert not result(spark, [])
    assert not result(spark, [(None, 1, "user", "x", None, None, None)])
