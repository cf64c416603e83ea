import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from facetframe.llm.packing import cut_patterns, pack, packed_pieces, sequences
from facetframe.llm.queries import public_tokenizer


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 7), (3, 40), (4, 300), (5, 5000)])
def test_patterns_use_up_the_items_and_little_more_room(seed, n):
    rng = random.Random(seed)
    histogram = {}
    for _ in range(n):
        size = min(128, 1 + int(rng.expovariate(1 / 40)))
        histogram[size] = histogram.get(size, 0) + 1
    sizes, patterns = cut_patterns(histogram)
    used = sum(p * times for p, times in patterns)
    assert dict(zip(sizes.tolist(), used.tolist())) == histogram
    assert all(p @ sizes <= 128 for p, _ in patterns)
    least = -(-sum(s * k for s, k in histogram.items()) // 128)
    assert sum(times for _, times in patterns) <= least * 1.03 + 3


def test_no_items_and_one_class_only():
    assert cut_patterns({})[1] == []
    sizes, patterns = cut_patterns({100: 1000})
    assert sizes.tolist() == [100] and sum(times for _, times in patterns) == 1000


def expected(rows, tokenizer):
    return sorted((r[0] is not None, r[0] or 0, len(i), zlib.crc32(i.tobytes())) for r in rows for i in [np.array(
        tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0], dtype="<u4")])


def test_every_id_is_in_one_piece_and_sequences_have_no_gaps(spark, odd, odd_rows, none):
    tokenizer = Tokenizer.from_file(public_tokenizer())
    pieces, places = pack(odd, public_tokenizer())
    rows = pieces.join(places, ["part", "place"]).collect()
    docs, held, at = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r.part, r.place)):
        key = len(docs) if r.start == 0 else key
        docs.setdefault(key, (r.doc_id, []))[1].append(r.ids)
        assert r.start == sum(map(len, docs[key][1][:-1])) // 4 and r.length == len(r.ids) // 4
    got = sorted((i is not None, i or 0, len(b"".join(x)) // 4, zlib.crc32(b"".join(x))) for i, x in docs.values())
    assert got == expected(odd_rows, tokenizer)
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    assert sorted(held) == list(range(len(held)))
    for k, parts in held.items():
        at[k] = b"".join(p[2] for p in sorted(parts))
        assert [p[0] for p in sorted(parts)] == [sum(q[1] for q in sorted(parts)[:i]) for i in range(len(parts))]
        assert len(at[k]) <= 4096
    whole = sequences(pieces, places).collect()
    assert {r.sequence_id: bytes(r.ids) for r in whole} == at
    assert all(r.padded == (n if n & (n - 1) == 0 else 1024) for r in whole for n in [len(r.ids) // 4])
    assert packed_pieces(none, public_tokenizer()).count() == 0


def test_digests_of_pieces_and_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packed_pieces(docs, public_tokenizer()).collect()
    tokenizer = Tokenizer.from_file(public_tokenizer())
    ids = {r.doc_id: np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4") for r in docs.select("doc_id", "text").collect()}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
    assert sum(map(len, ids.values())) / (1024 * len({r.sequence_id for r in rows})) > 0.97
