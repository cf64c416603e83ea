import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from facetframe.llm.queries import public_tokenizer
from facetframe.llm import tokens
from facetframe.llm.tokens import Codes, encode_codes, encode_texts, segments, token_at, token_digests, tokens_of, write_tokens


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2 ** 32 - 1], list(range(0, 70000, 7)), [5] * 3000])
def test_codes_round_trip_and_random_access(ids):
    codes = Codes(encode_codes(np.array(ids, dtype=np.uint32)))
    assert len(codes) == len(ids) and codes.slice(0, len(ids)).tolist() == ids
    rng = random.Random(1)
    for i in rng.sample(range(len(ids)), min(50, len(ids))):
        n = rng.randint(0, len(ids) - i)
        assert codes[i] == ids[i] and codes.slice(i, n).tolist() == ids[i:i + n]


def test_pieces_give_the_ids_of_whole_texts(spark):
    tokenizer = Tokenizer.from_file(public_tokenizer())
    rng = random.Random(2)
    alphabet = ["a", "Zz", " ", "  ", "\n", "\t", "'", "'s", "'ll", "!", ".", "_", "1", "½", "é", "é", "ß", "雪", "\U0001f600",
                " ", " ", "　", "\x1c", "\x85", "<|endoftext|", "-"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    words = ["ab", "Été", "don't", "x1", "2²", "½a", "a_b", "end.", "«quote»", "ß!", "Ωmega", "a\xadb", "雪,", "'s", "", "@@", "ªº", "ɐ", "\x7f"]
    texts += [sep.join(rng.choice(words) for _ in range(rng.randint(1, 12))) + end for sep in (" ", "\n") for end in ("", "\n", " ") for _ in range(300)]
    texts += [rng.choice(words) + "".join(rng.choice((" ", " ", " ", "\n")) + rng.choice(words[:14]) for _ in range(30)) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    tokenizer.encode_special_tokens = True
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encode_texts(texts, public_tokenizer())] == want


def test_a_word_is_remembered_once(spark):
    tokenizer = Tokenizer.from_file(public_tokenizer())
    texts = ["quixotry, and quixotry; 'quixotry' (quixotry) na\u00efvet\u00e9 x2y2 42nd --quixotry-- don't 7", "naïveté quixotry,\nquixotry 7up ..."]
    tokens._tokenizer.cache_clear()
    assert [x.tolist() for x in encode_texts(texts, public_tokenizer())] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    _, _, pieces, chunks = tokens._tokenizer(public_tokenizer())
    assert {"quixotry", "na\u00efvet\u00e9", "7"} <= set(chunks)
    assert not {" " + c for c in chunks} & set(pieces)


def test_files(spark, odd, odd_rows, none, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(odd, path, public_tokenizer())
    tokenizer = Tokenizer.from_file(public_tokenizer())
    got = sorted(token_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows), key=lambda i: (i is not None, i))
    want = sorted((r[0] is not None, r[0] or 0, zlib.crc32(np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0], dtype="<u4").tobytes()))
                  for r in odd_rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    flat = np.concatenate([Codes(s.codes).slice(0, sum(s.lengths)) for s in sorted(segments(spark, path).collect(), key=lambda s: s.start)])
    asked = spark.createDataFrame([(p,) for p in range(0, at, 97)], "position long")
    assert {r.position: r.token for r in token_at(spark, path, asked).collect()} == {p: int(flat[p]) for p in range(0, at, 97)}
    assert tokens_of(none, public_tokenizer()).count() == 0


def test_special_tokens_in_a_text_are_ids_of_their_own(spark):
    tokenizer = Tokenizer.from_file(public_tokenizer())
    texts = ["before<|endoftext|>after", "<|endoftext|>", "no token", "", " <|endoftext|>\n<|endoftext|> x<|endoftext|", "<|endoftext|"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0] and [x.tolist() for x in encode_texts(texts, public_tokenizer())] == want
    rows = tokens_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public_tokenizer()).collect()
    assert {r.doc_id: (r.start, r.n_tokens) for r in rows} == {
        i: (sum(len(w) + 1 for w in want[:i]), len(w) + 1) for i, w in enumerate(want)}
