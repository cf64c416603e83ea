import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from facetframe.llm import alignment
from facetframe.llm.alignment import align_tokenizers, merge_runs, pair_counts
from facetframe.llm.queries import public_tokenizer

A, B = public_tokenizer(), public_tokenizer("piece_bpe_32k.model")


def links_of(text, a, b):
    """Ids, groups and links of a text by the definition, all pairs of a group compared."""
    if not text:
        return [], [], [], []
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in kept} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in kept)}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], [], []
    ends_a, ends_b = (np.cumsum(list(map(len, x))).tolist() for x in (bytes_a, bytes_b))
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        to_a, to_b = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, ids_a[i:to_a])) + "|" + ",".join(map(str, ids_b[j:to_b])))
        links += [(ids_a[u], ids_b[v]) for u in range(i, to_a) for v in range(j, to_b)
                  if ends_a[u] - len(bytes_a[u]) < ends_b[v] and ends_b[v] - len(bytes_b[v]) < ends_a[u]]
        i, j = to_a, to_b
    return ids_a, ids_b, groups, links


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    found = [(i, *links_of(t, a, b)) for i, t in rows]
    counts = Counter(pair for *_, links in found for pair in set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return Counter((i, len(x), len(y), len(g), len(l), sum(counts[p] == best[p[0]] for p in l), sum(counts[p] for p in l),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for i, x, y, g, l in found), counts, best


TEXTS = ["a  b", " lead", "trail ", "line\nnext\n\nmore", "<|endoftext|> x", "<s> </s> <0x41>", "▁ not given back", "tab\tand 12,345.67",
         "don't we'll", "雪が降る \U0001f600 naïve café", "é", "\n", " ", "\x00 null", "x" * 300]


@pytest.fixture(scope="module")
def odd_texts(odd_rows):
    short = [(i, t if t is None else t[:1500]) for i, t, *_ in odd_rows]
    return short + [(100 + k, t) for k, t in enumerate(TEXTS)]


@pytest.mark.parametrize("run,remembered", [(alignment.RUN, alignment.REMEMBERED), (300, 50)])
def test_documents_equal_brute_force(spark, odd_texts, run, remembered, monkeypatch):
    monkeypatch.setattr(alignment, "RUN", run)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in odd_texts], "doc_id long, text string, run string, part int").repartition(3)
    want, counts, best = brute(odd_texts)
    assert Counter(map(tuple, align_tokenizers(docs, A, B).collect())) == want
    got = pair_counts(docs, A, B).collect()
    assert {(r.a, r.b): r.documents for r in got} == counts and len(got) == len(counts)
    assert all(r.best == (r.documents == best[r.a]) for r in got)


def test_chunks_may_be_forgotten(odd_texts):
    aligner = alignment.Aligner(A, B)
    texts = [t for _, t in odd_texts]
    first = list(aligner.documents(texts))
    aligner.forget()
    again = [next(iter(aligner.documents([t]))) for t in texts]
    assert all(x[:4] == y[:4] and x[4].tolist() == y[4].tolist() for x, y in zip(first, again))


def test_no_documents(spark, none):
    assert align_tokenizers(none, A, B).count() == 0


def test_merging_counts_pairs_over_runs():
    rng = np.random.default_rng(5)
    runs = []
    for n in (0, 1, 50, 400):
        codes = np.unique(rng.integers(0, 20, n) << 32 | rng.integers(0, 9, n))
        runs.append((codes, rng.integers(1, 5, len(codes))))
    counts, best = Counter(), defaultdict(int)
    for codes, holders in runs:
        counts.update(dict(zip(codes.tolist(), holders.tolist())))
    for code, n in counts.items():
        best[code >> 32] = max(best[code >> 32], n)
    for (codes, _), answer in zip(runs, merge_runs(runs)):
        assert answer.tolist() == [counts[c] << 1 | (counts[c] == best[c >> 32]) for c in codes.tolist()]
