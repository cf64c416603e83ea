import random
import shutil

import pyarrow as pa

import corpus_pipeline
from facetframe.llm import tokens
from facetframe.llm.queries import QUERIES, SQL, public_tokenizer
from facetframe.llm.simhash import simhash_components


def test_stages_follow_from_each_other(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
        kept.append(docs.count())
        if k == 1:                                      # what is left has no near-duplicates
            assert simhash_components(docs).where("doc_id <> component_id").count() == 0
    assert kept[1] > kept[2] > kept[3] and kept[4] == kept[5] > 0
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_near_duplicates_go_by_simhash_then_by_sets(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{rng.randrange(9999)}" for _ in range(400)]
    far = words[:200] + ["changed"] + words[201:]                   # alike as a set of shingles
    short = ["a b c d e f g", "A b c  d e f g"]
    texts = [" ".join(words), " ".join(far), *short, "another text of some words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = []
    real = corpus_pipeline.without_copies
    monkeypatch.setattr(corpus_pipeline, "without_copies", lambda d: seen.append(real(d)) or seen[0])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    first = {r.doc_id for r in seen[0].collect()}
    roots = {r.component_id for r in simhash_components(docs).collect()}
    assert first == roots and kept <= first and kept == {0, 2, 4}


def test_workers_remember_nothing_after_the_token_files(spark, tmp_path, monkeypatch):
    path = shutil.copy(public_tokenizer(), tmp_path / "own.json")       # no other test's words are remembered under this name
    monkeypatch.setattr(corpus_pipeline, "public_tokenizer", lambda: str(path))

    def remembered(_):
        _, _, pieces, chunks = tokens._tokenizer(str(path))
        yield pa.RecordBatch.from_pydict({"n": [len(pieces) + len(chunks)]})

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids_crc32 for r in corpus_pipeline.token_files(spark, docs, "").collect()}
    assert spark.range(0, 8, 1, 8).mapInArrow(remembered, "n long").agg({"n": "sum"}).first()[0] == 0
    assert got == {r.doc_id: r.ids_crc32 for r in tokens.tokens_of(docs, public_tokenizer()).collect()}
