"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, tokens.

Each stage is one operator of ``facetframe.llm`` with its production parameters over all rows the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetframe.llm.decontaminate import drop_leaks
from facetframe.llm.langid import keep_languages
from facetframe.llm.mixing import mix
from facetframe.llm.queries import public_tokenizer
from facetframe.llm.similar import drop_similar
from facetframe.llm.simhash import without_copies
from facetframe.llm.tokens import tokens_of
from facetframe.session import shared_folder, ship_package

#: A text whose n-grams lie further from every learned profile than this is in no language.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; null texts, texts without a letter and texts unlike any profile go."""
    ship_package(spark)
    return keep_languages(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component, then of each group of exactly similar ones among these.

    Fingerprints link at 3 or fewer differing bits, as in ``op1_simhash``; 64 bits miss light edits, so an exact check
    follows: documents that have 4/5 of their five-word shingles in common.
    """
    ship_package(spark)
    return drop_similar(without_copies(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    ship_package(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; repeats are rows of their own."""
    ship_package(spark)
    return mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from the token files.

    Other stages use the same Python workers, so these remember nothing after a task.
    """
    ship_package(spark)
    return tokens_of(docs, public_tokenizer(), lean=True)


STAGES = [("language_id", language_id), ("simhash_near_duplicates", near_duplicates),
          ("benchmark_decontamination", decontamination), ("source_mixing", mixing), ("token_files", token_files)]
#: Models, hashes and tokenizers have no SQL form; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_folder(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
