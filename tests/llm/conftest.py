import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, row string, shard map<string,int>"
WORDS = {"en": "the of and to in is that for with was on are as have from they this but had not what were when".split(),
         "de": "der die und das nicht ein ich auf mit sich dem für ist werden eine über wird auch nach wie sind".split()}


def prose(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang]) + (rng.choice("aeiou") if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and long texts, copies, repeated rows and null sources; extra columns clash."""
    rng = random.Random(3)
    base, long = prose(rng, 150), prose(rng, 20_000, "de")
    texts = [None, "", "   ", "12 34 --", "Yes.", base, base, base + " ending", base.replace(" the ", " a ", 1), long, long,
             prose(rng, 40), prose(rng, 60, "de"), prose(rng, 90), prose(rng, 90, "de"), "naïve ☃ 雪 \U0001f600 text", "the and"]
    rows = [(i, t, None if i % 4 == 0 else "de" if i in (9, 10, 12, 14) else "en", [None, "a", "b", "ü"][i % 4], None, 1, 0.5, "x", {"k": i}) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base, "en", "a", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
