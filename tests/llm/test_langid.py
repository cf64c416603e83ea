from facetframe.llm.langid import UNKNOWN, Judge, identify_languages, judge_of, keep_languages, profiles
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert got.where("score < 0 OR score > 1").count() == 0


def test_profiles_equal_a_plain_count(spark):
    rows = [("en", "The cat. the hat"), ("en", "a cat"), ("de", "Die Katze")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    got = {(r.label, r.gram): r.n for r in profiles(df, F.col("text"), F.col("lang")).collect()}

    def code(s):
        n = 0
        for c in s:
            n = n << 20 | (0 if c == " " else ord(c))
        return n | len(s) << 60

    want = {}
    for lang, text in rows:
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        flat = " " + " ".join(words) + " "
        for n in (1, 2, 3):
            for i in range(len(flat) - n + 1):
                g = flat[i:i + n]
                if not (n == 1 and g == " ") and not (n == 3 and g[1] == " "):
                    want[lang, code(g)] = want.get((lang, code(g)), 0) + 1
    assert got == want


def test_nulls_ties_and_empty_tables(odd, odd_rows, none):
    got = {}
    for r in identify_languages(odd).collect():
        got.setdefault(r.doc_id, r)
    assert all(got[i].lang_pred == UNKNOWN and got[i].score == 0 for i in (0, 1, 2, 3))
    assert got[10].lang_pred == "de" and got[9].lang_pred == "de"
    assert identify_languages(odd).count() == len(odd_rows)
    assert identify_languages(none).count() == 0
    assert judge_of(profiles(none, F.col("text"), F.col("lang")))("words") == (UNKNOWN, 0.0)
    rows = [("b", 1 << 60 | ord("x"), 0, 1), ("a", 1 << 60 | ord("x"), 0, 1)]
    assert Judge(rows)("x")[0] == "a"


def test_stage_keeps_text_in_a_language(odd, none):
    kept = keep_languages(odd, 0.3)
    assert kept.columns == odd.columns
    assert {0, 1, 2, 3}.isdisjoint({r.doc_id for r in kept.collect()})
    assert {5, 6, 9, 10} <= {r.doc_id for r in kept.collect()}
    assert keep_languages(none, 0.3).count() == 0
