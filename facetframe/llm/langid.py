"""Language identification by rank-order profiles of character n-grams (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col

#: n-grams in a profile, and so the distance of one that is missing.
PROFILE = 400
#: n-grams of 1 to 3 characters; a word's start and end count as a blank.
UNKNOWN = "und"
#: Profiles are held by every task: so many languages of PROFILE n-grams each at most.
MOST_LANGUAGES = 2_000
#: n-grams a task holds before it hands its counts on.
HELD = 400_000


@cache
def _letters() -> np.ndarray:
    """Which code points are letters; all of them lie below 2^18."""
    return np.array([chr(c).isalpha() for c in range(1 << 18)])


def grams(text: str) -> np.ndarray:
    """The codes of all n-grams of a text, repeats included: 20 bits a character, above them the length."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = (points < 1 << 18)
    letter[letter] = _letters()[points[letter]]
    c = np.zeros(len(points) + 2, dtype=np.int64)
    c[1:-1][letter] = points[letter]
    c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
    one, two = c[c != 0] | 1 << 60, c[:-1] << 20 | c[1:] | 2 << 60
    three = (c[:-2] << 40 | c[1:-1] << 20 | c[2:] | 3 << 60)[c[1:-1] != 0]
    return np.concatenate([one, two, three]) if len(one) else one


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, back = np.unique(np.concatenate(codes), return_inverse=True)
    return u, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def gram_counts(docs: DataFrame, text: Column, label: Column) -> DataFrame:
    """(label, gram, n): the n-grams of all labelled texts; every task adds up its own before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                codes, counts = _merged(*parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes), pa.array(counts)],
                                                 names=["label", "gram", "n"])

        size = 0
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1)):
                codes, counts = np.unique(grams(t.as_py()), return_counts=True)
                if not len(codes):
                    continue
                parts = held.setdefault(name.as_py(), ([], []))
                parts[0].append(codes)
                parts[1].append(counts)
                size += len(codes)
                if size > HELD:
                    held = {k: tuple([x] for x in _merged(*v)) for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > HELD // 2:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    return (docs.select(text.alias("text"), label.cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
            .mapInArrow(run, "label string, gram long, n long")
            .groupBy("label", "gram").agg(F.sum("n").alias("n")))


def profiles(docs: DataFrame, text: Column, label: Column) -> DataFrame:
    """(label, gram, place, n): the PROFILE most frequent n-grams per label, ties to the smaller code."""
    best = Window.partitionBy("label").orderBy(F.desc("n"), "gram")
    return gram_counts(docs, text, label).withColumn("place", F.row_number().over(best) - 1).where(
        F.col("place") < PROFILE)


class Judge:
    """Profiles as arrays: the language of a text by the smallest out-of-place distance."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.labels = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.places = np.full((len(self.grams) + 1, len(self.labels)), PROFILE, dtype=np.int32)   # last row: in no profile
        if rows:
            at = np.searchsorted(self.grams, np.array([r[1] for r in rows], dtype=np.int64))
            number = {label: i for i, label in enumerate(self.labels)}
            self.places[at, [number[r[0]] for r in rows]] = [r[2] for r in rows]

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes, counts = np.unique(grams(text or ""), return_counts=True)
        if not len(codes) or not self.labels:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, codes)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != codes] = len(self.grams)
        places = self.places[at]
        order = np.lexsort((codes, places.min(axis=1), -counts))[:PROFILE]     # equally frequent: as in the profiles
        places = places[order]
        far = np.where(places == PROFILE, PROFILE, np.abs(places - np.arange(len(order))[:, None]))
        total = far.sum(axis=0)
        best = int(total.argmin())
        return self.labels[best], float(1 - total[best] / (PROFILE * len(order)))


def judge_of(learned: DataFrame) -> Judge:
    """Bring profiles to the driver: at most MOST_LANGUAGES times PROFILE short rows, else an error."""
    rows = learned.select("label", "gram", "place", "n").limit(MOST_LANGUAGES * PROFILE + 1).collect()
    if len(rows) > MOST_LANGUAGES * PROFILE:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return Judge([tuple(r) for r in rows])


def predict(df: DataFrame, text: Column, judge: Judge, keep: list[Column]) -> DataFrame:
    """``keep`` columns, lang_pred and score of each row; one pass, no shuffle.

    Null text and text without a letter are ``und`` with score 0, as is everything if no language was learned.
    Equal distances go to the smaller language name. Whole texts count, whatever their length.
    """
    slim = df.select(*keep, text.alias("__text"))
    held = df.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return slim.mapInArrow(run, slim.drop("__text").schema.add("lang_pred", "string").add("score", "double"))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    learned = profiles(docs.where(~held_out(id_col)), col(text), col(label))
    return predict(docs, col(text), judge_of(learned), [col(id_col).alias("doc_id"), held_out(id_col).alias("held_out")])


def keep_languages(docs: DataFrame, least_score: float, id_col: str = "doc_id", text: str = "text",
                   label: str = "lang") -> DataFrame:
    """The rows whose text is in some language: not ``und``, and near enough to the language's profile."""
    learned = profiles(docs.where(~held_out(id_col)), col(text), col(label))
    judged = predict(docs, col(text), judge_of(learned), [F.struct(*[col(c) for c in docs.columns]).alias("__row")])
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("__row.*")
