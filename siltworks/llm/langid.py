"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams of one to three letters of a language, words being set off
by a boundary mark. A document's own list is compared with each profile by the out-of-place
distance: the sum over its n-grams of how far their ranks are apart, or the greatest distance for
an n-gram that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import kernels as K
from .storage import arrow_batches

#: n-grams in a profile
TOP = 300
#: Profiles are kept for so many languages at most; more raise an error.
MOST_LANGUAGES = 1000
UNDETERMINED = "und"
#: A score is too low for a text of any learned language below this share of what all but ``FLOOR_TAIL`` of the
#: labelled texts reach; scores are counted in so many steps.
FLOOR_SHARE, FLOOR_TAIL, SCORE_STEPS = 0.5, 0.01, 10_000

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Each code point's value in an n-gram: itself if it is a letter, else the boundary mark 1."""
    global _letters
    if _letters is None:
        _letters = np.array([c if chr(c).isalpha() else 1 for c in range(0x110000)], np.uint32)
    return _letters


def grams(text: str | None) -> np.ndarray:
    """All n-grams of a text as integers of three 21-bit letters; none if it has no letter."""
    if not text:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    x = _letter_table()[codes].astype(np.uint64)
    x = np.concatenate(([np.uint64(1)], x, [np.uint64(1)]))
    x = x[np.concatenate(([True], (x[1:] != 1) | (x[:-1] != 1)))]
    if len(x) < 3:
        return np.zeros(0, np.uint64)
    one, two, three = x, x[:-1] | x[1:] << np.uint64(21), x[:-2] | x[1:-1] << np.uint64(21) | x[2:] << np.uint64(42)
    return np.concatenate((one[one != 1], two, three[x[1:-1] != 1]))


def ranked(all_grams: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by value."""
    value, count = np.unique(all_grams, return_counts=True)
    return value[np.lexsort((value, -count))[:top]]


class Profiles:
    """Ranked n-grams of each language, ready for comparison."""

    def __init__(self, ranks: dict[str, list[int]]) -> None:
        self.names = sorted(ranks)
        self.sorted, self.rank = [], []
        for name in self.names:
            value = np.array(ranks[name], np.uint64)
            order = np.argsort(value)
            self.sorted.append(value[order])
            self.rank.append(order)

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.arange(len(own))
        out = np.empty(len(self.names), np.int64)
        for k, (value, rank) in enumerate(zip(self.sorted, self.rank, strict=True)):
            if not len(value):
                out[k] = TOP * len(own)
                continue
            i = np.minimum(np.searchsorted(value, own), len(value) - 1)
            out[k] = np.where(value[i] == own, np.abs(rank[i] - at), TOP).sum()
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(grams(text))
        if not len(own) or not self.names:
            return UNDETERMINED, 0.0
        d = self.distances(own)
        best = int(np.argmin(d))
        return self.names[best], float(1 - d[best] / (TOP * len(own)))


def _labelled(docs: DataFrame) -> DataFrame | None:
    """The documents with lang and text, or nothing if there are none."""
    labelled = docs.where("lang is not null and text is not null")
    languages = labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return labelled if languages else None


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each language's n-grams in ``lang, text``, a quarter of a megabyte at a time: n-grams and their sorting take over fifty bytes a character."""
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), object)
        _, offsets = K.text_buffer(batch.column("text"))
        for first, last in K.slices(offsets):
            text, names = batch.column("text")[first:last].to_pylist(), lang[first:last]
            for name in sorted(set(names)):
                value, n = np.unique(np.concatenate([grams(text[i]) for i in np.flatnonzero(names == name)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def learn(labelled: DataFrame, top: int = TOP) -> Profiles:
    """Profiles from all of ``labelled(doc_id, text, lang)``; rows without lang or text are left out.

    n-grams are counted where the documents are, in bounded memory; only ``top`` rows a language reach the driver.
    """
    labelled = _labelled(labelled)
    if labelled is None:
        return Profiles({})

    counts = labelled.select("lang", "text").mapInArrow(K.tidy(_counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "gram", "rank")
    with arrow_batches(labelled.sparkSession):
        rows = rows.collect()
    ranks: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r["rank"])):
        ranks.setdefault(r.lang, []).append(r.gram)
    return Profiles(ranks)


def least_score(labelled: DataFrame, profiles: Profiles) -> float:
    """The score below which a text is in none of the learned languages; 0 if none was learned.

    It is ``FLOOR_SHARE`` of what all but ``FLOOR_TAIL`` of the labelled documents reach. All their scores are counted, each rounded down to one of
    ``SCORE_STEPS``, and the tail is read off the counts.
    """
    labelled = _labelled(labelled)
    if labelled is None:
        return 0.0
    scores = predict(labelled.select("text"), profiles).where(F.col("lang_pred") != UNDETERMINED)
    steps = scores.groupBy(F.floor(F.col("score") * SCORE_STEPS).alias("step")).agg(F.count("*").alias("n"))
    total = steps.agg(F.sum("n")).first()[0]
    if not total:
        return 0.0
    upto = F.sum("n").over(Window.orderBy("step"))  # over SCORE_STEPS + 1 rows at most
    step = steps.withColumn("upto", upto).where(F.col("upto") >= max(1.0, FLOOR_TAIL * total)).agg(F.min("step")).first()[0]
    return FLOOR_SHARE * step / SCORE_STEPS


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (1: equal ranks, 0: nothing in common).

    The prediction reads ``text`` only, so rows that repeat a text get the same. Null texts and texts without a letter give
    ``und`` and 0, as does every text if no language was learned. Languages at the same distance: the first by
    name. Columns of those names that came in are replaced, all others pass through. An empty table gives no rows.
    """
    plain = docs.drop("lang_pred", "score")
    schema = StructType([*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return plain.mapInArrow(K.tidy(run), schema)


def held_out(doc_id="doc_id"):
    """Documents that profiles are never learned from; a null id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs(doc_id, text, lang)``.

    Profiles come from rows with an id that are not held out and have a lang. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    profiles = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
