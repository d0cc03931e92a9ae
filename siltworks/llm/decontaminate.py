"""Benchmark decontamination by winnowing.

Of every ``SPAN - GRAM + 1`` consecutive k-grams the one with the least hash is a fingerprint, so two
texts that share ``SPAN`` words always share the fingerprint of that span. Fingerprints of documents are
joined with those of the benchmark. A hit is then extended to each span around it: the span's words count only
if all ``SPAN`` of them stand in an item. Items of fewer words are one fingerprint of their own length.

The documents are read once for their fingerprints, whatever the benchmark's size. A bitmap of the benchmark's
fingerprints, whose size is bounded by ``MOST_BITS``, goes to all tasks, so that documents give away
only what may hit; a large benchmark fills the bitmap, and then the joins alone decide. Texts are named by two hashes
of 64 bits, so copies are looked up once, and hashes of fingerprint and span decide together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kernels as K
from .storage import materialise, release

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
#: bits of the bitmap for each fingerprint of the benchmark, and at most
BITS_EACH, MOST_BITS = 16, 1 << 27
_OTHER = np.uint64(0xA24BAED4963EE407)


def winnow(grams: np.ndarray) -> np.ndarray:
    """Least hash of each window of ``WINDOW`` k-grams; one value for each span of ``SPAN`` words."""
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return grams[:0]
    low = grams[:n]
    for j in range(1, WINDOW):
        low = np.minimum(low, grams[j : j + n])
    return low


def fingerprints(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of the span of ``n`` words from each position."""
    return winnow(K.gram_hash(hashes, GRAM)) if n == SPAN else K.gram_hash(hashes, n)


def _spans_at(hashes: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each of the places ``where``; unlike a fingerprint's."""
    out = np.full(len(where), n, np.uint64)
    for j in range(n):
        out = K.mix(out ^ (hashes[where + j] * _OTHER))
    return out


def _word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of texts: first and last row, hashes of all words, and where each row's words begin."""
    data, offsets = K.text_buffer(texts)
    for i, j in K.slices(offsets):
        lo = offsets[i]
        part = K.LOWER[data[lo : offsets[j]]]
        start, end, at = K.words(part, offsets[i : j + 1] - lo, K.LETTER_DIGIT)
        yield i, j, K.span_hash(K.prefix_hash(part), start, end), at


def _item_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, j, hashes, at in _word_hashes(batch.column("text")):
                for d in range(j - i):
                    own = hashes[at[d] : at[d + 1]]
                    n = min(len(own), SPAN)
                    if n:
                        prints = fingerprints(own, n)
                        spans = _spans_at(own, np.arange(len(prints)), n)
                        columns = [pa.array(np.full(len(prints), n, np.int32)), pa.array(prints.view(np.int64)), pa.array(spans.view(np.int64)), pa.array([batch.column("item_id")[i + d].as_py()] * len(prints), pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=["n", "print", "span", "item_id"])


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Words of a bitmap of the hashes in ``prints(print)``; its number of bits is a power of two up to ``MOST_BITS``."""
    count = prints.agg(F.approx_count_distinct("print")).first()[0]
    bits = 1 << 10
    while bits < min(MOST_BITS, BITS_EACH * count):
        bits *= 2
    at = F.col("print").bitwiseAND(bits - 1)
    rows = prints.groupBy(F.shiftright(at, 6).alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(print & {min(bits - 1, 63)} AS INT))")).alias("w")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["k"].to_numpy(np.int64)] = rows["w"].to_numpy(np.int64).view(np.uint64)
    return words


def _candidates(bitmap, lengths: list[int]):
    """Spans of documents whose fingerprint is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bitmap.value
        mask = np.uint64(64 * len(words) - 1)
        with np.errstate(over="ignore"):
            for batch in batches:
                k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
                for i, j, hashes, at in _word_hashes(batch.column("text")):
                    doc = np.repeat(np.arange(j - i), np.diff(at))
                    for n in lengths:
                        prints = fingerprints(hashes, n)
                        if not len(prints):
                            continue
                        bit = prints & mask
                        good = (words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                        where = np.flatnonzero(good & (doc[: len(prints)] == doc[n - 1 :]))
                        if len(where):
                            own = doc[where]
                            columns = (k1[i + own], k2[i + own], np.full(len(where), n, np.int32), prints[where].view(np.int64), _spans_at(hashes, where, n).view(np.int64), where - at[own])
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "n", "print", "span", "at"])

    return run


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word spans from the places of hits."""
    for batch in batches:
        out = []
        for hits in batch.column("hits"):
            first, n = hits.values.field(0).to_numpy(), hits.values.field(1).to_numpy().astype(np.int64)
            order = np.argsort(first, kind="stable")
            first, reach = first[order], np.maximum.accumulate((first + n)[order])
            new = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1])))
            last = reach[np.append(new[1:] - 1, len(first) - 1)] - 1
            out.append([{"first": int(a), "last": int(b)} for a, b in zip(first[new], last, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(out, _SPANS)], names=["k1", "k2", "spans"])


def _key(docs: DataFrame) -> list:
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``k1, k2, spans, item_ids`` of each distinct text of ``docs(text)`` that holds a span of an item; written once."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    owned = materialise(items.mapInArrow(K.tidy(_item_spans), "n int, print long, span long, item_id string").distinct(), "item-spans")
    lengths = sorted(r.n for r in owned.select("n").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(owned.select("print")))
    keyed = docs.select(*_key(docs), F.col("text").cast("string").alias("text")).where("text is not null")
    found = materialise(keyed.mapInArrow(K.tidy(_candidates(bitmap, lengths)), "k1 long, k2 long, n int, print long, span long, at long"), "candidates")
    prints = owned.select("n", "print").distinct()
    near = found.join(prints, ["n", "print"], "left_semi")
    spans = owned.select("n", "print", "span").distinct()
    same = materialise(near.join(spans, ["n", "print", "span"], "left_semi").distinct(), "extended")
    places = same.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n")).alias("hits")).mapInArrow(_merge, "k1 long, k2 long, spans array<struct<first:bigint,last:bigint>>")
    whose = same.select("k1", "k2", "n", "print", "span").distinct().join(owned, ["n", "print", "span"]).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    made = materialise(places.join(whose, ["k1", "k2"]), "hits")
    release(owned, found, same)
    bitmap.unpersist()
    return made


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with the number of words of the last column, a text."""
    for batch in batches:
        data, offsets = K.text_buffer(batch.column(batch.num_columns - 1))
        n = []
        for i, j in K.slices(offsets):
            part = K.LOWER[data[offsets[i] : offsets[j]]]
            n.append(np.diff(K.words(part, offsets[i : j + 1] - offsets[i], K.LETTER_DIGIT)[2]))
        count = pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], count], names=[*batch.schema.names[:-1], "n_words"])


def _with_words(docs: DataFrame) -> DataFrame:
    """``docs`` with ``k1, k2, n_words``."""
    plain = docs.select("*", *_key(docs), F.col("text").cast("string").alias("_words_of"))
    return plain.mapInArrow(K.tidy(_count_words), StructType([*plain.schema.fields[:-1], StructField("n_words", LongType())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, hit word ``spans`` (first, last) and sorted ``item_ids``.

    ``benchmark`` has ``item_id`` and ``text``; rows without either are left out, and rows that share an
    id count as one item. Null and empty texts have no words; a long text is one row like any other; rows with equal
    texts get equal results, also if they repeat an id or have none. Columns named ``n_words``, ``spans``,
    ``item_ids``, ``k1`` or ``k2`` that came in are replaced, all others pass through. Empty tables give no rows or no hits.
    """
    found = hits(docs, benchmark)
    counted = _with_words(docs.drop("n_words", "spans", "item_ids", "k1", "k2").withColumn("text", F.col("text").cast("string")))
    none = {"spans": F.array().cast("array<struct<first:bigint,last:bigint>>"), "item_ids": F.array().cast("array<string>")}
    return counted.join(found, ["k1", "k2"], "left").withColumns({c: F.coalesce(c, empty) for c, empty in none.items()}).drop("k1", "k2")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no span of an item, with all their columns as they are; see :func:`find_contamination`."""
    found = hits(docs, benchmark).select(F.struct("k1", "k2").alias("hit"))
    return docs.join(found, F.struct(*_key(docs)) == found["hit"], "left_anti")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = hits(own, benchmark)
    plain = own.select("doc_id", *_key(own), F.col("text").cast("string").alias("_words_of"))
    counted = plain.mapInArrow(K.tidy(_count_words), "doc_id long, k1 long, k2 long, n_words long").join(found, ["k1", "k2"], "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint>>")), F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return counted.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"))
