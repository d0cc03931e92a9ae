"""Ranked lexical search as a blocked sparse matrix product.

One factor has a row for each query item with the multiplicity of its terms (one each), the other a row for each term with
its int64 impact in each document. A block of documents is one block of columns. For an item's row, the rows of its terms are
merged into one accumulator of the block (Gustavson's order), and of that the best ``k`` are kept before the next block
comes. Tasks hold ``k`` rows an item, whatever the number of documents; these meet in two rounds of ``row_number``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import kernels as K
from .storage import materialise

TOP = 50
#: Pairs of an item and a term that are searched for in one pass; more items take more passes.
BLOCK_PAIRS = 1 << 20
#: Columns of a block, and products merged for one item at a time.
BLOCK_DOCS = 4096
#: Groups that a task's best rows of an item are dealt to before they meet.
GROUPS = 64
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``, each term of an item once; items without a term, null texts too, have no row."""
    lowered = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    found = F.array_distinct(F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0)))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


class Vocabulary:
    """The query's terms: hashes in order, and their bytes, which decide."""

    def __init__(self, terms: list[str]) -> None:
        raw = [t.encode() for t in terms]
        length = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        start = np.concatenate([[0], np.cumsum(length)])
        self.size = len(raw)
        own = np.array([K.span_hash(K.prefix_hash(x), np.array([0]), np.array([len(x)]))[0] for x in (data[a:b] for a, b in zip(start, start[1:], strict=False))], np.uint64)
        order = np.argsort(own, kind="stable")
        if len(np.unique(own)) != len(own):
            raise ValueError("two terms of the query have one hash")
        self.hash, self.term = own[order], order.astype(np.int32)
        self.data, self.start, self.length = data, start[:-1], length

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the spans are terms, and their numbers."""
        if not self.size or not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        own = K.span_hash(K.prefix_hash(data), start, end)
        at = np.minimum(np.searchsorted(self.hash, own), self.size - 1)
        hit = np.flatnonzero(self.hash[at] == own)
        term = self.term[at[hit]]
        same = (end - start)[hit] == self.length[term]
        hit, term = hit[same], term[same]
        size = self.length[term]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        equal = data[np.repeat(start[hit], size) + step] == self.data[np.repeat(self.start[term], size) + step]
        good = np.add.reduceat(equal, first) == size if len(size) else np.zeros(0, bool)
        return hit[good], term[good]


def _count(shared):
    names = ["doc_id", "n", "terms", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = shared.value
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(1))
            for i, j in K.slices(offsets):
                lo = offsets[i]
                part = K.LOWER[data[lo : offsets[j]]]
                start, end, at = K.words(part, offsets[i : j + 1] - lo, K.LETTER_DIGIT)
                hit, term = own.find(part, start, end)
                doc = np.searchsorted(at, hit, "right") - 1
                pair, counts = np.unique(doc * own.size + term, return_counts=True) if len(hit) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                cut = np.searchsorted(pair, np.arange(j - i + 1) * max(own.size, 1))
                as_list = lambda values: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), values)  # noqa: B023, E731
                n = pa.array(np.diff(at), pa.int64())
                terms = as_list(pa.array((pair % max(own.size, 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), n, terms, as_list(pa.array(counts.astype(np.int64)))], names=names)

    return run


@dataclass
class Product:
    """What every task needs of the query: rows of items over terms, weights, and the corpus' size."""

    first: np.ndarray
    terms: np.ndarray
    weight: np.ndarray
    documents: int
    length: int
    k: int


def weights(held: dict[int, int], size: int, documents: int) -> np.ndarray:
    """A term's weight from the number of documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(t, 0) + 1))) for t in range(size)], np.int64)


def impacts(weight: np.ndarray, count: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """int64 impacts of terms that stand ``count`` times in documents of ``n`` terms."""
    m = 50 + (50 * n * documents) // length
    return weight * ((1_000_000_000 * count) // (1000 * count + 20 * m))


class _Best:
    """The best ``k`` of an item so far: higher scores, then lower ids, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 0
        self.score, self.doc, self.unknown = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, unknown: np.ndarray) -> None:
        score, doc, unknown = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.unknown, unknown)))
        if len(score) > self.k:
            order = np.lexsort((doc, unknown, -score))[: self.k]
            score, doc, unknown = score[order], doc[order], unknown[order]
            self.least = int(score[-1])
        self.score, self.doc, self.unknown = score, doc, unknown


def _multiply(shared):
    def block(p: Product, best: list[_Best], doc: np.ndarray, unknown: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        impact = impacts(p.weight[term], count, n[row], p.documents, p.length)
        order = np.argsort(term, kind="stable")
        column, impact = row[order], impact[order]
        start = np.searchsorted(term[order], np.arange(len(p.weight) + 1))
        merged = np.zeros(len(doc), np.int64)
        for i, own in enumerate(best):
            merged[:] = 0
            for t in p.terms[p.first[i] : p.first[i + 1]]:
                a, b = start[t], start[t + 1]
                merged[column[a:b]] += impact[a:b]  # a document stands in a term's row once
            found = np.flatnonzero(merged >= max(own.least, 1))
            if len(found):
                own.add(merged[found], doc[found], unknown[found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Product = shared.value
        part = TaskContext.get().partitionId()
        best = [_Best(p.k) for _ in range(len(p.first) - 1)]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                cut = batch.slice(at, BLOCK_DOCS)
                ids, terms, counts = cut.column(0), cut.column(2), cut.column(3)
                row = np.repeat(np.arange(cut.num_rows), np.diff(terms.offsets.to_numpy()))
                block(p, best, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), cut.column(1).to_numpy(), row, terms.flatten().to_numpy(), counts.flatten().to_numpy())
        for i, own in enumerate(best):
            if len(own.score):
                docs = pa.array(own.doc, pa.int64(), mask=own.unknown)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.score), i, np.int32)), docs, pa.array(own.score), pa.array(np.full(len(own.score), part, np.int32))], names=["item", "doc_id", "score", "part"])

    return run


def _order() -> tuple[Column, Column]:
    return F.desc("score"), F.asc_nulls_last("doc_id")


def _search_block(plain: DataFrame, pairs: list[Row], key: StructField, k: int) -> DataFrame:
    spark = plain.sparkSession
    ids = list(dict.fromkeys(r.item_id for r in pairs))
    names = list(dict.fromkeys(r.term for r in pairs))
    item, number = {x: i for i, x in enumerate(ids)}, {t: i for i, t in enumerate(names)}
    own: list[list[int]] = [[] for _ in ids]
    for r in pairs:
        own[item[r.item_id]].append(number[r.term])
    words = spark.sparkContext.broadcast(Vocabulary(names))
    counted = materialise(plain.mapInArrow(K.tidy(_count(words)), "doc_id long, n long, terms array<int>, counts array<long>").where("n > 0"), "term-counts")
    size = counted.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    held = {r.term: r.n for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # at most a block's terms
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    product = Product(first, np.array([t for x in own for t in x], np.int64), weights(held, len(names), size.documents), size.documents, size.length or 1, k)
    shared = spark.sparkContext.broadcast(product)
    best = counted.where(F.size("terms") > 0).mapInArrow(K.tidy(_multiply(shared)), "item int, doc_id long, score long, part int")
    near = Window.partitionBy("item", F.col("part") % GROUPS).orderBy(*_order())
    ranked = best.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).drop("rank")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*_order()))).where(F.col("rank") <= k)
    known = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("item", IntegerType()), key]))
    return ranked.join(F.broadcast(known), "item").select("item_id", "rank", "doc_id", "score")  # a block's items


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other columns, whatever their names, are ignored.
    A score sums, over the item's different terms, weight times saturated count, all in 64-bit integers. Null and empty
    texts have no terms: such documents count nowhere, such items give no row. Rows that repeat a doc_id are documents of
    their own; those that repeat an item_id, or have none, are one item with the terms of all. Equal scores go by ascending doc_id,
    a null id last. Very long texts are counted slice by slice. Items are searched for in blocks of about ``block_pairs``
    pairs of item and term; each block reads the documents once and then only their counted terms. Empty tables give no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs = materialise(item_terms(items), "item-terms")
    blocks = -(-pairs.count() // block_pairs)
    key = pairs.schema["item_id"]
    found = None
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about block_pairs rows
        if own:
            part = _search_block(plain, own, key, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], StructType([key, *(StructField(n, t) for n, t in (("rank", IntegerType()),))])).selectExpr("item_id", "rank", "CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS BIGINT) AS score")
    return found


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, corpus GROUP BY term, docs),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // len)))) AS impact
  FROM counts JOIN lengths USING (doc_id) JOIN weights USING (term), corpus
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM items JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""
