"""Best-two-fit packing of token sequences, planned on the histogram of lengths.

A pattern is the list of lengths in a sequence. It is filled greedily, the longest length that fits
first; then its smallest document gives way to two unpacked ones whenever they fill the widened gap
more tightly. A pattern is used as often as the lengths last, so planning takes time by the number of
different lengths, which the sequence size bounds, not by the number of documents. Documents of a length
are numbered across partitions by a prefix sum of counts, and their number picks the sequence.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import kernels as K
from .storage import materialise
from .tokens import END_ID, encoder, tokenizer_path

SEQUENCE = 2048


def _largest(counts: np.ndarray, limit: int) -> int:
    """The largest length up to ``limit`` that is left, or 0."""
    found = np.flatnonzero(counts[1 : limit + 1]) if limit > 0 else ()
    return int(found[-1]) + 1 if len(found) else 0


def _two(counts: np.ndarray, gap: int, more_than: int) -> tuple[int, int] | None:
    """The two lengths left that fill ``gap`` best, if they fill more than ``more_than``."""
    if gap < 2:
        return None
    lengths = np.arange(len(counts))
    below = np.maximum.accumulate(np.where(counts > 0, lengths, 0))
    first = np.flatnonzero(counts[: gap + 1])
    second = below[np.minimum(gap - first, first)]
    alone = (second == first) & (counts[first] < 2)
    second = np.where(alone, below[np.maximum(first - 1, 0)], second)
    total = np.where(second > 0, first + second, 0)
    if not len(total) or total.max() <= more_than:
        return None
    k = int(np.argmax(total))
    return int(first[k]), int(second[k])


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns = []
    while True:
        free = counts.copy()
        items, gap = [], size
        while length := _largest(free, gap):
            items.append(length)
            free[length] -= 1
            gap -= length
        if not items:
            return patterns
        while gap:
            small = min(items)
            two = _two(free, gap + small, small)
            if not two:
                break
            items.remove(small)
            free[small] += 1
            for length in two:
                items.append(length)
                free[length] -= 1
            gap += small - sum(two)
        use = np.bincount(items, minlength=size + 1)
        times = int((counts[use > 0] // use[use > 0]).min())
        patterns.append((tuple(sorted(items, reverse=True)), times))
        counts -= use * times


@dataclass
class Slots:
    """For each length, ranges of document numbers and the sequence and offset they go to."""

    start: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    @classmethod
    def of(cls, patterns: list[tuple[tuple[int, ...], int]]) -> Slots:
        rows, used, first = defaultdict(list), defaultdict(int), 0
        for items, times in patterns:
            at = 0
            for length in items:
                rows[length].append((used[length], first, at))
                used[length] += times
                at += length
            first += times
        column = lambda k: {length: np.array([r[k] for r in x], np.int64) for length, x in rows.items()}
        return cls(column(0), column(1), column(2))


def pieces_of(ids: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Starts and ids of a document's pieces; only the first may be shorter than ``size``."""
    at = 0
    first = len(ids) % size or size
    while at < len(ids):
        upto = first if at == 0 else at + size
        yield at, ids[at:upto]
        at = upto


def _cut(path: str, size: int, with_ids: bool, keep_pieces: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "number"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(path)
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(np.frombuffer(encode(text.as_py()), "<u4"), np.uint32(END_ID)).astype("<u4")
                for k, (at, own) in enumerate(pieces_of(ids, size)):
                    raw = own.tobytes()
                    rows.append((doc_id, k, at, len(own), zlib.crc32(raw), raw if with_ids else None, part, seen[len(own)]))
                    seen[len(own)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        if not keep_pieces:
            encode.pieces.clear()

    return run


def _place(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = slots.value
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                k = np.searchsorted(own.start[x], number[mine], "right") - 1
                sequence[mine] = own.sequence[x][k] + number[mine] - own.start[x][k]
                offset[mine] = own.offset[x][k]
            kept = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, size: int = SEQUENCE, tokenizer: str | None = None, with_ids: bool = True, keep_pieces: bool = True) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Each text becomes its ids and id 0, a
    null or empty one id 0 alone. A document is cut only if it is longer than ``size``. ``ids`` holds a
    piece's little-endian 32-bit ids, or null without ``with_ids``. Workers keep the ids of frequent words for
    their next partition unless ``keep_pieces`` is false, which takes more time and less memory. Rows that repeat an id are packed
    each for itself; a null id stays null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, number long"
    pieces = materialise(plain.mapInArrow(K.tidy(_cut(tokenizer or tokenizer_path(), size, with_ids, keep_pieces)), schema), "pieces")
    counts = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    slots = spark.sparkContext.broadcast(Slots.of(plan(histogram, size)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("number") + F.col("base")).alias("number"))
    placed = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"
    return numbered.mapInArrow(_place(slots), placed)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_ids, ids`` of each packed sequence; a sequence has at most ``SEQUENCE`` pieces."""
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", "n_ids", joined.alias("ids"))
