"""Cost-balanced packing: descending documents go to the sequence of lowest cost that still has room.

A document of s tokens costs ``linear * s + quadratic * s * s``, what the layers and attention within it take; a sequence costs
the sum of its pieces. Sequences are as many as the tokens fill, plus one for each power of two in what is left, so nothing is
padded. The assignment is worked out once for the histogram of lengths: sequences that are equal so far are one class, a
length's documents go to a whole class at a time, and planning takes time by the number of lengths, not of documents. A
document that fits in no sequence fills the room of the cheapest one that has any and goes on as a shorter one.
Documents of a length are numbered across partitions by a prefix sum of counts; the number picks the place.
"""

from __future__ import annotations

import heapq
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
from .tokens import tokenizer_path
from .wordbpe import word_encoder

SEQUENCE = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Of a model with 4,096 hidden values: twelve weights for each hidden value, against one product for each pair of tokens.
LINEAR, QUADRATIC = 12 * 4096, 1


def cost(length, linear: int = LINEAR, quadratic: int = QUADRATIC):
    return linear * length + quadratic * length * length


def capacities(total: int, size: int) -> list[tuple[int, int]]:
    """(capacity, how many) of sequences that hold ``total`` tokens exactly: full ones and powers of two."""
    rest = total % size
    return [(size, total // size)] * (total >= size) + [(1 << b, 1) for b in reversed(range(rest.bit_length())) if rest >> b & 1]


@dataclass
class Plan:
    """For each length, ranges of document numbers with the place of the first piece and what is left of it."""

    at: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    taken: dict[int, np.ndarray]
    #: Number, among documents of the length that is left, of the range's first one.
    goes_on: dict[int, np.ndarray]


def plan(histogram: dict[int, int], size: int = SEQUENCE, linear: int = LINEAR, quadratic: int = QUADRATIC) -> Plan:
    """Where the documents of each length go. ``histogram`` counts lengths from 1 to ``size``."""
    counts = defaultdict(int, histogram)
    rows: dict[int, list[tuple]] = defaultdict(list)
    roomy: list[tuple] = []  # cost, first sequence, how many, used, capacity; all have room for the length at hand
    tight: list[tuple] = []  # the same of those that don't
    by_room: dict[int, list[tuple]] = defaultdict(list)
    gone: set[tuple] = set()

    def put(state: tuple, length: int) -> None:
        room = state[4] - state[3]
        if room >= length:
            heapq.heappush(roomy, state)
        elif room:
            heapq.heappush(tight, state)
            by_room[room].append(state)

    first = 0
    for capacity, many in capacities(sum(k * n for k, n in counts.items()), size):
        put((0, first, many, 0, capacity), size)
        first += many
    for length in range(size, 0, -1):
        for state in by_room.pop(length, ()):
            if state not in gone:
                gone.add(state)
                heapq.heappush(roomy, state)
        at, own = 0, cost(length, linear, quadratic)
        while at < counts[length]:
            if roomy:
                spent, first, many, used, capacity = heapq.heappop(roomy)
                take, fits = min(many, counts[length] - at), length
                if take < many:
                    heapq.heappush(roomy, (spent, first + take, many - take, used, capacity))
                rows[length].append((at, first, used, length, 0))
                put((spent + own, first, take, used + length, capacity), length)
            else:
                while (state := heapq.heappop(tight)) in gone:
                    gone.discard(state)
                gone.add(state)
                spent, first, many, used, capacity = state
                take, fits = min(many, counts[length] - at), capacity - used
                if take < many:
                    put((spent, first + take, many - take, used, capacity), length)
                rows[length].append((at, first, used, fits, counts[length - fits]))
                counts[length - fits] += take
            at += take
    column = lambda k: {length: np.array([r[k] for r in x], np.int64) for length, x in rows.items()}
    return Plan(*map(column, range(5)))


def _encode(path: str, size: int, end_id: int):
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "part", "number"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), word_encoder(path)
        end, width = np.array([end_id], encode.dtype).tobytes(), encode.dtype.itemsize
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // width
                for at in range(0, n, size):
                    length = min(size, n - at)
                    rows.append((doc_id, at, length, n, ids[at * width : (at + length) * width], part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return run


def _place(shared, path: str, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, dtype = shared.value, word_encoder(path).dtype
        for batch in batches:
            row = np.arange(batch.num_rows)
            left, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            done = np.zeros(len(row), np.int64)
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            while len(row):
                at, sequence, offset, taken, on = (np.empty(len(row), np.int64) for _ in range(5))
                for length in np.unique(left).tolist():
                    mine = np.flatnonzero(left == length)
                    k = np.searchsorted(made.at[length], number[mine], "right") - 1
                    for to, values in ((at, made.at), (sequence, made.sequence), (offset, made.offset), (taken, made.taken), (on, made.goes_on)):
                        to[mine] = values[length][k]
                for kept, values in zip(out, (row, done, taken, sequence + number - at, offset), strict=True):
                    kept.append(values)
                cut = np.flatnonzero(taken < left)
                row, number, done, left = row[cut], (on + number - at)[cut], (done + taken)[cut], (left - taken)[cut]
            row, done, taken, sequence, offset = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            raw = [r.as_py() for r in batch.column("ids")]
            width = dtype.itemsize
            wide = [np.frombuffer(raw[r][a * width : (a + n) * width], dtype).astype("<u4").tobytes() for r, a, n in zip(row.tolist(), done.tolist(), taken.tolist(), strict=True)]
            own = batch.take(pa.array(row))
            start = own.column("start").to_numpy() + done
            ids = pa.array(wide, pa.binary()) if with_ids else pa.nulls(len(row), pa.binary())
            crc = pa.array([zlib.crc32(x) for x in wide], pa.int64())
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(start), pa.array(taken), crc, own.column("doc_tokens"), ids, pa.array(sequence), pa.array(offset)], names=names)

    return run


def pack_balanced(docs: DataFrame, size: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID, linear: int = LINEAR, quadratic: int = QUADRATIC, with_ids: bool = True) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset``.

    ``docs`` has ``doc_id`` and ``text``; other columns, whatever their names, are ignored. Each text becomes its ids and
    ``end_id``, a null or empty one ``end_id`` alone. A sequence holds exactly ``size`` tokens or, for the last few, a
    smaller power of two. Only documents longer than ``size``, and those that fit in no sequence when their turn comes, are cut; each id is in
    one piece. ``ids`` holds a piece's little-endian 32-bit ids, or null without ``with_ids``. Rows that repeat an id are
    packed each for itself, a null id stays null, equal lengths are told apart by their number. An empty table gives no rows.
    The driver gets the histogram of lengths, ``size`` rows at most; the plan that it broadcasts depends on those, whatever the
    number of documents.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path(TOKENIZER)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, number long"
    pieces = materialise(plain.mapInArrow(K.tidy(_encode(path, size, end_id)), schema), "balanced-pieces")
    counts = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "balanced-lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan(histogram, size, linear, quadratic))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # there is a base for each length and partition, so its table grows with the documents: never broadcast it. A shuffle
    # partition holds ``lengths * parts / partitions`` of them in a hash table and streams the pieces with their ids, unsorted
    numbered = pieces.join(bases.hint("shuffle_hash"), ["length", "part"]).select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("number") + F.col("base")).alias("number"))
    placed = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long"
    return numbered.mapInArrow(K.tidy(_place(shared, path, with_ids)), placed)


def sequence_costs(packed: DataFrame, linear: int = LINEAR, quadratic: int = QUADRATIC) -> DataFrame:
    """``sequence_id, n_tokens, n_pieces, cost`` of each packed sequence."""
    own = cost(F.col("length"), linear, quadratic)
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"), F.sum(own).alias("cost"))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece."""
    return pack_balanced(docs, with_ids=False).drop("ids")
