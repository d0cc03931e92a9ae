"""Whether quotes stand in texts word for word: one anchor for each quote, then the words around it.

A quote's anchor is its pair of neighbouring words that is rarest in the texts. Tasks hash all pairs of an Arrow batch at once and give
on only those that may be a quote's: first their counts, then the places of anchors, each with as many words around it as its quotes
have. A small table by slots of hashes says which may be; joins on whole hashes and the words themselves decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltworks.operators.rows import top_k

#: Slots for hashes of pairs. If quotes fill them all, no more than the speed is lost.
SLOTS = 1 << 20
#: bytes of text that are hashed at a time, or one text if it is longer
SLICE_BYTES = 1 << 18

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTE = (np.arange(1, 257, dtype=_U64) * _U64(0xD1342543DE82EF95)) ^ (np.arange(1, 257, dtype=_U64) << _U64(23))


def spaced(text: Column) -> Column:
    """Words of letters and digits in lower case with a space before and after each; null has none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U64)
    out[0] = 1
    return np.cumprod(out)


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of rows that hold about ``SLICE_BYTES`` together."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)
    i = 0
    while i < len(raw):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class _Words:
    """Words of some spaced texts, and the hashes of single words and of pairs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        space = np.flatnonzero(data == 0x20)
        full = np.flatnonzero(np.diff(space) > 1)
        self.start, self.end = space[full] + 1, space[full + 1]
        #: the first word of each text, and of the end
        self.of = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.of))
        self._sums = np.concatenate((np.zeros(1, _U64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data)))))
        self._back = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(_U64)
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return (x ^ (x >> _U64(31))).view(np.int64)

    def single(self) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(self.start)), self._hash(self.start, self.end)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.text[1:] == self.text[:-1])
        return at, self._hash(self.start[at], self.end[at + 1])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``quote_id, q_at, hash`` of all pairs of quotes; of a quote of one word, that word's."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for i, data, offsets in _slices(batch.column("q_text")):
                w = _Words(data, offsets)
                alone = np.flatnonzero(np.diff(w.of)[w.text] == 1)
                at, hashes = (np.concatenate((a, b)) for a, b in zip(w.pairs(), (alone, w.single()[1][alone]), strict=True))
                row = w.text[at]
                yield pa.RecordBatch.from_arrays([batch.column("quote_id").take(pa.array(i + row)), pa.array((at - w.of[row]).astype(np.int32)), pa.array(hashes)], names=["quote_id", "q_at", "hash"])


def _counting(slots: np.ndarray) -> Callable:
    """``hash, n`` of the pairs of texts whose slot is one of ``slots``."""
    last = SLOTS - 1
    packed = np.zeros(SLOTS, bool)
    packed[slots] = True
    packed = np.packbits(packed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed).astype(bool)
        with np.errstate(over="ignore"):
            for batch in batches:
                met = [np.zeros(0, np.int64)]
                for _, data, offsets in _slices(batch.column("text")):
                    hashes = _Words(data, offsets).pairs()[1]
                    met.append(hashes[wanted[hashes & last]])
                found, n = np.unique(np.concatenate(met), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["hash", "n"])

    return count


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The pieces [start, end) of UTF-8 bytes."""
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    where = np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[where])])


def _finding(slots: np.ndarray, left: np.ndarray, right: np.ndarray, single: bool) -> Callable:
    """``source_id, at, hash, before, after``: places of pairs (and words, if ``single``) whose slot is one of ``slots``.

    ``before`` has the ``left`` words up to the place, ``after`` the ``right`` words from it on, as far as the text goes.
    """

    many = SLOTS

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.zeros((2, many), np.int32)
        reach[0, slots], reach[1, slots] = left, right
        with np.errstate(over="ignore"):
            for batch in batches:
                for i, data, offsets in _slices(batch.column("text")):
                    w = _Words(data, offsets)
                    for size, (at, hashes) in ((2, w.pairs()), (1, w.single() if single else (np.zeros(0, np.int64),) * 2)):
                        slot = hashes & (many - 1)
                        hit = np.flatnonzero(reach[1, slot])
                        at, hashes, slot = at[hit], hashes[hit], slot[hit]
                        # where nothing else has to stand around it, the first place in a text is enough
                        bare = (reach[0, slot] == 0) & (reach[1, slot] <= size)
                        order = np.lexsort((at, hashes, w.text[at]))
                        same = np.zeros(len(at), bool)
                        a, h = w.text[at[order]], hashes[order]
                        same[order[1:]] = (a[1:] == a[:-1]) & (h[1:] == h[:-1])
                        keep = np.flatnonzero(~(bare & same))
                        if not len(keep):
                            continue
                        at, hashes, slot = at[keep], hashes[keep], slot[keep]
                        row = w.text[at]
                        low = np.maximum(at - reach[0, slot], w.of[row])
                        high = np.minimum(at + reach[1, slot], w.of[row + 1]) - 1
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("source_id").take(pa.array(i + row)), pa.array((at - w.of[row]).astype(np.int32)), pa.array(hashes), _cut(data, w.start[low] - 1, w.start[at]).cast(pa.string()), _cut(data, w.start[at], w.end[high] + 1).cast(pa.string())],
                            names=["source_id", "at", "hash", "before", "after"],
                        )

    return find


def standing(quotes: DataFrame, sources: DataFrame, keep: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """``quote_id, source_id, at``: sources in which a quote stands, and the word it first begins at (from 0).

    ``quotes`` has quote_id and text, ``sources`` source_id and text; other columns are ignored. Case and what stands between words
    don't count. Null and empty quotes, and those without a word, stand nowhere. Texts are read whole: once to count the pairs of
    quotes of three words and more, and once for the places of anchors; no text crosses the network. ``keep`` writes the anchors, at
    most one for each quote. A pair that no text holds ends its quote at once.
    Rows that repeat an id are texts of one source, each looked through for itself.
    """
    q = quotes.select("quote_id", spaced(F.col("text")).alias("q_text")).where("q_text <> ' '").select("*", F.split(F.trim("q_text"), " ").alias("q_words"))
    s = sources.select("source_id", spaced(F.col("text")).alias("text"))
    kind = quotes.schema["quote_id"].dataType.simpleString(), sources.schema["source_id"].dataType.simpleString()
    all_pairs = lambda some: q.where(some).select("quote_id", "q_text").mapInArrow(_asked, f"quote_id {kind[0]}, q_at int, hash long")
    slot = F.col("hash").bitwiseAND(SLOTS - 1).alias("slot")
    asked = all_pairs(F.size("q_words") > 2)
    counted = asked.select(slot).distinct().toArrow()["slot"].to_numpy()
    often = s.select("text").mapInArrow(_counting(counted), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")) if len(counted) else None
    rarest = asked.limit(0) if often is None else top_k(asked.join(often, "hash"), ["quote_id"], [F.col("n"), F.col("q_at")]).select("quote_id", "q_at", "hash")
    joined = lambda first, n: F.array_join(F.slice("q_words", first, n), " ")
    before = F.when(F.col("q_at") > 0, F.concat(F.lit(" "), joined(F.lit(1), F.col("q_at")), F.lit(" "))).otherwise(" ")
    after = F.concat(joined(F.col("q_at") + 1, F.size("q_words")), F.lit(" "))
    anchors = keep("anchors", rarest.union(all_pairs(F.size("q_words") <= 2)).join(q, "quote_id").select("quote_id", "q_at", "hash", F.size("q_words").alias("n"), before.alias("q_before"), after.alias("q_after")))
    reach = anchors.groupBy(slot).agg(F.max("q_at").alias("left"), F.max(F.col("n") - F.col("q_at")).alias("right"), F.bool_or(F.col("n") == 1).alias("single")).toArrow()
    single = any(reach["single"].to_pylist())
    places = s.mapInArrow(_finding(*(reach[c].to_numpy() for c in ("slot", "left", "right")), single), f"source_id {kind[1]}, at int, hash long, before string, after string")
    same = places.join(anchors, "hash").where(F.endswith("before", F.col("q_before")) & F.startswith("after", F.col("q_after")))
    return same.groupBy("quote_id", "source_id").agg(F.min(F.col("at") - F.col("q_at")).alias("at"))
