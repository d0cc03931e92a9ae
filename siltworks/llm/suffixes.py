"""Exact substring dedup with a logarithmic family of sparse suffix arrays.

Only suffixes that start at minimizers are indexed. Of the k-grams in each window of ``LENGTH`` bytes the one
with the least hash (the leftmost of equals) is its minimizer, so equal windows have equal minimizers at
equal places. The windows of a text that share a minimizer are one segment; all texts are cut
into segments, and each window lies in exactly one.

A batch's array holds its suffixes in the order of the hash of their first k bytes, each with the smallest and the
largest document that has it. It is a table of sorted buckets, so it is merge-scanned
against the levels before it, and levels of equal size merge before the next batch comes, without any
shuffle; there are about log2 of the number of batches. Suffixes that two documents share are
kept. Order by hash, not by letters, is all that equality needs, and it spreads evenly over buckets; tasks count their
suffixes in sorted runs before these are shuffled.

Long matches are then made exact. A segment whose bytes an earlier document has too is covered as a whole;
inside long matches all are. Segments at the ends of matches share a suffix but not all bytes: those
that also share ``REACH`` bytes to the right or left of the suffix with another document, as every
common window does on one side, are compared window by window. Whatever decides on bytes is joined by two
hashes, 64 bits of the segment or window and 64 or 32 of the suffix in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K
from .spans import copies, counted
from .storage import erase, materialise, new_path, release, settings

LENGTH = 50
GRAM = 20
WINDOW = LENGTH - GRAM + 1
REACH = -(-(LENGTH - GRAM) // 2)
#: A table comes in at least so many batches, and in more if one would hold more documents than this.
BATCHES, BATCH_DOCS = 3, 1 << 31
#: documents for which an array has a bucket
BUCKET_DOCS = 1 << 16
#: suffixes that a task sorts and counts before it gives them away
RUN = 1 << 21
#: rounds in which windows are compared
ROUNDS = 2


def minimizers(order: np.ndarray) -> np.ndarray:
    """For each start of ``WINDOW`` k-grams the place of the least, the leftmost of equals; ``order`` has 32 bits."""
    best, size = order.astype(np.uint64) << np.uint64(32) | np.arange(len(order), dtype=np.uint64), 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        if len(best) <= step:
            return np.zeros(0, np.int64)
        best = np.minimum(best[:-step], best[step:])
        size += step
    return best.astype(np.uint32)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, first window, number of windows, minimizer's place and hash, and hash of the bytes of each segment.

    Places count from the text's start.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    prefix = K.prefix_hash(data)
    order = K.raw_hash(prefix, GRAM) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
    place = minimizers(order)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    n = len(data) - LENGTH + 1
    inside = doc[:n] == doc[LENGTH - 1 :]
    # windows of two texts are never neighbours: those across the border lie between
    change = place[1:] != place[:-1]
    new, end = inside.copy(), inside.copy()
    new[1:] &= change | ~inside[:-1]
    end[:-1] &= change | ~inside[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    own = doc[first].astype(np.int64)
    begin = offsets[own]
    at = place[first].astype(np.int64)
    return own, first - begin, last - first + 1, at - begin, K.span_hash(prefix, at, at + GRAM), K.span_hash(prefix, first, last + LENGTH)


#: A place in a column: copy of the document, first window, number of windows, distance to the minimizer.
def _packed(copy: np.ndarray, first: np.ndarray, n: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    return (copy << 46) | (first << 12) | (n << 6) | ahead


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, ...]:
    return place >> 46, (place >> 12) & ((1 << 34) - 1), (place >> 6) & 63, place & 63


def _segments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = K.text_buffer(batch.column("text"))
            ids, copy = batch.column("doc_id").to_numpy(), batch.column("copy").to_numpy().astype(np.int64)
            for i, j in K.slices(offsets):
                doc, first, n, place, gram, bytes_ = segments(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(bytes_.view(np.int64)), pa.array(ids[i + doc]), pa.array(_packed(copy[i + doc], first, n, place - first))],
                    names=["suffix", "segment", "doc_id", "place"],
                )


_SEGMENT = "suffix long, segment long, doc_id long, place long"


def _run(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A sorted run: each suffix with the smallest and the largest document that has it."""
    suffix, doc = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(suffix)
    suffix, doc = suffix[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], suffix[1:] != suffix[:-1])))
    return pa.RecordBatch.from_arrays([pa.array(suffix[first]), pa.array(np.minimum.reduceat(doc, first)), pa.array(np.maximum.reduceat(doc, first))], names=["suffix", "low", "high"])


def _suffixes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the suffixes of a partition, so that a suffix that very many documents have is a few rows."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = K.text_buffer(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for i, j in K.slices(offsets):
                doc, _, _, _, gram, _ = segments(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if len(doc):
                    parts.append((gram.view(np.int64), ids[i + doc]))
                    size += len(doc)
                if size >= RUN:
                    yield _run(parts)
                    parts, size = [], 0
        if parts:
            yield _run(parts)


def _write_buckets(df: DataFrame, name: str, key: str, buckets: int) -> str:
    """Writes ``df``, which is partitioned so, as a table of sorted buckets in the shared folder; its path."""
    path = new_path(df.sparkSession, name)
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return path


class SuffixIndex:
    """A logarithmic family of suffix arrays, each a table of ``buckets`` sorted buckets in the shared folder.

    ``levels`` lists the number of batches in each array and its name, oldest first.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []
        self._paths: dict[str, str] = {}

    def _settings(self):
        """Sorted buckets are read as such, and what is sorted is counted in passing."""
        return settings(self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__execution__replaceHashWithSortAgg="true")

    def _write(self, array: DataFrame, name: str) -> None:
        self._paths[name] = _write_buckets(array, name, "suffix", self.buckets)

    def _array(self, name: str) -> DataFrame:
        """``suffix, low, high`` of an array, each suffix once. Its runs are counted while its buckets are scanned."""
        return self.spark.table(name).groupBy("suffix").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            erase(self.spark, self._paths.pop(name))

    def _merge_levels(self) -> None:
        """Merges the newest levels as long as the last two are of equal size."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, new), (_, old) = self.levels.pop(), self.levels.pop()
            a, b = (self._array(t).withColumnsRenamed({"low": f"low{k}", "high": f"high{k}"}).hint("merge") for k, t in enumerate((old, new)))
            merged = a.join(b, "suffix", "full").select("suffix", F.least("low0", "low1").alias("low"), F.greatest("high0", "high1").alias("high"))
            name = f"suffixes_{uuid.uuid4().hex}"
            self._write(merged, name)
            self._drop(new, old)
            self.levels.append((2 * n, name))

    def add(self, batch: DataFrame) -> DataFrame:
        """Indexes ``batch(doc_id, text)``, whose ids no earlier batch had; its suffixes that two documents share."""
        with self._settings():
            self._merge_levels()
            name = f"suffixes_{uuid.uuid4().hex}"
            self._write(batch.select("doc_id", "text").mapInArrow(K.tidy(_suffixes_of), "suffix long, low long, high long").repartition(self.buckets, "suffix"), name)
            shared = self._array(name).where("low < high").select("suffix")
            for _, level in self.levels:
                shared = shared.union(self.spark.table(name).select("suffix").hint("merge").join(self.spark.table(level).select("suffix").hint("merge"), "suffix", "left_semi"))
            shared = materialise(shared, "shared")
            self.levels.append((1, name))
        return shared

    def close(self) -> None:
        self._drop(*(level for _, level in self.levels))
        self.levels = []


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments, each with a number of its own."""
    ref = TaskContext.get().partitionId() << 32
    for batch in batches:
        out = []
        for doc_id, text, copy, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("copy").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            raw = text.as_py().encode()
            for w in wanted:
                own, first, n, ahead = _unpacked(w["place"])
                if own == copy:
                    out.append((ref, w["suffix"], w["segment"], doc_id, ahead, raw[first : first + n + LENGTH - 1]))
                    ref += 1
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((*[pa.int64()] * 5, pa.binary()))], names=["ref", "suffix", "segment", "doc_id", "ahead", "bytes"])


def _hashes(spans: list[tuple[int, int]], raw: list[bytes]) -> np.ndarray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    prefix = K.prefix_hash(np.frombuffer(b"".join(raw), np.uint8))
    start = np.array([s for s, _ in spans], np.int64)
    return K.span_hash(prefix, start + offsets[:-1], np.array([e for _, e in spans], np.int64) + offsets[:-1])


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            raw, ahead = batch.column("bytes").to_pylist(), batch.column("ahead").to_pylist()
            for right in (True, False):
                at = [(a, a + GRAM + REACH) if right else (a - REACH, a + GRAM) for a in ahead]
                good = np.array([s >= 0 and e <= len(r) for (s, e), r in zip(at, raw, strict=True)], bool)
                if not good.any():
                    continue
                keep = np.flatnonzero(good)
                key = K.mix(_hashes([at[k] for k in keep], [raw[k] for k in keep]) ^ np.uint64(right))
                part = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column("doc_id"), part.column("suffix"), part.column("segment"), pa.array([right] * len(keep))], names=["side", "doc_id", "suffix", "segment", "is_right"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows that reach as far to a side as that side is common."""
    with np.errstate(over="ignore"):
        for batch in batches:
            raw = batch.column("bytes").to_pylist()
            n = np.array([len(r) - LENGTH + 1 for r in raw], np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
            prefix = K.prefix_hash(np.frombuffer(b"".join(raw), np.uint8))
            row = np.repeat(np.arange(len(raw)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            left = batch.column("ahead").to_numpy()[row] - at
            on = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(bool)[row] for c in ("right", "left")}
            good = (on["right"] & (LENGTH - GRAM - left >= REACH)) | (on["left"] & (left >= REACH))
            row, at = row[good], at[good]
            key = K.span_hash(prefix, offsets[row] + at, offsets[row] + at + LENGTH)
            take = pa.array(row)
            spot = batch.column("ref").to_numpy()[row] << 6 | at
            tag = (batch.column("suffix").to_numpy() >> 32).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tag[row]), pa.array(key.view(np.int64)), batch.column("doc_id").take(take), pa.array(spot)], names=["tag", "window", "doc_id", "spot"])


def _removed(data: np.ndarray, offsets: np.ndarray, again: np.ndarray, places: np.ndarray, begin: np.ndarray, at: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Whether each byte goes, and first byte, end and text of each maximal run of those that do.

    ``places`` has the segments that were found, ``begin`` the starts of their texts in ``data`` and ``at`` which of
    their windows: all if it is null. Texts that are ``again`` there go as a whole.
    """
    _, first, n, _ = _unpacked(places)
    first = first + begin
    some = at.is_valid().to_numpy(zero_copy_only=False)
    window = np.repeat(first[some], at.value_lengths().drop_null().to_numpy()) + at.flatten().to_numpy()
    start = np.concatenate((first[~some], window, offsets[:-1][again]))
    end = np.concatenate((first[~some] + n[~some] + LENGTH - 1, window + LENGTH, offsets[1:][again]))
    size = len(data)
    gone = np.cumsum(np.bincount(start, minlength=size + 1) - np.bincount(end, minlength=size + 1))[:size] > 0
    border = np.zeros(size + 1, bool)
    border[offsets] = True
    low = np.flatnonzero(gone & (np.concatenate(([True], ~gone[:-1])) | border[:-1]) if size else gone)
    high = np.flatnonzero(gone & (np.concatenate((~gone[1:], [True])) | border[1:]) if size else gone) + 1
    return gone, low, high, np.searchsorted(offsets, low, "right") - 1


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.text_buffer(batch.column("text"))
        copy, again = batch.column("copy").to_numpy(), batch.column("again").to_numpy(zero_copy_only=False)
        found = batch.column("found")
        row = np.repeat(np.arange(len(batch)), found.value_lengths().fill_null(0).to_numpy())
        flat = found.flatten()
        place, at = flat.field("place").to_numpy(), flat.field("at")
        own = np.flatnonzero(_unpacked(place)[0] == copy[row])
        row, place, at = row[own], place[own], at.take(pa.array(own))
        for i, j in K.slices(offsets):
            a, b = np.searchsorted(row, (i, j))
            here = offsets[i : j + 1] - offsets[i]
            part = data[offsets[i] : offsets[j]]
            gone, low, high, doc = _removed(part, here, again[i:j], place[a:b], here[row[a:b] - i], at.slice(a, b - a))
            spans = pa.StructArray.from_arrays([pa.array(low - here[doc]), pa.array(high - here[doc])], names=["first", "last"])
            rest = np.concatenate(([0], np.cumsum(~gone)))[here].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i),
                    batch.column("text").slice(i, j - i),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32()), spans),
                    pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(rest), pa.py_buffer(part[~gone])]),
                ],
                names=["doc_id", "text", "removed", "kept_bytes"],
            )


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out


def _between(cuts: list[int]) -> list:
    """Conditions for the ranges of ids between ``cuts``."""
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        above = F.lit(True) if low is None else F.col("doc_id") > low
        parts.append(above if high is None else above & (F.col("doc_id") <= high))
    return parts


def _ranges(n_docs: int, quantiles: list[int], batches: int | None) -> list:
    """Conditions that cut a table in batches of about equal numbers of documents."""
    n = batches or max(BATCHES, -(-n_docs // BATCH_DOCS))
    picked = [quantiles[len(quantiles) * k // n] for k in range(1, n)] if quantiles else []
    return _between(sorted(set(picked)))


def _once(plain: DataFrame, buckets: int) -> DataFrame:
    """``doc_id, text, copy, again`` of the rows with an id, in buckets by it: whether an earlier document has the very text.

    All windows of a text that is there again are its first document's, so it goes as a whole, and no other text loses
    or keeps more if it isn't indexed a second time. Texts cross the network once, here.
    """
    spark, known = plain.sparkSession, plain.where("doc_id is not null")
    texts = materialise(known.where(F.octet_length("text") >= LENGTH).select("doc_id", "copy", F.sha2("text", 256).alias("sha")), "texts")
    twice = materialise(texts.groupBy("sha").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last")).where("holder < last").select("sha", "holder"), "twice")
    later = materialise(texts.join(twice, "sha").where("doc_id > holder").groupBy("doc_id").agg(F.collect_set("copy").alias("copies")), "later")
    release(texts, twice)
    again = F.coalesce(F.array_contains("copies", F.col("copy")), F.lit(False)).alias("again")
    name = f"texts_{uuid.uuid4().hex}"
    _write_buckets(known.repartition(buckets, "doc_id").join(later, "doc_id", "left").select("doc_id", "text", "copy", again), name, "doc_id", buckets)
    release(later)
    once = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, as the plan that is returned reads them
    return once


def remove_repeats(docs: DataFrame, batches: int | None = None) -> DataFrame:
    """``doc_id, text, removed, kept_bytes``: without bytes of ``LENGTH``-byte strings that an earlier document has.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Documents with smaller ids are earlier. Null texts
    count as empty. Rows without an id neither lose bytes nor make others lose any; rows that share an id
    don't remove each other's bytes. An empty table gives no rows. The table is indexed in ``batches`` ranges of
    ids (by default ``BATCHES``, or more of ``BATCH_DOCS``), read one after the other; where it is stored in about the
    order of ids, each reads its own row groups only.
    """
    spark = docs.sparkSession
    plain = copies(docs)
    n_docs, quantiles = plain.where("doc_id is not null").agg(F.count("*"), F.percentile_approx("doc_id", [k / 256 for k in range(256)], 4096)).first()
    parts = _ranges(n_docs, quantiles or [], batches)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_docs // BUCKET_DOCS))
    once = _once(plain, buckets)
    full = once.where(~F.col("again") & (F.octet_length("text") >= LENGTH))
    index, shared = SuffixIndex(spark, buckets), []
    for part in parts:
        shared.append(index.add(full.where(part)))
    index.close()
    both = materialise(_union(shared).distinct(), "shared")
    release(*shared)
    held = [materialise(full.where(part).mapInArrow(K.tidy(_segments_of), _SEGMENT).join(both.hint("shuffle_hash"), "suffix"), "segments") for part in parts]
    release(both)
    every, key = _union(held), ["suffix", "segment"]
    kinds = materialise(every.groupBy(key).agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("place")), "kinds")
    # What a join may have to split is written before it, so that the join sees a plain shuffle.
    several = materialise(kinds.groupBy("suffix").agg(F.count("*").alias("n"), F.min("holder").alias("a"), F.max("last").alias("b")).where("n > 1 and a < b").select("suffix"), "several")
    wanted = kinds.join(several.hint("shuffle_hash"), "suffix").groupBy(F.col("holder").alias("doc_id")).agg(F.collect_list(F.struct(*key, "place")).alias("wanted"))
    texts = materialise(full.join(wanted.hint("shuffle_hash"), "doc_id").mapInArrow(_texts_of, "ref long, suffix long, segment long, doc_id long, ahead long, bytes binary"), "segment-texts")
    release(several)
    sides = texts.mapInArrow(_sides, "side long, doc_id long, suffix long, segment long, is_right boolean")
    common = materialise(sides.groupBy("side").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("side"), "sides")
    near = materialise(sides.join(common.hint("shuffle_hash"), "side", "left_semi").groupBy(key).agg(F.bool_or("is_right").alias("right"), F.bool_or(~F.col("is_right")).alias("left")), "near")
    release(common)
    checked = materialise(texts.join(near.hint("shuffle_hash"), key), "checked")
    release(texts, near)
    hits = []
    for k in range(ROUNDS):  # equal windows have equal suffixes, so no two rounds have to meet; each holds its share of the windows on disk
        windows = checked.where(F.pmod(F.shiftright("suffix", 32), F.lit(ROUNDS)) == k).mapInArrow(_windows, "tag int, window long, doc_id long, spot long")
        first = materialise(windows.groupBy("tag", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "first")
        hit = windows.join(first.hint("shuffle_hash"), ["tag", "window"]).where("doc_id > first").groupBy(F.shiftright("spot", 6).alias("ref")).agg(F.collect_set(F.col("spot").bitwiseAND(63)).alias("at"))
        hits.append(materialise(hit, "hits"))
        release(first)
    partly = materialise(checked.select("ref", *key).join(_union(hits), "ref").select(*key, "at"), "partly")
    release(checked, *hits)
    act = materialise(kinds.select(*key, "holder", "last").join(partly.hint("shuffle_hash"), key, "left").where("holder < last or at is not null").select(*key, "holder", "at"), "act")
    release(kinds, partly)
    found = every.select(*key, "doc_id", "place").join(act.hint("shuffle_hash"), key).where("doc_id > holder or (doc_id = holder and at is not null)")
    found = materialise(found.select("doc_id", "place", F.when(F.col("doc_id") == F.col("holder"), F.col("at")).alias("at")), "found")
    release(*held, act)
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("place", "at")).alias("found"))
    removed = "array<struct<first:bigint,last:bigint>>"
    out = once.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "copy", "again", "found").mapInArrow(_remove, f"doc_id long, text string, removed {removed}, kept_bytes binary")
    nameless = plain.where("doc_id is null").select("doc_id", "text", F.array().cast(removed).alias("removed"), F.coalesce("text", F.lit("")).cast("binary").alias("kept_bytes"))
    return out.unionByName(nameless)


def report(docs: DataFrame, batches: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    return counted(remove_repeats(docs, batches))
