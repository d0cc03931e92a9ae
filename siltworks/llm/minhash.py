"""Near-duplicate groups: banded MinHash, odd sketches, confirmation on full shingle sets.

A document's set holds its distinct shingles of ``SHINGLE`` words. MinHash samples of the set are cut
into bands; documents that agree in a band are candidates. The samples are also folded into an odd
sketch, a bitmap in which each sample flips one bit. The population count of the XOR of two
sketches estimates how many samples differ, so most false candidates go without touching a set.
What is left is confirmed on the full sets.

Texts with equal sets share one representative, so copies never meet pairwise. Each bucket has one
hub. A document is first compared with the smallest hub of its buckets, then with the hubs it isn't
joined to yet. Only buckets whose members are still in different
components go on: members outside the largest component are compared with the others in blocks of
bounded size, nearest first, then all that remain. A bucket with very many such members, as a license that
many texts hold makes it, is first replaced by one bucket for each of their rare shingles, which loses no link. Links
between members that a component already joins are never looked for, as they can't change the result.

The threshold is an argument; size filter, sketch cut and confirmation all follow from it. With 32 bands of
4 samples a pair at 0.85 is missed with probability (1 - 0.85**4)**32 < 1e-10, one at 0.80 with
(1 - 0.8**4)**32 < 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import kernels as K
from .components import components
from .storage import materialise, release, scratch

SHINGLE = 5
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: samples folded into an odd sketch, and its bits
SKETCH_SAMPLES, SKETCH_BITS = 512, 1024
#: links unless a caller asks for another threshold: 100 * intersection >= NUMERATOR * union
NUMERATOR = 85
#: The sketches drop a pair at the threshold with a chance below this.
SKETCH_LOSS = 1e-6
LEFT_BLOCK, RIGHT_BLOCK = 128, 512
#: pairs of one node that meet one copy of its row
HUB_PAIRS = 512
#: A bucket with more members outside its largest component is split.
CROWD = 2048

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, SKETCH_SAMPLES, dtype=np.uint32)
_MULT = _rng.integers(0, 1 << 32, SKETCH_SAMPLES, dtype=np.uint32) | np.uint32(1)
_BAND_SEED = K.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_SAMPLE_SEED = K.mix(np.arange(1001, 1001 + SKETCH_SAMPLES, dtype=np.uint64))


@cache
def most_differing_bits(numerator: int = NUMERATOR) -> int:
    """Least XOR population count that a pair at the threshold exceeds with a chance below ``SKETCH_LOSS``.

    A sample differs with the chance 1 - similarity and then flips one bit for each side, so the count
    follows a chain of steps up or down, one for each flip.
    """
    same, odd = numerator / 100, np.arange(SKETCH_BITS + 1) / SKETCH_BITS

    def flip(p: np.ndarray) -> np.ndarray:
        out = np.zeros_like(p)
        out[1:] += (p * (1 - odd))[:-1]
        out[:-1] += (p * odd)[1:]
        return out

    p = np.zeros(SKETCH_BITS + 1)
    p[0] = 1
    for _ in range(SKETCH_SAMPLES):
        p = same * p + (1 - same) * flip(flip(p))
    at_least = p[::-1].cumsum()[::-1]
    return int(np.flatnonzero(at_least < SKETCH_LOSS)[0]) - 1


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each row's number and its sorted distinct shingle hashes."""
    data, offsets = K.text_buffer(texts)
    for i, j in K.slices(offsets):
        lo, hi = offsets[i], offsets[j]
        part = K.LOWER[data[lo:hi]]
        start, end, at = K.words(part, offsets[i : j + 1] - lo, K.NOT_SPACE)
        hashes = K.span_hash(K.prefix_hash(part), start, end)
        grams = K.gram_hash(hashes, SHINGLE)
        for d in range(j - i):
            a, b = at[d], at[d + 1]
            if b - a >= SHINGLE:
                yield i + d, np.unique(grams[a : b - SHINGLE + 1])
            else:
                yield i + d, K.gram_hash(hashes[a:b], int(b - a)) if b > a else hashes[:0]


def samples(shingles: np.ndarray, n: int = SAMPLES) -> np.ndarray:
    """The first ``n`` MinHash samples of a set."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(values), 1024):
        np.minimum(low, ((values[k : k + 1024, None] ^ _XOR[:n]) * _MULT[:n]).min(axis=0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    out = _BAND_SEED.copy()
    for r in range(ROWS):
        out = K.mix(out ^ rows[:, r])
    return out.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    bit = (K.mix(_SAMPLE_SEED ^ low.astype(np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def differing_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Population count of the XOR of sketches. NumPy counts the bits of a signed value's magnitude, so words are unsigned."""
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            n, digest, band = [], [], []
            for _, s in shingle_sets(batch.column(1)):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                band.append(bands(samples(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])


_SKETCH = tuple(f"s{k}" for k in range(SKETCH_BITS // 64))


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = [s for _, s in shingle_sets(batch.column(1))]
            sketch = np.array([odd_sketch(samples(s, SKETCH_SAMPLES)) for s in sets], np.int64).reshape(-1, len(_SKETCH))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(sketch[:, k]) for k in range(len(_SKETCH))), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["node", "n", *_SKETCH, "shingles"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, digest of the set and band hashes of every document."""
    schema = "doc_id long, n_shingles long, digest binary, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(K.tidy(_signatures), schema)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out


def _beside(pairs: DataFrame, table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``pairs(a, b)`` with the columns of both nodes, named ``a_...`` and ``b_...``.

    A node of more than ``HUB_PAIRS`` pairs has several copies of its row, and its pairs are dealt over them, so that
    no task gets all pairs of one hub.
    """
    sides = [pairs.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("n")) for side in ("a", "b")]
    crowd = materialise(_union(sides).groupBy("node").agg(F.ceil(F.sum("n") / HUB_PAIRS).cast("int").alias("copies")).where("copies > 1"), "hubs")
    plain = crowd.isEmpty()
    for side in ("a", "b"):
        own = table.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        if plain:
            pairs = pairs.join(own, side)
            continue
        copies = crowd.select(F.col("node").alias(side), "copies")
        dealt = pairs.join(copies, side, "left").withColumn("deal", F.pmod(F.xxhash64("a", "b"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
        own = own.join(copies, side, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
        pairs = dealt.join(own, [side, "deal"]).drop("deal")
    return pairs


def _close(pairs: DataFrame, sketches: DataFrame, numerator: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and odd sketches allow a link."""
    both = _beside(pairs, sketches, ("n", *_SKETCH))
    differing = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _SKETCH), F.lit(0))
    sizes = 100 * F.least("a_n", "b_n") >= numerator * F.greatest("a_n", "b_n")
    return both.where(sizes & (differing <= most_differing_bits(numerator))).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, numerator: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    both = _beside(pairs, sets, ("shingles",))
    counted = both.select("a", "b", (F.size("a_shingles") + F.size("b_shingles")).alias("total"), F.size(F.array_intersect("a_shingles", "b_shingles")).alias("common"))
    return counted.where(100 * F.col("common") >= numerator * (F.col("total") - F.col("common"))).select("a", "b")


def _linked(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, numerator: int) -> DataFrame:
    """The links among candidate pairs, written once."""
    with scratch(sets.sparkSession):
        close = materialise(_close(materialise(pairs, "pairs"), sketches, numerator), "close")
        return materialise(_confirmed(close, sets, numerator), "links", keep=True)


def _scan(nearest: int | None, numerator: int):
    """Compares the members of bounded blocks; pairs in one component are left out.

    A pair is given in the first bucket that it shares only; where a bucket was split, in each part that it shares.
    """
    limit = most_differing_bits(numerator)

    def pairs(bucket: int, split: bool, left: dict, right: dict, same: bool) -> list[tuple[int, int]]:
        bits = differing_bits(left["s"][:, None, :], right["s"][None, :, :])
        small = np.minimum(left["n"][:, None], right["n"][None, :])
        large = np.maximum(left["n"][:, None], right["n"][None, :])
        fit = (bits <= limit) & (100 * small >= numerator * large) & (left["label"][:, None] != right["label"][None, :])
        if same:
            fit &= left["node"][:, None] < right["node"][None, :]
        if nearest:
            order = np.where(fit, bits, 10_000)
            keep = np.argsort(order, axis=1, kind="stable")[:, :nearest]
            near = np.zeros_like(fit)
            np.put_along_axis(near, keep, True, axis=1)
            fit &= near
        x, y = np.nonzero(fit)
        if not split:
            shared = left["bands"][x] == right["bands"][y]
            first = left["bands"][x, shared.argmax(axis=1)] == bucket
            x, y = x[first], y[first]
        return list(zip(left["node"][x].tolist(), right["node"][y].tolist(), strict=True))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for row, bucket, split, k1, k2, cross in zip(batch.column("members"), *(batch.column(c).to_pylist() for c in ("bucket", "split", "k1", "k2", "cross")), strict=True):
                m = row.values
                col = {c: m.field(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "n", "block", "major", *_SKETCH)}
                col["s"] = np.stack([col.pop(c) for c in _SKETCH], axis=1)
                col["bands"] = m.field("bands").flatten().to_numpy().reshape(-1, BANDS)
                take = lambda mask: {c: v[mask] for c, v in col.items()}
                rest = ~col["major"].astype(bool)
                if cross:
                    left, right = take(rest), take(~rest)
                else:
                    left, right = take(rest & (col["block"] == k1)), take(rest & (col["block"] == k2))
                if len(left["node"]) and len(right["node"]):
                    found.update((min(p), max(p)) for p in pairs(bucket, split, left, right, not cross and k1 == k2))
            at = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["a", "b"])

    return scan


def _mixed(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with the label of their component, and the buckets that hold several components."""
    named = members.join(labels, "node", "left").select("bucket", "split", "node", F.coalesce("root", "node").alias("label"))
    counts = named.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("total"), F.count("*").alias("labels"))
    return named, mixed.where("labels > 1 and total > 2").select("bucket", F.col("top.label").alias("most"), F.col("top.c").alias("in_most"), (F.col("total") - F.col("top.c")).alias("rest"))


def _by_rare_shingles(members: DataFrame, sets: DataFrame, numerator: int) -> DataFrame:
    """Buckets of much narrower kind in place of crowded ones, without losing a link.

    Two sets of a similarity t share at least t * n shingles of a set of n. So if all shingles of the bucket are put
    in one order, the first n - ceil(t * n) + 1 of both sets have one in common. In the order of
    rising frequency these are the rare ones: what many members share, such as a license, puts none of them together.
    """
    own = members.select("bucket", "node").join(sets.select("node", "n", "shingles"), "node").select("bucket", "node", "n", F.explode("shingles").alias("shingle"))
    often = own.groupBy("bucket", "shingle").agg(F.count("*").alias("f"))
    first = F.col("n") - F.ceil(F.col("n") * numerator / 100).cast("long") + 1
    placed = own.join(often, ["bucket", "shingle"]).withColumn("at", F.row_number().over(Window.partitionBy("bucket", "node").orderBy("f", "shingle")))
    return placed.where((F.col("at") <= first) & (F.col("f") > 1)).select(F.xxhash64("bucket", "shingle").alias("bucket"), F.lit(True).alias("split"), "node")


def _remaining(members: DataFrame, labels: DataFrame, sketches: DataFrame, bands: DataFrame, nearest: int | None, numerator: int) -> DataFrame:
    """Candidate pairs of different components in the buckets that hold several of them."""
    named, mixed = _mixed(members, labels)
    mixed = mixed.select("bucket", "most", F.ceil(F.col("rest") / LEFT_BLOCK).cast("int").alias("left"), F.ceil(F.col("in_most") / RIGHT_BLOCK).cast("int").alias("right"))
    known = named.join(mixed, "bucket").join(sketches, "node").join(bands, "node")
    major = F.col("label") == F.col("most")
    block = F.pmod(F.xxhash64("node"), F.when(major, F.col("right")).otherwise(F.col("left"))).cast("int")
    known = known.select("bucket", "split", "left", "right", F.struct("node", "label", "n", block.alias("block"), major.alias("major"), "bands", *_SKETCH).alias("m"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = F.col("m.block")
    key = lambda a, b, cross: F.struct(a.cast("int").alias("k1"), b.cast("int").alias("k2"), F.lit(cross).alias("cross"))
    for_major = F.transform(upto("left"), lambda i: key(i, own, True))
    for_rest = F.concat(F.transform(upto("right"), lambda j: key(own, j, True)), F.transform(upto("left"), lambda i: key(F.least(i, own), F.greatest(i, own), False)))
    spread = known.select("bucket", "split", F.explode(F.when(F.col("m.major"), for_major).otherwise(for_rest)).alias("key"), "m")
    blocks = spread.groupBy("bucket", "split", "key").agg(F.collect_list("m").alias("members")).where(F.size("members") > 1)
    return blocks.select("bucket", "split", "members", "key.k1", "key.k2", "key.cross").mapInArrow(K.tidy(_scan(nearest, numerator)), "a long, b long").distinct()


def _to_hubs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with the hubs of their buckets, where these are in another component."""
    own = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("label"))
    hub = own.groupBy("bucket").agg(F.min(F.struct("node", "label")).alias("hub"))
    return own.join(hub, "bucket").where("label != hub.label").select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, numerator: int = NUMERATOR, crowd: int = CROWD) -> DataFrame:
    """Component of every document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if their sets have a Jaccard similarity of ``numerator`` hundredths or more.
    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Null, empty and blank texts
    have no shingles and stay alone. A row whose doc_id is null stays alone, its component_id is null
    and it is kept. Rows that repeat a doc_id share its component. An empty table gives no rows.
    Buckets with more than ``crowd`` members outside their largest component are split by rare shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = materialise(signatures(docs), "signatures")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    copies = full.groupBy("digest").agg(F.min("doc_id").alias("node"))
    reps = full.join(copies.select("node").distinct(), F.col("doc_id") == F.col("node"), "left_semi")
    buckets = reps.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    members = materialise(buckets.join(hubs, "bucket").select("bucket", F.lit(False).alias("split"), "node", "hub"), "buckets")
    in_buckets = members.select("node").distinct()
    sets = materialise(docs.join(in_buckets, F.col("doc_id") == F.col("node"), "left_semi").mapInArrow(K.tidy(_full_sets), f"node long, n long, {', '.join(f'{c} long' for c in _SKETCH)}, shingles array<long>"), "sets")
    sketches = sets.drop("shingles")

    def seen_again() -> DataFrame:
        """A representative of one set whose doc_id is also on a row with another set."""
        return full.join(copies, "digest").where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    tables = [_linked(members.where("node != hub").groupBy(F.col("node").alias("a")).agg(F.min("hub").alias("b")), sketches, sets, numerator)]
    labels = components(_union(tables))

    def link(pairs: DataFrame) -> None:
        nonlocal labels
        new = _linked(pairs, sketches, sets, numerator)
        if new.isEmpty():
            release(new)
            return
        tables.append(new)
        old, labels = labels, components(_union(tables))
        release(old)

    link(_to_hubs(members, labels))
    bare = members.select("bucket", "split", "node")
    crowded = materialise(_mixed(bare, labels)[1].where(F.col("rest") > crowd).select("bucket"), "crowded")
    if not crowded.isEmpty():
        parts = materialise(_by_rare_shingles(bare.join(crowded, "bucket", "left_semi"), sets, numerator), "rare-shingles")
        link(_to_hubs(parts, labels))
        bare = bare.join(crowded, "bucket", "left_anti").unionByName(parts)
    own_bands = reps.select(F.col("doc_id").alias("node"), "bands")
    for nearest in (2, None):
        more = materialise(_remaining(bare, labels, sketches, own_bands, nearest, numerator), "remaining", batch_rows=16)
        found = not more.isEmpty()
        if found:
            with scratch(sets.sparkSession):
                new = materialise(_confirmed(more, sets, numerator), "links", keep=True)
            if not new.isEmpty():
                tables.append(new)
                old, labels = labels, components(_union(tables))
                release(old)
        release(more)
        if not found:
            break
    repeated = full.groupBy("doc_id").agg(F.countDistinct("digest").alias("k")).where("k > 1").select("doc_id")
    if not repeated.isEmpty():
        again = seen_again().join(repeated, F.col("a") == F.col("doc_id"), "left_semi").select("a", "b")
        labels = components(_union([*tables, again]))
    release(members, sets, crowded, *tables)
    roots = copies.join(labels, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    found = sig.join(roots, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
