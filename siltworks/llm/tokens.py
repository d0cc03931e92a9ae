"""Token ids of whole texts, and their file format: chunks of planes with an index.

A chunk holds ``CHUNK_IDS`` ids of one ordered stream (the last one fewer). Its ids are transposed into
byte planes or bit planes, each compressed with zstandard; planes of high bytes shrink to almost
nothing. A chunk's row also has its place and the documents that begin or go on in it, so any
document can be found from the index columns alone. Chunks are rows of a Parquet table, which any file
system that Spark knows can hold and whose commit survives lost executors.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .storage import arrow_batches, new_path

END_ID = 0
CHUNK_IDS = 1 << 16
#: Distinct pieces that a worker keeps; once full, rarer ones are encoded each time.
CACHE_PIECES = 200_000
_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Texts of these characters split the same way here as in the tokenizers library; others go there whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞]*+")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\t\n\r {_LETTER}{_DIGIT}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Byte-level BPE spells bytes as characters: printable ones as themselves, the rest from 256 on in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _Pieces(dict):
    """Ids of pieces as the pre-tokenizer makes them, by the library's model."""

    def __init__(self, tokenizer) -> None:
        self.model = tokenizer.model

    def __missing__(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(_SPELLED)
        out = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(self) < CACHE_PIECES:
            self[piece] = out
        return out


class Encoder:
    """Little-endian 32-bit ids of a text by the tokenizers library.

    Byte-level BPE never merges across the pieces that its pre-tokenizer makes, so each distinct piece
    is encoded once and kept. Texts that hold an added token of the vocabulary file go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.pieces = _Pieces(self.tokenizer)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _PLAIN.fullmatch(text) and not self.added.search(text):
            return b"".join(map(self.pieces.__getitem__, _SPLIT.findall(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_END = np.array([END_ID], "<u4").tobytes()


def to_planes(ids: np.ndarray, bits: bool = False, level: int = 3) -> list[bytes]:
    """Compressed planes of 32-bit ids, low byte (or bit) first."""
    plane = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if bits:
        single = [np.unpackbits(np.ascontiguousarray(row)[:, None], axis=1, bitorder="little") for row in plane]
        plane = [np.packbits(byte[:, b]) for byte in single for b in range(8)]
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(np.ascontiguousarray(row).tobytes()) for row in plane]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of :func:`to_planes`."""
    unpack = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(unpack.decompress(p), np.uint8) for p in planes]
    if len(rows) == 32:
        out = np.zeros((n, 4), np.uint8)
        for k, row in enumerate(rows):
            out[:, k // 8] |= np.unpackbits(row)[:n] << (k % 8)
        return out.reshape(-1).view("<u4")
    return np.ascontiguousarray(np.stack(rows, axis=1)).reshape(-1).view("<u4") if n else np.zeros(0, "<u4")


_CHUNK = "part int, chunk int, first long, n_ids int, planes array<binary>, doc_ids array<long>, ordinals array<long>, offsets array<int>, goes_on array<boolean>"
_CHUNK_TYPES = {"chunk": pa.int32(), "first": pa.int64(), "n_ids": pa.int32(), "planes": pa.list_(pa.binary()), "doc_ids": pa.list_(pa.int64()), "ordinals": pa.list_(pa.int64()), "offsets": pa.list_(pa.int32()), "goes_on": pa.list_(pa.bool_())}


def _write_chunks(path: str, bits: bool, chunk_ids: int):
    def row(chunk: int, first: int, ids: np.ndarray, docs: list[tuple]) -> dict:
        last = first + len(ids)
        inside = [d for d in docs if d[2] < last]
        return {
            "chunk": chunk, "first": first, "n_ids": len(ids), "planes": to_planes(ids, bits),
            "doc_ids": [d[0] for d in inside], "ordinals": [d[1] for d in inside], "offsets": [max(d[2] - first, 0) for d in inside],
            "goes_on": [d[2] < first or d[3] > last for d in inside],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(path)
        kept: list[bytes] = []
        docs: list[tuple] = []  # id, ordinal, start and end in the partition's stream
        chunk = first = ordinal = end = 0

        def batch_of(made: list[dict]) -> pa.RecordBatch:
            columns = [pa.array([r[c] for r in made], t) for c, t in _CHUNK_TYPES.items()]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(made), pa.int32()), *columns], names=["part", *_CHUNK_TYPES])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = encode(text.as_py()) + _END
                docs.append((doc_id, ordinal, end, end + len(own) // 4))
                kept.append(own)
                end, ordinal = docs[-1][3], ordinal + 1
                if end - first >= chunk_ids:
                    ids, made, at = np.frombuffer(b"".join(kept), "<u4"), [], 0
                    while len(ids) - at >= chunk_ids:
                        made.append(row(chunk, first, ids[at : at + chunk_ids], docs))
                        at, chunk, first = at + chunk_ids, chunk + 1, first + chunk_ids
                        docs = [d for d in docs if d[3] > first]
                    kept = [ids[at:].tobytes()]
                    yield batch_of(made)
        if end > first:
            yield batch_of([row(chunk, first, np.frombuffer(b"".join(kept), "<u4"), docs)])

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, partitions: int | None = None, bits: bool = False, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode every whole text, append id 0, and write the ids in ascending doc_id order to ``path``.

    Rows are dealt by ranges of (doc_id, text), so the partitions' streams, one after the other, are
    in order; a null doc_id comes first, rows that repeat one stand side by side. Null and empty texts are id 0 alone; a long
    text goes on in several chunks. Other columns, whatever their names, are ignored. An empty table writes no chunk.
    """
    tokenizer = tokenizer or tokenizer_path()
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = plain.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    with arrow_batches(docs.sparkSession):
        ordered.mapInArrow(K.tidy(_write_chunks(tokenizer, bits, chunk_ids)), _CHUNK).write.option("compression", "none").parquet(path)


def _read_chunks(bases: dict[int, int], whole: bool):
    names = ["part", "ordinal", "doc_id", "start", "n_tokens", "ids_crc32", "seq", "ids"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                cut = [*r["offsets"], r["n_ids"]]
                wanted = [k for k in range(len(r["offsets"])) if r["goes_on"][k] != whole]
                if not wanted:
                    continue
                ids = from_planes(r["planes"], r["n_ids"])
                base = bases[r["part"]] + r["first"]
                for k in wanted:
                    own = ids[cut[k] : cut[k + 1]].tobytes()
                    out.append((r["part"], r["ordinals"][k], r["doc_ids"][k], base + cut[k], len(own) // 4, zlib.crc32(own) if whole else None, r["chunk"], None if whole else own))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)

    return run


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = []
        for pieces in batch.column("pieces").to_pylist():
            value = 0
            for p in pieces:
                value = zlib.crc32(p["ids"], value)
            crc.append(value)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files at ``path``; no rows if they hold no chunk."""
    chunks = spark.read.schema(_CHUNK).parquet(path)
    sizes = chunks.groupBy("part").agg(F.sum("n_ids").cast("long").alias("n")).collect()
    bases, total = {}, 0
    for r in sorted(sizes, key=lambda r: r.part):
        bases[r.part] = total
        total += r.n
    schema = "part int, ordinal long, doc_id long, start long, n_tokens long, ids_crc32 long, seq int, ids binary"
    out = ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = chunks.mapInArrow(_read_chunks(bases, True), schema).select(*out)
    cut = chunks.where(F.exists("goes_on", lambda s: s)).mapInArrow(_read_chunks(bases, False), schema)
    pieces = cut.groupBy("part", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("pieces"))
    return whole.union(pieces.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` to a new folder beside the checkpoints and read the files back.

    One row for each row of ``docs``, as :func:`write_ids` orders them; an empty table gives none.
    """
    path = new_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer)
    return read_ids(docs.sparkSession, path)
