"""Vectorised text kernels over Arrow buffers.

A text column arrives as one byte buffer with offsets. The kernels below work on slices of that
buffer of about a quarter of a megabyte (or one document, if it is longer), so memory stays bounded and no
Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def release_memory() -> None:
    """Gives memory that this process holds but doesn't use back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that releases unused memory when a partition is done.

    Workers live on between stages, beside an executor whose heap needs the room.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        with np.errstate(over="ignore"):
            have = np.full(size, base, U64)
            have[0] = 1
            np.cumprod(have, out=have)
        if size <= 8 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose texts together hold at most ``limit`` bytes, or one document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes; :func:`span_hash` reads spans from them."""
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end) that depend on their content only."""
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * _power(_BASE_INV, len(prefix))[start] + (end - start).astype(U64))


def raw_hash(prefix: np.ndarray, n: int) -> np.ndarray:
    """Unmixed hashes of the ``n`` bytes from each position."""
    with np.errstate(over="ignore"):
        return (prefix[n:] - prefix[:-n]) * _power(_BASE_INV, len(prefix) - n)


def byte_table(allowed) -> np.ndarray:
    return np.array([allowed(c) for c in range(256)], bool)


#: words ``[^\x20\x09-\x0D]+``
NOT_SPACE = byte_table(lambda c: c != 0x20 and not 0x09 <= c <= 0x0D)
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z
LETTER_DIGIT = byte_table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80)
LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)


def words(data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; a word never crosses documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = allowed[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def gram_hash(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position, as far as the array reaches."""
    size = len(word_hash) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    out = np.zeros(size, U64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * U64(_BASE) + word_hash[j : j + size]
    return mix(out)
