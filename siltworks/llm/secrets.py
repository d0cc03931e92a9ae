"""Secret scans: a keyword automaton finds where anchored expressions are tried; checksums confirm.

Kinds without a keyword (long hexadecimal runs) are found by run lengths over the byte buffer. Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import kernels as K

KINDS = ("assign", "access", "hex", "checked")
BASE_KINDS = KINDS[:3]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: Tokens of these prefixes hold 30 characters and their CRC-32 in six base-62 digits.
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
_CHECKED = re.compile(r"(?:ghp|gho|ghu|ghs|ghr|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = K.byte_table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x66)

_automaton = None


def _keywords():
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            _automaton.add_word(word, ("assign", len(word)))
        _automaton.add_word("akia", ("access", 4))
        for word in CHECKED_PREFIXES:
            _automaton.add_word(word, ("checked", len(word)))
        _automaton.make_automaton()
    return _automaton


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of a token's body."""
    x, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        x, d = divmod(x, 62)
        out = _BASE62[d] + out
    return out


def keyword_spans(text: str, lowered: str) -> list[tuple[int, int, str]]:
    """Spans of the kinds that have keywords. ``lowered`` is the text with A-Z in lower case."""
    out: list[tuple[int, int, str]] = []
    upto = dict.fromkeys(KINDS, 0)
    for end, (kind, size) in _keywords().iter(lowered):
        start = end - size + 1
        if start < upto[kind]:
            continue
        if kind == "assign":
            m = _ASSIGN.match(text, start)
            good = m and len(m[2]) >= ASSIGN_LEAST
        elif kind == "access":
            m = _ACCESS.match(text, start)
            good = m and len(m[0]) >= ACCESS_LEAST
        else:
            m = _CHECKED.match(text, start)
            good = m and checksum(m[1]) == m[2]
        if m:
            upto[kind] = m.end()
        if good:
            out.append((m.start(), m.end(), kind))
    return out


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end, _ = K.words(data, offsets, _HEX)
    long = end - start >= HEX_LEAST
    start, end = start[long], end[long]
    return start, end, np.searchsorted(start, offsets)


_COLUMN = StructField("secrets", ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _found(texts: pa.Array) -> Iterator[list[tuple[int, int, str]]]:
    """Spans of each text in order."""
    data, offsets = K.text_buffer(texts)
    for i, j in K.slices(offsets):
        lo = offsets[i]
        part = data[lo : offsets[j]]
        low = K.LOWER[part].tobytes()
        raw = part.tobytes()
        start, end, at = _runs(part, offsets[i : j + 1] - lo)
        for d in range(j - i):
            x, y = offsets[i + d] - lo, offsets[i + d + 1] - lo
            found = keyword_spans(raw[x:y].decode(), low[x:y].decode())
            if at[d + 1] > at[d]:
                point = np.cumsum((part[x:y] & 0xC0) != 0x80)
                for s, e in zip(start[at[d] : at[d + 1]] - x, end[at[d] : at[d + 1]] - x, strict=True):
                    first = int(point[s]) - 1
                    found.append((first, first + int(e - s), "hex"))
            yield sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": k, "start": s, "end": e} for s, e, k in found] for found in _found(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _SPANS)], names=[*batch.schema.names, "secrets"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secrets``, an array of (kind, start, end) by start, then kind as in ``KINDS``.

    Null and empty texts hold none; a very long text is searched whole. Matches of one kind never overlap; those of several
    kinds may. Repeated rows are each judged alike. A column named secrets that came in is replaced, others pass
    through. An empty table gives no rows.
    """
    plain = docs.drop("secrets").withColumn("text", F.col("text").cast("string"))
    return plain.mapInArrow(K.tidy(_scan), StructType([*plain.schema.fields, _COLUMN]))


def redact(docs: DataFrame, marker: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch that secrets cover replaced by ``marker``; other texts, null ones too, stay as they are.

    Every row and column stays, repeated rows alike; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k, found in enumerate(_found(batch.column("text"))):
                if found:
                    out, at = [], 0
                    for start, end, _ in found:
                        if start >= at:
                            out += [texts[k][at:start], marker]
                        at = max(at, end)
                    texts[k] = "".join([*out, texts[k][at:]])
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    return docs.mapInArrow(K.tidy(run), docs.schema)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document."""
    found = find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
