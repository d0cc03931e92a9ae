"""Fill-in-the-middle: a text's middle moved behind its suffix, or behind suffix and prefix.

A text is decoded to an array of UTF-32 code points. Each has a class; a boundary stands wherever neighbouring classes
differ, so ``flatnonzero`` lists them all. Two ranks drawn from a digest of the id pick two boundaries, and the three slices
between them are encoded again, each after its marker. Nothing is shuffled and rows don't depend on each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels as K

#: Before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Texts in a hundred that are rearranged, and of those the ones whose suffix comes first.
RATE, SPM_RATE = 90, 20
SEED = "1"
#: An output batch is given on when it holds so many code points.
BATCH_POINTS = 1 << 21
_WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _class_table() -> np.ndarray:
    """Per code point below U+3001: 0 white space, 1 letter, digit or beyond ASCII, 2 any other sign."""
    table = np.ones(0x3001, np.uint8)
    for c in range(128):
        table[c] = 0 if chr(c).isspace() else 1 if chr(c).isalnum() else 2
    table[_WIDE_SPACES] = 0
    return table


_CLASS = _class_table()


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point; a boundary is where it changes.

    ``code_point``: each is a unit. ``word``: runs of white space, of letters and digits, of other signs. ``line``: up to and with
    a line feed.
    """
    if unit == "code_point":
        return np.arange(len(points))
    if unit == "word":
        return _CLASS[np.minimum(points, len(_CLASS) - 1)]
    if unit == "line":
        return np.cumsum(np.concatenate([[False], points[:-1] == 10])) if len(points) else np.zeros(0, np.int64)
    raise ValueError(f"no such unit: {unit}")


def boundaries(points: np.ndarray, unit: str = "code_point") -> np.ndarray:
    """Places a text may be cut at, its start and end included; one more than it has units."""
    if not len(points):
        return np.zeros(1, np.int64)
    own = classes(points, unit)
    inner = np.flatnonzero(own[1:] != own[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]])


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


_NAMES = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _rearrange(unit: str, rate: int, spm_rate: int, markers: tuple[str, str, str]):
    before, after, middle = markers

    def one(doc_id, text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        n = len(points)
        if not n or h3 % 100 >= rate or any(m in text for m in markers):
            return doc_id, n, "plain", None, None, text
        cuts = boundaries(points, unit)
        x, y = sorted((h1 % len(cuts), h2 % len(cuts)))
        p, q = int(cuts[x]), int(cuts[y])
        a, b, c = _text(points[:p]), _text(points[p:q]), _text(points[q:])
        if h4 % 100 < spm_rate:
            return doc_id, n, "spm", p, q - p, f"{after}{c}{before}{a}{middle}{b}"
        return doc_id, n, "psm", p, q - p, f"{before}{a}{after}{c}{middle}{b}"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=list(_NAMES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *draws = (batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))
            rows, held = [], 0
            for k, text in enumerate(batch.column(1)):
                rows.append(one(ids[k], text.as_py() or "", *(d[k] for d in draws)))
                held += rows[-1][1]
                if held >= BATCH_POINTS:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32 from the digest of ``seed:doc_id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "code_point", rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``, one row for each row of ``docs``.

    ``form`` is ``plain`` (the text as it is), ``psm`` or ``spm``, named by the order of the pieces. Null and empty texts are plain
    and empty, as are texts that hold a marker, which could not be taken apart again: these stay whole. Cuts
    depend on the id and the number of units alone: rows that repeat an id and a text are cut alike, a null id is drawn for as an
    empty one. A very long text is held whole, four bytes a code point, one at a time. Other columns, whatever their names, are
    ignored. An empty table gives no rows.
    """
    if len(set(markers)) != 3 or not all(markers):
        raise ValueError("three different markers are needed")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drawn = plain.select("doc_id", "text", *draws(F.col("doc_id"), seed))
    return drawn.mapInArrow(K.tidy(_rearrange(unit, rate, spm_rate, tuple(markers))), _SCHEMA)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that :func:`fill_in_middle` took apart, from its output and form alone.

    The first marker of each kind is the one put there: no text that is taken apart holds any, and none arises where a
    text meets a marker as long as no marker ends as another begins, which holds for those in angle brackets.
    """
    before, after, middle = (r"\Q" + m + r"\E" for m in markers)
    psm = F.split(F.substr(output, F.lit(len(markers[0]) + 1)), f"{after}|{middle}", -1)
    spm = F.split(F.substr(output, F.lit(len(markers[1]) + 1)), f"{before}|{middle}", -1)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every document."""
    made = fill_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn
), cuts AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), pieces AS (SELECT *, substr(t, 1, p) AS a, substr(t, p + 1, q - p) AS b, substr(t, q + 1) AS c FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (q - p)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""
