"""String similarities that Spark lacks, as Arrow functions over arrays of distinct pairs, and bounds that cut pairs before.

Jaro-Winkler runs over NumPy matrices of code points, a whole batch at a time. :func:`may_reach` is an upper
bound of it in Catalyst: filter by it first, so that few pairs leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

NEAR_WORD, NEAR_NAME = 0.90, 0.94


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in rows padded with -1, and the lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), max(1, int(size.max(initial=0)))), -1, np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def winkler_batch(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler of each pair; a common prefix of up to four counts only beyond a similarity of 0.7."""
    if not a:
        return np.zeros(0)
    x, n = _codes(a)
    y, m = _codes(b)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    place = np.arange(y.shape[1])
    used, hit = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    rows = np.arange(len(a))
    for i in range(x.shape[1]):
        fits = (y == x[:, i, None]) & ~used & (np.abs(place - i) <= reach[:, None]) & (x[:, i, None] >= 0)
        first = fits.argmax(axis=1)
        found = fits[rows, first]
        hit[:, i] = found
        used[rows[found], first[found]] = True
    common = hit.sum(axis=1)
    in_order = lambda codes, mask: np.take_along_axis(codes, np.argsort(~mask, axis=1, kind="stable"), axis=1)
    width = min(x.shape[1], y.shape[1])
    matched = np.arange(width) < common[:, None]
    swaps = ((in_order(x, hit)[:, :width] != in_order(y, used)[:, :width]) & matched).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(common > 0, (common / n + common / m + (common - swaps) / common) / 3, 0.0)
    head = min(4, width)
    prefix = np.cumprod((x[:, :head] == y[:, :head]) & (x[:, :head] >= 0), axis=1).sum(axis=1)
    return np.where(plain > 0.7, plain + 0.1 * prefix * (1 - plain), plain)


def winkler(a: str, b: str) -> float:
    """One pair; for more, :func:`winkler_batch` takes them all at once."""
    return float(winkler_batch([a], [b])[0])


#: Letters up to which a word's places fit in the bits of a number, and cells of the grid that are filled at a time.
_BITS, _GRID = 64, 1 << 14
#: Numbers whose lowest k bits are set.
_BELOW = np.array([(1 << k) - 1 for k in range(_BITS + 1)], np.uint64)


def winkler_grid(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Whether each of ``a`` is at least ``least`` alike each of ``b``, as :func:`winkler_batch` counts it: rows of ``a``, columns of ``b``.

    A letter's places in all words of ``b`` are the bits of one row of numbers, so a letter of ``a`` takes its partners in all of these in a few
    operations. Only what enough common letters allow is looked at for their order. Longer words are compared pair by pair.
    """
    out = np.zeros((len(a), len(b)), bool)
    x, n = _codes(a)
    y, m = _codes(b)
    if least <= 0.7 or not len(a) or not len(b):  # a common prefix must not be what lifts a pair over 0.7
        return winkler_batch([u for u in a for _ in b], list(b) * len(a)).reshape(out.shape) >= least
    rows, columns = np.flatnonzero((n > 0) & (n <= _BITS)), np.flatnonzero(m <= _BITS)
    for k, u in enumerate(a):
        rest = range(len(b)) if n[k] > _BITS else np.flatnonzero(m > _BITS)
        if len(rest):
            out[k, rest] = winkler_batch([u] * len(rest), [b[j] for j in rest]) >= least
    y, m = y[columns, :_BITS], m[columns]
    if not len(columns):
        return out
    letters, at = np.unique(y, return_inverse=True)
    at = at.reshape(y.shape)
    places = np.zeros((len(letters) + 1, len(columns)), np.uint64)  # the last row: letters that no word of b has
    for j in range(y.shape[1]):
        there = y[:, j] >= 0
        places[at[there, j], np.flatnonzero(there)] |= np.uint64(1 << j)
    one = np.uint64(1)
    sizes, of_size = np.unique(np.maximum(m, 1), return_inverse=True)

    def enough(common: np.ndarray, swaps: np.ndarray | int, prefix: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            plain = np.where(common > 0, (common / n + common / m + (common - swaps) / common) / 3, 0.0)
        return np.where(plain > 0.7, plain + 0.1 * prefix * (1 - plain), plain) >= least

    for size in np.unique(n[rows]):
        mine = rows[n[rows] == size]
        reach = np.maximum(np.maximum(size, m) // 2 - 1, 0)
        near = np.array([_BELOW[np.minimum(i + reach + 1, _BITS)] ^ _BELOW[np.minimum(np.maximum(i - reach, 0), _BITS)] for i in range(size)])
        # for each length of the common prefix and each word of b: how many common letters do at best
        could = enough(np.arange(_BITS + 1)[:, None, None], 0, np.arange(5)[:, None], sizes, size)
        need = np.where(could.any(axis=0), could.argmax(axis=0), 255).astype(np.uint8)[:, of_size]
        step = max(1, _GRID // len(columns))
        for first in range(0, len(mine), step):
            own = mine[first : first + step]
            codes = x[own, :size]
            row = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
            row = np.where(letters[row] == codes, row, len(letters))
            used = np.zeros((len(own), len(columns)), np.uint64)
            took = np.empty((size, *used.shape), bool)
            for i in range(size):
                fits = places[row[:, i]]
                fits &= near[i]
                fits &= ~used
                fits &= -fits  # the first place
                used |= fits
                np.not_equal(fits, 0, out=took[i])
            common = np.bitwise_count(used)
            may, same = common >= need[0], np.ones(used.shape, bool)
            for i in range(min(4, size, y.shape[1])):
                same &= codes[:, i, None] == y[:, i]
                may |= same & (common >= need[i + 1])
            open_ = np.flatnonzero(may.any(axis=0))
            if not len(open_):
                continue
            left, swaps, prefix = used[:, open_], np.zeros((len(own), len(open_)), np.uint8), np.zeros((len(own), len(open_)), np.int64)
            narrow = np.ascontiguousarray(places[:, open_])
            for i in range(size):
                taken = took[i][:, open_]
                next_ = left & -left
                swaps += taken & ((narrow[row[:, i]] & next_) == 0)
                left ^= next_ * taken
            same = np.ones(prefix.shape, bool)
            for i in range(min(4, size, y.shape[1])):
                same &= codes[:, i, None] == y[open_, i]
                prefix += same
            out[np.ix_(own, columns[open_])] = enough(common[:, open_].astype(np.int64), swaps.astype(np.int64) // 2, prefix, m[open_], size)
    return out


#: Cells of the tables that :func:`damerau_batch` fills at a time.
_CELLS = 1 << 22


def damerau_batch(a: list[str], b: list[str]) -> np.ndarray:
    """Edits by insertion, deletion, substitution and swaps of neighbours, substrings edited freely, of each pair.

    The table of a pair is filled cell by cell, each cell for all pairs of about the same length at once.
    """
    out = np.zeros(len(a), np.int64)
    size = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    order = np.argsort(size, kind="stable")
    first = 0
    while first < len(a):
        cells = (size[order[first:]] + 2) ** 2
        upto = first + max(1, int(np.searchsorted(np.arange(1, len(cells) + 1) * cells, _CELLS, "right")))
        mine = order[first:upto]
        out[mine] = _damerau([a[k] for k in mine], [b[k] for k in mine])
        first = upto
    return out


def _damerau(a: list[str], b: list[str]) -> np.ndarray:
    x, n = _codes(a)
    y, m = _codes(b)
    rows, most = np.arange(len(a)), n + m
    d = np.empty((x.shape[1] + 2, y.shape[1] + 2, len(a)), np.int64)
    d[0], d[:, 0] = most, most
    d[1:, 1] = np.arange(x.shape[1] + 1)[:, None]
    d[1, 1:] = np.arange(y.shape[1] + 1)[:, None]
    seen = np.zeros((y.shape[1], len(a)), np.int64)  # the last row whose letter is the column's
    for i in range(1, x.shape[1] + 1):
        same = y.T == x[:, i - 1]
        met = np.zeros(len(a), np.int64)  # the last column of this row whose letter is the row's
        for j in range(1, y.shape[1] + 1):
            k = seen[j - 1]
            swapped = d[k, met, rows] + (i - k - 1) + 1 + (j - met - 1)
            d[i + 1, j + 1] = np.minimum(np.minimum(d[i, j] + ~same[j - 1], d[i, j + 1] + 1), np.minimum(d[i + 1, j] + 1, swapped))
            met = np.where(same[j - 1], j, met)
        seen[same] = i
    return d[n + 1, m + 1, rows]


def damerau(a: str, b: str) -> int:
    return int(damerau_batch([a], [b])[0])


def _pairs(batch: Callable[[list[str], list[str]], list], kind: str):
    """An Arrow function that works on the distinct pairs of a batch; a null on either side gives null."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = pd.DataFrame({"a": a.to_numpy(), "b": b.to_numpy()})
        known = pairs.dropna().drop_duplicates()
        known["v"] = list(batch(known["a"].tolist(), known["b"].tolist()))
        return pairs.merge(known, "left", ["a", "b"])["v"].astype(object).where(lambda v: v.notna(), None)

    return run


def jaro_winkler(a, b):
    return _pairs(winkler_batch, "double")(a, b)


def damerau_levenshtein(a, b):
    return _pairs(damerau_batch, "int")(a, b)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """False only if the Jaro-Winkler similarity of two strings is below ``least``: a bound by their letters and lengths.

    Letters of one that the other lacks can't match; the rest, in order and with a common prefix of four, is the best case.
    """
    only = lambda x, y: F.length(F.call_function("translate", x, y, F.lit("")))
    common = F.least(F.length(a) - only(a, b), F.length(b) - only(b, a))
    plain = (common / F.greatest(F.length(a), F.lit(1)) + common / F.greatest(F.length(b), F.lit(1)) + 1) / 3
    same = lambda k: F.substring(a, 1, k) == F.substring(b, 1, k)
    prefix = F.when(same(4), 4).when(same(3), 3).when(same(2), 2).when(same(1), 1).otherwise(0)
    return plain + F.lit(0.1) * prefix * (1 - plain) >= least - 1e-9


def near_words(a: list[str], b: list[str]) -> np.ndarray:
    """Pairs of words a slip apart: alike, and about as long."""
    size = np.abs(np.fromiter(map(len, a), int, len(a)) - np.fromiter(map(len, b), int, len(b)))
    return (winkler_batch(a, b) >= NEAR_WORD) & (size <= 1)


def typo_equal_batch(a: list[str], b: list[str]) -> np.ndarray:
    """Whether the names of each pair are equal but for slips: word by word, or as a whole. Empty names equal nothing."""
    out = np.fromiter((bool(x) and x == y for x, y in zip(a, b, strict=True)), bool, len(a))
    open_ = [k for k in np.flatnonzero(~out) if a[k] and b[k]]
    split = [(k, a[k].split(), b[k].split()) for k in open_]
    flat = [(k, u, v) for k, x, y in split if len(x) == len(y) for u, v in zip(x, y, strict=True)]
    if flat:
        owner, us, vs = zip(*flat, strict=True)
        good = near_words(list(us), list(vs))
        owner = np.array(owner)
        worst = np.ones(len(a), bool)
        np.logical_and.at(worst, owner, good)
        out[np.unique(owner)] |= worst[np.unique(owner)]
    rest = [k for k in open_ if not out[k] and abs(len(a[k]) - len(b[k])) <= 1]
    if rest:
        out[rest] = winkler_batch([a[k] for k in rest], [b[k] for k in rest]) >= NEAR_NAME
    return out


def typo_equal(a: str, b: str) -> bool:
    return bool(typo_equal_batch([a], [b])[0])


def near_any(words: list[str], others: list[str]) -> list[np.ndarray]:
    """For each row of two lists of words, joined by spaces: which of the first have a near word among the second."""
    split = [(x.split(), y.split()) for x, y in zip(words, others, strict=True)]
    flat = [(u, v) for x, y in split for u in x for v in y]
    near = near_words(*map(list, zip(*flat, strict=True))) if flat else np.zeros(0, bool)
    out, at = [], 0
    for x, y in split:
        out.append(near[at : at + len(x) * len(y)].reshape(len(x), len(y)).any(axis=1))
        at += len(x) * len(y)
    return out


def is_typo_equal(a, b):
    return _pairs(typo_equal_batch, "boolean")(a, b)
