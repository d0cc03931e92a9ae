"""Building blocks for text rules: Catalyst expressions only."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: blanks, without the vertical tab that Java's ``\s`` also takes
BLANK = r"[ \t\n\f\r]"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often ``use`` names it; also keeps plans small."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def text(c: Column | str) -> Column:
    """The column as a string, null as empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def rewrite(c: Column, *steps: tuple[str, str]) -> Column:
    """Regular-expression replacements, one after the other, each of every match."""
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def is_all(c: Column, pattern: str) -> Column:
    """Whether the pattern takes the whole string."""
    return c.rlike(rf"\A(?:{pattern})\z")


def group(c: Column, pattern: str, index: int = 1) -> Column:
    """A group of the first match, empty if there is none."""
    return F.regexp_extract(c, pattern, index)


def squeeze(c: Column) -> Column:
    """Blanks at the ends dropped, runs of them made one."""
    return F.trim(F.regexp_replace(c, BLANK + "+", " "))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _folds() -> tuple[str, str]:
    """Precomposed letters whose decomposition is one ASCII letter with marks."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _folds()
WIDE = "".join(chr(0xFF01 + k) for k in range(94))
NARROW = "".join(chr(0x21 + k) for k in range(94))


def fold_accents(c: Column) -> Column:
    """Letters without their accents, whether composed or not; letters such as Ø and Ł stay."""
    return F.translate(F.regexp_replace(c, "[̀-ͯ]", ""), ACCENTED, PLAIN)


def natural_key(c: Column) -> Column:
    """Digit runs padded to 12, so that text order is number order."""
    runs = F.regexp_extract_all(c, F.lit("([0-9]+|[^0-9]+)"))
    return F.array_join(F.transform(runs, lambda t: F.when(t.rlike("^[0-9]"), F.lpad(t, 12, "0")).otherwise(t)), "")


def number_or_null(c: Column, kind: str = "int") -> Column:
    """A coded number such as ``12.0`` or ``7``, rounded half to even; anything else is null."""
    return F.rint(c.try_cast("double")).cast(kind)


def day_or_null(c: Column) -> Column:
    """The date in the first ten characters, which must read year-month-day."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), head.try_cast("date"))
