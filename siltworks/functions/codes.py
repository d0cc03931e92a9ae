"""Legal-standard codes: family, section key and citation as one struct column.

Each jurisdiction writes its codes in its own way, today or in an older packed form. All of this is data: ``FAMILIES``
says by which form (and which state, where forms clash) a code's family is known, ``FORMS`` how the ways of
writing of a family are read. A form is a pattern, a template of the key, and the styles in which what follows
is shown in a citation. One interpreter, :func:`parse`, turns these tables into one expression.

Templates name the pattern's groups as ``{group:style}``. Styles:

========  =============================================================
``=``     as it is
``a``     lower case
``1``     number without leading zeros
``.``     decimal part: a point and the number, nothing for zeros
``i``     small Roman numeral of a number, nothing for zero
========  =============================================================
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from .text import group, is_all, let, matches, null_if_empty, squeeze, text

lit, cat = F.lit, F.concat
LARGEST_ROMAN = 20


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + sign * (n // value), n % value
    return out


ROMAN = tuple(_roman(n) for n in range(1, LARGEST_ROMAN + 1))


def unpad(c: Column) -> Column:
    """Leading zeros off a number of up to nine digits; other strings stay."""
    return F.when(is_all(c, "[0-9]{1,9}"), c.try_cast("bigint").cast("string")).otherwise(c)


def small_roman(c: Column) -> Column:
    """The number as a Roman numeral up to ``LARGEST_ROMAN``, nothing for zero."""
    n = c.try_cast("int")
    return F.when(n > LARGEST_ROMAN, n.cast("string")).when(n > 0, F.get(F.array(*map(lit, ROMAN)), n - 1)).otherwise("")


STYLES: dict[str, Callable[[Column], Column]] = {
    "=": lambda c: c,
    "a": F.lower,
    "1": unpad,
    ".": lambda c: F.when(is_all(c, "0*"), "").otherwise(cat(lit("."), unpad(c))),
    "i": small_roman,
}


@dataclass(frozen=True)
class Tail:
    """What follows a packed code: a pattern whose groups are shown in parentheses, each in its style.

    ``dense`` ignores everything but letters and digits. A tail that doesn't fit is shown as it is, or, if
    ``first_letter``, with its first letter as a paragraph.
    """

    pattern: str
    styles: str
    dense: bool = False
    first_letter: bool = False


@dataclass(frozen=True)
class Form:
    """A way of writing. The last group of ``pattern`` is the rest; ``packed`` shows groups before it as paragraphs.

    The rest is either a chain of parenthesised parts, those at the depths ``lower`` in lower case, or a :class:`Tail`.
    """

    family: str
    pattern: str
    key: str
    cite: str | None = None
    packed: str = ""
    lower: tuple[int, ...] | None = None
    tail: Tail | None = None


# By which form and state a family is known; the first that fits counts. No states: any site or none.
FAMILIES: tuple[tuple[str, tuple[str, ...] | None, str], ...] = (
    ("general_duty", None, r"^GENERAL DUTY|^5A000[0-9]"),
    ("unknown", None, r"\A[^0-9]*\z|�"),
    ("federal_1926", None, r"^1926[0-9]{4}([^0-9]|\z)"),
    ("federal_1910", None, r"^1910[0-9]{4}([^0-9]|\z)"),
    ("federal_other", None, r"^19(03|04|08|15|16|17|18|28|60)[0-9]{4}([^0-9]|\z)"),
    ("state_WA", None, r"^296-[0-9]+-[0-9]"),
    ("state_OR", None, r"^OAR 437-[0-9]{3}-[0-9]{4}"),
    ("state_MI", ("MI", ""), r"^(408|325)\.[0-9]{5}|^408\.[0-9]{4}([^0-9]|\z)"),
    ("state_OR", ("OR",), r"^40 CFR [0-9]+\.[0-9]+|^7[0-9]{6}"),
    ("state_WA", ("WA",), r"^[0-9]{8}"),
    ("state_MI", ("MI",), r"^(408|325|309)[0-9]{5}|^338\.[0-9]{4}|^RULE ?\(?[0-9]"),
    ("state_CA", ("CA",), r"\A[0-9]{3,5}(?:\.[0-9]+)?[A-Z]?(\(.*)?\z|\A[0-9]{3,8}( .*)?\z"),
    ("state_MI", ("",), r"^(408|325)[0-9]{5}"),
    ("state_WA", ("",), r"^155[0-9]{5}"),
    ("state_CA", ("",), r"\A[0-9]{4}(?:\.[0-9]+)?(\(.*)?\z"),
)

_FEDERAL = Tail(r"([A-Z]?)([0-9]{0,3})(X{0,3}(?:IX|IV|V?I{0,3}))([A-Z]?)([0-9]{0,2})", "a1a=1", dense=True, first_letter=True)
_WASHINGTON = Tail(r"([A-Z]?)([0-9]{0,2})([A-Z]?)([0-9]{0,2})", "ai=1", dense=True)
_OREGON = Tail(r"([A-Z])(?: +([A-Z]))?", "a=")
_MICHIGAN = Tail(r"([A-Z])([0-9]{1,2})?", "a1")
_CALIFORNIA = Tail(r"([A-Z])([0-9]{1,2})?(?: ([A-Z]+))?", "a1=")
_PAIRS = "((?:[0-9]{2})?)(?:([0-9]{2})|[0-9]?)"
_CFR = r"\A(.{4})(.{0,4})(.*)\z"

# The ways of writing of each family; the first that fits counts.
FORMS: tuple[Form, ...] = (
    Form("general_duty", r"\A5A000([0-9])(.*)\z", "5(a)({1:=})"),
    Form("general_duty", r"\A(.*)\z", "5(a)(1)"),
    Form("federal_1926", _CFR, "{1:=}.{2:1}", tail=_FEDERAL),
    Form("federal_1910", _CFR, "{1:=}.{2:1}", tail=_FEDERAL),
    Form("federal_other", _CFR, "{1:=}.{2:1}", tail=_FEDERAL),
    Form("state_WA", r"\A296-([0-9]+)-([0-9]+)([A-Z]?)(.*)\z", "WAC 296-{1:=}-{2:=}{3:a}", lower=(2, 3)),
    Form("state_WA", rf"\A([0-9]{{3}})00([0-9]{{3}})(?:{_PAIRS})(?![0-9]) ?(.*)\z", "WAC 296-{1:1}-{2:=}", packed="..11", tail=_WASHINGTON),
    Form("state_WA", r"\A([0-9]{3})00([0-9]{3})([0-9]{2})([0-9]{2})(.*)\z", "WAC 296-{1:1}-{2:=}", packed="..11", tail=_WASHINGTON),
    Form("state_WA", rf"\A([0-9]{{3}})([0-9]{{5}})(?:{_PAIRS})(?![0-9]) ?(.*)\z", "WAC 296-{1:1}-{2:=}", packed="..11", tail=_WASHINGTON),
    Form("state_WA", r"\A([0-9]{3})([0-9]{5})([0-9]{2})([0-9]{2})(.*)\z", "WAC 296-{1:1}-{2:=}", packed="..11", tail=_WASHINGTON),
    Form("state_OR", r"\AOAR 437-([0-9]{3})-([0-9]{4})([A-Z]?)(.*)\z", "OAR 437-{1:=}-{2:=}{3:=}", lower=(2, 4)),
    Form("state_OR", r"\A(40 CFR [0-9]+\.[0-9]+)(.*)\z", "{1:=}", lower=(1, 3)),
    Form("state_OR", r"\A70([0-7])([0-9]{4})([0-9]{0,2}) ?((?<= ).*|[A-Z].*|)\z", "OAR 437-00{1:=}-{2:=}", packed="..1", tail=_OREGON),
    Form("state_OR", r"\A(...)(.*)\z", "OR-OLD {1:=}", cite="OR {1:=}{2:=}"),
    Form("state_MI", r"\A(408|325)\.([0-9]{5})([A-Z]?)(.*)\z", "R {1:=}.{2:=}{3:a}", lower=(2, 3)),
    Form("state_MI", r"\A(408|338)\.([0-9]{4})(.*)\z", "MCL {1:=}.{2:=}", lower=(1, 3)),
    Form("state_MI", r"\ARULE ?\(?([0-9]+)\)?(.*)\z", "MI RULE {1:=}", cite="MI Rule {1:=}", lower=(2, 3)),
    Form("state_MI", rf"\A(408|325|309)0([0-9]{{4}})(?:{_PAIRS})(?![0-9])([A-Z]?)([0-9]?) ?(.*)\z", "MCL {1:=}.{2:=}", packed="..11a=", tail=_MICHIGAN),
    Form("state_MI", r"\A(408|325|309)0([0-9]{4})([0-9]{2})([0-9]{2})([A-Z]?)([0-9]?) ?(.*)\z", "MCL {1:=}.{2:=}", packed="..11a=", tail=_MICHIGAN),
    Form("state_MI", rf"\A(408|325|309)([0-9]{{5}})(?:{_PAIRS})(?![0-9])([A-Z]?)([0-9]?) ?(.*)\z", "R {1:=}.{2:=}", packed="..11a=", tail=_MICHIGAN),
    Form("state_MI", r"\A(408|325|309)([0-9]{5})([0-9]{2})([0-9]{2})([A-Z]?)([0-9]?) ?(.*)\z", "R {1:=}.{2:=}", packed="..11a=", tail=_MICHIGAN),
    Form("state_CA", r"\A([0-9]{3,5}(?:\.[0-9]+)?)([A-Z]?)(|\(.*)\z", "T8 CCR {1:=}{2:a}", lower=(1, 4)),
    Form("state_CA", r"\A6401([0-9]{4})(?: (.*))?\z", "LC 6401{1:.}", tail=_CALIFORNIA),
    Form("state_CA", r"\A(?:1430|4300)([0-9]{4})(?: (.*))?\z", "T8 CCR 14300.{1:1}", tail=_CALIFORNIA),
    Form("state_CA", r"\A([0-9]{3,4})([0-9]{4})(?: (.*))?\z", "T8 CCR {1:=}{2:.}", tail=_CALIFORNIA),
    Form("state_CA", r"\A([0-9]{3,6})(?: (.*))?\z", "T8 CCR {1:=}", tail=_CALIFORNIA),
)
# What a code of another state is known by, up to its paragraphs.
OTHER_BASE = r"\A([0-9]+) (?:[A-Z]{1,2}[0-9]{0,3}|[0-9]{1,3})(?: |\z)"


def normal(raw: Column | str) -> Column:
    return squeeze(F.upper(text(raw)))


def _join(parts: list[Column]) -> Column:
    return cat(*parts) if parts else lit("")


def _shown(groups: list[Column], styles: str) -> Column:
    """Groups in parentheses; empty ones and those whose style is missing are left out."""
    shown = [STYLES[s](g) for g, s in zip(groups, styles, strict=False) if s != "."]
    return _join([F.when(x != "", cat(lit("("), x, lit(")"))).otherwise("") for x in shown])


def _filled(template: str, groups: list[Column]) -> Column:
    parts = re.split(r"\{([0-9]):(.)\}", template)
    texts = [lit(t) for t in parts[::3]]
    named = [STYLES[s](groups[int(k) - 1]) for k, s in zip(parts[1::3], parts[2::3], strict=True)]
    return _join([x for pair in zip(texts, [*named, lit("")], strict=True) for x in pair])


def chain(rest: Column, lower: tuple[int, ...]) -> Column:
    """Parenthesised parts, numbers unpadded and letters of some depths in lower case; what follows the last one stays."""
    pieces = F.split(rest, r"\(")
    parts = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, lit(0))), lambda p: F.trim(F.substring_index(p, ")", 1)))
    styled = F.transform(parts, lambda p, k: F.when((k + 1).isin(*lower), F.lower(p)).otherwise(p))
    last = F.element_at(pieces, -1)
    after = F.when(F.contains(last, lit(")")), F.substring_index(last, ")", -1)).otherwise("")
    whole = cat(lit("("), F.array_join(F.transform(styled, unpad), ")("), lit(")"), after)
    return F.when(F.size(pieces) > 1, whole).otherwise(F.trim(rest))


def _tail(rest: Column, tail: Tail) -> Column:
    def read(x: Column) -> Column:
        raw, core = x["raw"], x["core"]
        pattern = rf"\A{tail.pattern}\z"
        groups = [group(core, pattern, k + 1) for k in range(re.compile(tail.pattern).groups)]
        own = F.trim(raw) if tail.first_letter else raw
        out = F.when(core == "", "") if tail.dense else F.when(raw == "", "")
        out = out.when(is_all(core, tail.pattern), _shown(groups, tail.styles))
        if tail.first_letter:
            out = out.when(matches(core, "^[A-Z]"), cat(lit("("), F.lower(F.left(core, lit(1))), lit(") "), F.trim(F.substring(own, 2, 1 << 20))))
        return out.otherwise(cat(lit(" "), own))

    core = F.regexp_replace(rest, "[^A-Z0-9]", "") if tail.dense else rest
    return let(F.struct(rest.alias("raw"), core.alias("core")), read)


def _read(s: Column, form: Form) -> Column:
    """``struct(section_key, standard_cite)`` of a code in this form."""
    groups = [group(s, "(?s)" + form.pattern, k + 1) for k in range(re.compile(form.pattern.replace(r"\z", r"\Z")).groups)]
    key = _filled(form.key, groups)
    rest = lit("")
    if form.lower is not None:
        rest = chain(groups[-1], form.lower)
    elif form.tail:
        rest = cat(_shown(groups[:-1], form.packed), _tail(groups[-1], form.tail))
    return F.struct(key.alias("section_key"), cat(_filled(form.cite, groups) if form.cite else key, rest).alias("standard_cite"))


def family(s: Column, state: Column) -> Column:
    """Family of a normalised code; codes that no family knows belong to the site's state."""
    known = lambda states, pattern: matches(s, "(?s)" + pattern) & (lit(True) if states is None else state.isin(*states))
    return reduce(lambda found, row: F.when(known(*row[1:]), row[0]).otherwise(found), reversed(FAMILIES), lit("state_other"))


def _other(s: Column, state: Column) -> Column:
    label = F.when(state != "", cat(state, lit(" "))).otherwise("")
    before = F.substring_index(s, "(", 1)
    base = F.when((before != "") & (before != s), before).otherwise(F.coalesce(null_if_empty(group(s, OTHER_BASE)), s))
    return F.struct(cat(label, F.trim(base)).alias("section_key"), cat(label, s).alias("standard_cite"))


def parse(raw: Column | str, state: Column | str | None = None) -> Column:
    """``struct(std_family, section_key, standard_cite)`` of a raw code and the state of its site."""
    own = F.struct(normal(raw).alias("s"), (F.upper(F.trim(text(state))) if state is not None else lit("")).alias("st"))
    known = let(own, lambda x: F.struct(x["s"].alias("s"), x["st"].alias("st"), family(x["s"], x["st"]).alias("family")))

    def read(x: Column) -> Column:
        s, own_family = x["s"], x["family"]
        unknown = F.struct(lit(None).cast("string").alias("section_key"), null_if_empty(s).alias("standard_cite"))
        out = F.when(own_family == "state_other", _other(s, x["st"]))
        for form in FORMS:
            out = out.when((own_family == form.family) & matches(s, "(?s)" + form.pattern), _read(s, form))
        return let(F.struct(own_family.alias("f"), out.otherwise(unknown).alias("r")), lambda y: F.struct(y["f"].alias("std_family"), y["r"]["section_key"].alias("section_key"), y["r"]["standard_cite"].alias("standard_cite")))

    return let(known, read)
