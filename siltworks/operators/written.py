"""Numbers and dates written in words: a small grammar folded over the words of a text.

``two hundred and forty-one``, ``twelve hundred``, ``three million five``, ``the fifth of March 2020``, ``March 5, 2020``. A number
ends at the first word or sign that can't go on with it; a comma ends it too, but may stand in a date.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siltworks.functions.text import let

# Words of numbers and months.
ONES = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
TEENS = ("ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
ORDINAL_ONES = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth")
ORDINAL_TEENS = ("tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth")
ORDINAL_TENS = ("twentieth", "thirtieth", "fortieth", "fiftieth", "sixtieth", "seventieth", "eightieth", "ninetieth")
SCALES = (("thousand", 10**3), ("million", 10**6), ("billion", 10**9))
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
FILLERS = ("of", "the", ",")
_TOKEN = r"[0-9]+(?:st|nd|rd|th)?(?![0-9a-z])|[0-9]+|[a-z]+|[,.;:!?()]"
_LIMIT = 10**12


def _words() -> Column:
    """Word to kind, value and whether it is an ordinal."""
    rows = [("zero", "zero", 0, False), ("hundred", "hundred", 100, False), ("and", "and", 0, False)]
    for kind, plain, ordinal, value in (("ones", ONES, ORDINAL_ONES, lambda k: k + 1), ("teens", TEENS, ORDINAL_TEENS, lambda k: k + 10), ("tens", TENS, ORDINAL_TENS, lambda k: 10 * k + 20)):
        rows += [(w, kind, value(k), False) for k, w in enumerate(plain)] + [(w, kind, value(k), True) for k, w in enumerate(ordinal)]
    rows += [(w, "scale", v, False) for w, v in SCALES] + [(m, "month", k, False) for k, m in enumerate(MONTHS, 1)] + [(w, "filler", 0, False) for w in FILLERS]
    return F.expr("map(" + ", ".join(f"'{w}', named_struct('kind', '{k}', 'value', {v}L, 'ord', {str(o).lower()})" for w, k, v, o in rows) + ")")


_START = f"named_struct('items', CAST(array() AS array<struct<kind:string,value:bigint>>), 'total', 0L, 'part', 0L, 'scale', {_LIMIT}L, 'last', '')"


def items(text: Column) -> Column:
    """Numbers, ordinals, digits, months and gaps of a text in order, as an array of (kind, value)."""
    known = _words()
    item = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("value"))

    def read(t: Column) -> Column:
        w, digits = F.try_element_at(known, t), F.regexp_extract(t, "^([0-9]{1,9})(st|nd|rd|th)?$", 1)
        kind = F.coalesce(w["kind"], F.when(digits != "", "digits").otherwise("other"))
        value = F.coalesce(w["value"], F.nullif(digits, F.lit("")).cast("long"), F.lit(0))
        return F.struct(kind.alias("kind"), value.alias("value"), F.coalesce(w["ord"], F.lit(False)).alias("ord"))

    def goes_on(s: Column, w: Column) -> Column:
        kind, last = w["kind"], s["last"]
        upper = last.isin("hundred", "scale", "and")
        return (
            F.when(kind == "ones", upper | (last == "tens")).when(kind.isin("teens", "tens"), upper)
            .when(kind == "hundred", last.isin("ones", "teens", "tens") & (s["part"] < 100))
            .when(kind == "scale", last.isin("ones", "teens", "tens", "hundred") & (w["value"] < s["scale"]))
            .when(kind == "and", last.isin("hundred", "scale")).otherwise(False)
        )

    def sums(s: Column, w: Column, fits: Column) -> Column:
        """Whether a number is open after the word, what it comes to so far and the scale that it may still take."""
        kind, value, part = w["kind"], w["value"], s["part"]
        starts = ~fits & kind.isin("ones", "teens", "tens", "zero")
        grown = F.when(kind == "hundred", part * 100).when(kind == "scale", 0).when(kind == "and", part).otherwise(part + value)
        total = F.when(fits, s["total"] + F.when(kind == "scale", part * value).otherwise(0)).otherwise(0)
        scale = F.when(fits & (kind == "scale"), value).when(fits, s["scale"]).otherwise(F.lit(_LIMIT))
        return F.struct((fits | starts).alias("open"), total.cast("long").alias("total"), F.when(fits, grown).when(starts, value).otherwise(0).cast("long").alias("part"), scale.cast("long").alias("scale"))

    def after(s: Column, w: Column, fits: Column, n: Column) -> Column:
        kind = w["kind"]
        before = F.when((s["last"] != "") & ~fits, F.concat(s["items"], F.array(item("number", s["total"] + s["part"])))).otherwise(s["items"])
        nothing = F.array().cast("array<struct<kind:string,value:bigint>>")
        added = F.when(w["ord"], F.array(item("ordinal", n["total"] + n["part"]))).when(n["open"] | (kind == "filler"), nothing).when(kind.isin("month", "digits"), F.array(F.struct(kind.alias("kind"), w["value"].alias("value")))).otherwise(F.array(item("gap", F.lit(0))))
        goes = n["open"] & ~w["ord"]
        zero = lambda c: F.when(goes, c).otherwise(0).cast("long")
        return F.struct(F.concat(before, added).alias("items"), zero(n["total"]).alias("total"), zero(n["part"]).alias("part"), n["scale"].alias("scale"), F.when(goes, kind).otherwise("").alias("last"))

    def step(s: Column, t: Column) -> Column:
        return let(read(t), lambda w: let(goes_on(s, w), lambda fits: let(sums(s, w, fits), lambda n: after(s, w, fits, n))))

    close = lambda s: F.when(s["last"] != "", F.concat(s["items"], F.array(item("number", s["total"] + s["part"])))).otherwise(s["items"])
    return F.aggregate(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0)), F.expr(_START), step, close)


def numbers(found: Column) -> Column:
    """Values of the numbers and ordinals in words among :func:`items`, in order; days of dates too."""
    return F.transform(F.filter(found, lambda x: x["kind"].isin("number", "ordinal")), lambda x: x["value"])


def dates(found: Column) -> Column:
    """Whole dates among :func:`items`, in order: day, month, year or month, day, year; what is no day of the calendar is none."""
    kind, value = (lambda k: F.get(found, k)["kind"]), (lambda k: F.get(found, k)["value"])
    is_day = lambda k: kind(k).isin("number", "ordinal", "digits")
    year = lambda k: is_day(k) & value(k).between(1000, 2999)
    day = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", value(y), value(m), value(d)), "yyyy-MM-dd")

    def at(k: Column) -> Column:
        first = is_day(k) & (kind(k + 1) == "month") & year(k + 2)
        second = (kind(k) == "month") & is_day(k + 1) & year(k + 2)
        return F.when(first & value(k).between(1, 31), day(k + 2, k + 1, k)).when(second & value(k + 1).between(1, 31), day(k + 2, k, k + 1))

    return F.array_compact(F.transform(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0))), at))
