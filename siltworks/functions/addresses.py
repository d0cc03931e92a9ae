"""Street addresses and entity keys as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import group, is_all, let, matches, null_if_empty, rewrite, squeeze, text

# Postal abbreviations and directions that keys depend on. WEST stays as it is.
ABBREVIATIONS = (
    ("(?:P O|POST OFFICE|P0) +BOX", "PO BOX"),
    ("STREET", "ST"), ("AVENUE", "AVE"), ("ROAD", "RD"), ("DRIVE", "DR"), ("BOULEVARD", "BLVD"), ("SUITE", "STE"), ("HIGHWAY", "HWY"),
    ("PARKWAY", "PKWY"), ("(?:FREEWAY|FRWY)", "FWY"), ("(?:EXPRESSWAY|EXPRESSWY|EXPWY)", "EXPY"), ("LANE", "LN"), ("COURT", "CT"),
    ("PLACE", "PL"), ("CIRCLE", "CIR"), ("NORTHEAST", "NE"), ("NORTHWEST", "NW"), ("SOUTHEAST", "SE"), ("SOUTHWEST", "SW"),
    ("NORTH", "N"), ("SOUTH", "S"), ("EAST", "E"),
)
UNIT = r"\b(?:STE|SUITE|UNIT|APT|FL|FLOOR|RM|ROOM|BLDG|#)\s*#?\s*[A-Z0-9-]+\s*\z"
JOINED_DIRECTION = r"\b([0-9]+[A-Z]? )(NORTH|SOUTH|EAST|WEST)([A-DF-Z][A-Z]{2,}|E[A-QS-Z][A-Z]+)\b"
HOUSE = r"^([0-9]+)[A-Z]?\s+(?:[NS]\s+(?:E|W|WEST)\s+|(?:N|S|E|W|NORTH|SOUTH|EAST|WEST|NE|NW|SE|SW)\s+)?([A-Z0-9]+)"


def clean_address(c: Column | str) -> Column:
    words = F.regexp_replace(F.regexp_replace(F.upper(text(c)), "[^A-Z0-9 ]", " "), r"\s+", " ")
    return squeeze(rewrite(words, *((rf"\b{a}\b", b) for a, b in ABBREVIATIONS)))


def address_unit(c: Column | str) -> Column:
    return null_if_empty(group(F.upper(text(c)), UNIT, 0))


def address_key(c: Column | str) -> Column:
    """``POBOX n``, or the house number and the first word of the street, or null."""

    def key(clean: Column) -> Column:
        split = F.regexp_replace(clean, JOINED_DIRECTION, "$1$2 $3")
        box = group(clean, r"\bPO BOX\s+([0-9]+)")
        house = F.concat(group(split, HOUSE, 1), F.lit(" "), group(split, HOUSE, 2))
        return F.when(box != "", F.concat(F.lit("POBOX "), box)).when(matches(clean, r"^[0-9]+[A-Z]?\s+"), house)

    return let(clean_address(c), key)


def zip5(c: Column | str) -> Column:
    z = F.trim(text(c))
    head = F.substring(z, 1, 5)
    return F.when(matches(z, "^[0-9]{5}") & (head != "00000"), head).when(is_all(z, "[0-9]{4}"), F.concat(F.lit("0"), z))


def compass_side(c: Column | str) -> Column:
    """Compass letters that stand as words in an address, sorted."""
    words = F.split(clean_address(c), " ")
    letters = F.filter(words, lambda w: w.isin("N", "S", "E", "W", "WEST", "NE", "NW", "SE", "SW"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(letters, lambda w: F.split(F.when(w == "WEST", "W").otherwise(w), "(?!\\z)")))))


def opposite_sides(a: Column | str, b: Column | str) -> Column:
    """Whether one address names a side of town and the other the opposite one."""
    x, y = compass_side(a), compass_side(b)
    has = lambda arr, w: F.array_contains(arr, w)
    return (has(x, "N") & has(y, "S")) | (has(x, "S") & has(y, "N")) | (has(x, "E") & has(y, "W")) | (has(x, "W") & has(y, "E"))


def entity_key(clean: Column, key: Column, zip_code: Column, state: Column) -> Column:
    """The same digest for the same name, address, zip and state in every build."""
    return F.md5(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (clean, key, zip_code, state))))
