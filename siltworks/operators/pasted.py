"""Pasted text to rows of name, city and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from siltworks.functions.names import STATES, clean_name
from siltworks.functions.text import squeeze

# Postal codes of the states, in the order of their names.
POSTAL = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI",
    "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT",
    "VT", "VA", "WA", "WV", "WI", "WY",
)
LEGAL_CELL = r"(?i)\A(?:inc|llc|l\.l\.c|corp|co|ltd|lp|llp)\.?\z"
MOST_ROWS = 50


def state_code(c):
    """A postal code from a code or a state's name, or null."""
    up = F.upper(F.trim(c))
    by_name = F.element_at(F.map_from_arrays(F.array(*map(F.lit, STATES)), F.array(*map(F.lit, POSTAL))), up)
    return F.when(up.isin(*POSTAL), up).otherwise(by_name)


def parse_pasted(lines: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``paste_id, line_no, name, city, state`` from ``lines(paste_id, line_no, line)``.

    Cells are parted by tabs or, without any, commas. Empty lines, lines that begin with # and a header
    line are left out. A legal form in a cell of its own goes back to the name; a city cell that ends in a
    state is split. The first of several lines of a paste with the same comparable name and state stays,
    up to ``most`` rows.
    """
    kept = lines.where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    cells = F.transform(F.split("line", F.when(F.contains("line", F.lit("\t")), "\t").otherwise(",")), lambda x: squeeze(x))
    df = kept.select("paste_id", "line_no", cells.alias("c"))
    legal = F.coalesce(F.get("c", F.lit(1)).rlike(LEGAL_CELL), F.lit(False))
    name = F.when(legal, F.concat(F.get("c", F.lit(0)), F.lit(", "), F.get("c", F.lit(1)))).otherwise(F.get("c", F.lit(0)))
    rest = F.when(legal, F.slice("c", 3, 10)).otherwise(F.slice("c", 2, 10))
    df = df.select("paste_id", "line_no", name.alias("name"), rest.alias("r"))
    df = df.where(~F.lower("name").isin("name", "company", "company name", "subcontractor", "sub") & (F.col("name") != ""))
    city, state = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    tail = F.regexp_extract(city, r" ([A-Za-z]{2})\z", 1)
    split = state.isNull() & state_code(tail).isNotNull()
    df = df.select("paste_id", "line_no", "name", F.nullif(F.when(split, F.regexp_replace(city, r" [A-Za-z]{2}\z", "")).otherwise(city), F.lit("")).alias("city"), F.when(split, state_code(tail)).otherwise(state_code(state)).alias("state"))
    first = Window.partitionBy("paste_id", clean_name("name"), F.coalesce("state", F.lit(""))).orderBy("line_no")
    upto = Window.partitionBy("paste_id").orderBy("line_no")
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("_n", F.row_number().over(upto)).where(F.col("_n") <= most).drop("_n")
