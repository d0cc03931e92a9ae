"""Numbers, dates and percentages that an answer states but its evidence doesn't."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siltworks.functions.text import let
from siltworks.operators import written

TOKEN = r"(\d{4}-\d{2}-\d{2}|\d[\d,]*(?:\.\d+)?%?)"


def stated(c: Column) -> Column:
    """Numbers without group commas, percentages with their sign, whole dates, and what words say of numbers and dates, as digits."""
    plain = F.transform(F.regexp_extract_all(c, F.lit(TOKEN)), lambda t: F.regexp_replace(F.regexp_replace(t, ",", ""), r"(\.\d*?)0+(%?)\z", "$1$2"))
    plain = F.transform(plain, lambda t: F.regexp_replace(t, r"\.(%?)\z", "$1"))
    as_text = lambda a: F.transform(a, lambda x: x.cast("string"))
    spelled = let(written.items(c), lambda found: F.concat(as_text(written.numbers(found)), as_text(written.dates(found))))
    return F.array_sort(F.array_distinct(F.concat(plain, spelled)))


def ungrounded(answer: Column, evidence: Column, question: Column | None = None) -> Column:
    """What the answer states and neither evidence nor question does, as whole tokens, sorted."""
    known = F.coalesce(evidence, F.lit("")) if question is None else F.concat_ws(" | ", evidence, question)
    return F.array_sort(F.array_except(stated(F.coalesce(answer, F.lit(""))), stated(known)))


def cited_ids(answer: Column, known: Column) -> Column:
    """Ids in the answer, in order of value, that the evidence knows."""
    ids = F.transform(F.regexp_extract_all(answer, F.lit(r"\b(\d{6,12})\b")), lambda x: x.cast("bigint"))
    return F.array_sort(F.array_intersect(ids, known))
