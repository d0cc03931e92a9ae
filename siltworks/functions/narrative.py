"""What accident narratives say."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Phrases that report a death, and those that speak against one from work.
DEATH = (
    r"(?:employee|worker|victim|coworker|co-worker|\bhe|\bshe)(?: #?\s?[0-9]+)?(?: later| subsequently| eventually)? (?:died|was killed|succumbed|passed away)\b",
    r"\bdied (?:as a result of|from|of) (?:his|her|the|their) (?:injuries|wounds|burns)",
    r"\b(?:when|where|from which) (?:he|she) died\b",
    r"\b(?:later|subsequently|eventually) died\b",
    r"\bdied (?:during|while in) (?:hospitalization|the hospital|surgery)",
)
NOT_FROM_WORK = (r"non-work", r"not work[- ]related", r"unrelated to (?:his |her |the )?work", r"\b(?:battery|engine|motor) (?:had )?died\b", r"vacation", r"heart attack", r"natural causes")


def reports_death(c: Column | str) -> Column:
    """Whether a narrative says that someone died of the accident; null says no."""
    t = F.col(c) if isinstance(c, str) else c
    return F.coalesce(t.rlike("(?i)" + "|".join(DEATH)) & ~t.rlike("(?i)" + "|".join(NOT_FROM_WORK)), F.lit(False))


def join_lines(lines: Column, width: int = 80) -> Column:
    """Lines in order as one text; a line of full width was wrapped within a word and takes no blank."""
    return F.aggregate(lines, F.lit(""), lambda a, x: F.concat(a, F.rtrim(x), F.when(F.length(x) >= width, "").otherwise(" ")), F.trim)
