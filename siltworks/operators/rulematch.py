"""Matching codes against exact, range and prefix rules.

A join on all three at once would be a nested loop. Here each kind is a join of its own on
distinct codes: exact rules by equality, prefix rules by equality with each of a code's prefixes of a
length that occurs, range rules by equality on family with a comparison of natural keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from siltworks.functions.text import natural_key

DEFAULT = "other"


def best_rules(codes: DataFrame, rules: DataFrame) -> DataFrame:
    """``family, section_key, hazard_code`` of each distinct code that a rule fits.

    ``rules`` has family, match_type (exact, range, prefix), pattern, range_to, hazard_code. An exact rule
    beats a range, a range a prefix; the range that starts last, then ends first, and the longest
    prefix win; the smallest hazard code settles what is left.
    """
    codes = codes.select("family", "section_key").where("section_key is not null").distinct()
    kind = lambda k: rules.where(F.col("match_type") == k)
    exact = codes.join(kind("exact").select("family", F.col("pattern").alias("section_key"), "hazard_code"), ["family", "section_key"])
    exact = exact.select("family", "section_key", "hazard_code", F.lit(1).alias("rank"), F.lit("").alias("low"), F.lit("").alias("high"), F.lit(0).alias("length"))
    ranges = kind("range").select("family", natural_key(F.col("pattern")).alias("low"), natural_key(F.col("range_to")).alias("high"), "hazard_code")
    keyed = codes.withColumn("natural", natural_key(F.col("section_key")))
    in_range = keyed.join(ranges, "family").where("natural between low and high")
    in_range = in_range.select("family", "section_key", "hazard_code", F.lit(2).alias("rank"), "low", "high", F.lit(0).alias("length"))
    lengths = kind("prefix").select("family", F.length("pattern").alias("length")).distinct()
    cut = codes.join(lengths, "family").where(F.length("section_key") >= F.col("length")).withColumn("pattern", F.expr("left(section_key, length)"))
    prefix = cut.join(kind("prefix").select("family", "pattern", "hazard_code"), ["family", "pattern"])
    prefix = prefix.select("family", "section_key", "hazard_code", F.lit(3).alias("rank"), F.lit("").alias("low"), F.lit("").alias("high"), "length")
    order = Window.partitionBy("family", "section_key").orderBy("rank", F.desc("low"), "high", F.desc("length"), "hazard_code")
    found = exact.union(in_range).union(prefix).withColumn("n", F.row_number().over(order))
    return found.where("n = 1").select("family", "section_key", "hazard_code")


def match_rules(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """``facts`` with ``hazard_code``; never null, so that totals by hazard add up."""
    best = best_rules(facts, rules)
    return facts.join(best, ["family", "section_key"], "left").withColumn("hazard_code", F.coalesce("hazard_code", F.lit(DEFAULT)))


def range_faults(rules: DataFrame) -> DataFrame:
    """Pairs of ranges of a family that overlap without one holding the other."""
    r = rules.where("match_type = 'range'").select("family", "pattern", natural_key(F.col("pattern")).alias("low"), natural_key(F.col("range_to")).alias("high"))
    a, b = r.alias("a"), r.alias("b")
    return a.join(b, F.col("a.family") == F.col("b.family")).where("a.low < b.low and b.low <= a.high and a.high < b.high").select("a.family", F.col("a.pattern").alias("first"), F.col("b.pattern").alias("second"))
