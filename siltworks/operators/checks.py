"""Data-quality checks, checksums and guards of a build."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def check(name: str, found: DataFrame, expected: DataFrame, severity: str = "error", tolerance: float = 0.0) -> DataFrame:
    """One row: two one-value tables counted in independent ways, and whether they agree.

    ``passed`` allows a difference of ``tolerance`` of what was expected.
    """
    a, b = found.toDF("found"), expected.toDF("expected")
    both = a.crossJoin(F.broadcast(b))  # one row each
    difference = F.abs(F.col("found").cast("double") - F.col("expected").cast("double"))
    return both.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), F.col("found").cast("double").alias("found"), F.col("expected").cast("double").alias("expected"), (difference <= F.abs(F.col("expected").cast("double")) * tolerance).alias("passed"))


def all_checks(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@dataclass(frozen=True)
class Rule:
    """Compares sums of named counts: ``found`` and ``expected`` are names, numbers or expressions over names.

    It passes if both are equal, or differ by at most ``within``; with ``at_most`` a smaller ``found`` passes as well.
    """

    name: str
    found: str
    expected: str = "0"
    severity: str = "error"
    within: float = 0.0
    at_most: bool = False


def counted(df: DataFrame, **counts: Column) -> tuple[list[str], DataFrame]:
    """Names, and ``name, value`` of aggregates over one table, all taken in one pass; a null counts as 0."""
    one = df.agg(*(value.cast("double").alias(name) for name, value in counts.items()))
    return list(counts), one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("name"), F.coalesce(name, F.lit(0.0)).alias("value")) for name in counts))))


def judge(counts: Sequence[tuple[list[str], DataFrame]], rules: Sequence[Rule]) -> DataFrame:
    """One row a rule. The counts, one row each, meet as one row before the rules are read off it."""
    rows = all_checks(*(df for _, df in counts))
    names = [n for part, _ in counts for n in part]
    one = rows.agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))

    def row(r: Rule) -> Column:
        found, expected = (F.expr(e).cast("double") for e in (r.found, r.expected))
        passed = F.abs(found - expected) <= r.within
        return F.struct(F.lit(r.name).alias("check_name"), F.lit(r.severity).alias("severity"), found.alias("found"), expected.alias("expected"), (passed | (found <= expected) if r.at_most else passed).alias("passed"))

    return one.select(F.inline(F.array(*map(row, rules))))


def failed_errors(checks: DataFrame) -> DataFrame:
    return checks.where("severity = 'error' and not passed")


def checksum(df: DataFrame) -> DataFrame:
    """``rows, checksum``: the same for the same rows in any order."""
    total = F.sum(F.xxhash64(F.struct(*sorted(df.columns))).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), F.coalesce(total, F.lit(0)).cast("string").alias("checksum"))


def shrunk(before: Mapping[str, int], after: Mapping[str, int], most: float = 0.02) -> dict[str, tuple[int, int]]:
    """Tables that lost more than a share of ``most`` of their rows since the last build."""
    return {t: (n, after.get(t, 0)) for t, n in before.items() if after.get(t, 0) < n * (1 - most)}


def fingerprint(*parts: object) -> str:
    """A digest of inputs and settings, by which a rebuild is known to be due the same result."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()
