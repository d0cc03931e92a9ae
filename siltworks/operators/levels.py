"""Benchmarks over windows and levels of a hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def over_windows(df: DataFrame, year: str, last_year: int, windows: Sequence[int]) -> DataFrame:
    """Each row once for every window of years, up to ``last_year``, that holds it."""
    inside = F.filter(F.array(*map(F.lit, windows)), lambda w: (F.col(year) > F.lit(last_year) - w) & (F.col(year) <= last_year))
    return df.withColumn("window_years", F.explode(inside))


def over_levels(df: DataFrame, **levels: Column) -> DataFrame:
    """Each row once for every level, as ``level`` and ``code``; null codes are left out."""
    every = F.array(*(F.struct(F.lit(name).alias("level"), code.cast("string").alias("code")) for name, code in levels.items()))
    out = df.withColumn("_l", F.explode(every)).select("*", "_l.level", "_l.code").drop("_l")
    return out.where("code is not null")


def percentiles(value: str, *points: float) -> list[Column]:
    """Exact interpolated percentiles as ``p50`` and so on, rounded to four digits."""
    return [F.round(F.percentile(F.col(value), F.lit(p)), 4).alias(f"p{round(100 * p)}") for p in points]


def most_specific(benchmarks: DataFrame, keys: Sequence[str], order: Sequence[str], least_peers: int) -> DataFrame:
    """For each key the first level in ``order`` with enough peers."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("level"))
    window = Window.partitionBy(*keys).orderBy("_rank")
    ranked = benchmarks.where(F.col("peers") >= least_peers).withColumn("_rank", rank)
    return ranked.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n", "_rank")


def pooled_rate(cases: Column | str, hours: Column | str, per: float = 200_000) -> Column:
    """Aggregate: cases per ``per`` hours over all rows, null without hours."""
    return F.round(per * F.sum(cases) / F.nullif(F.sum(hours), F.lit(0.0)), 4)
