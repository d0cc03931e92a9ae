"""Metrics of scored and labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def auc(scored: DataFrame, score: str = "score", label: str = "label", ranges: int = 64) -> DataFrame:
    """``auc``: the chance that a positive row scores above a negative one, ties half.

    Rows are counted by score first. The counted scores are cut into ``ranges`` ranges; the window runs within a range,
    and what lies below a whole range comes from the small table of range totals.
    """
    by_score = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    by_score = by_score.select("score", "pos", (F.col("n") - F.col("pos")).alias("neg"))
    cuts = by_score.agg(F.percentile_approx("score", [k / ranges for k in range(1, ranges)], 10_000).alias("cuts"))
    placed = by_score.join(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("score")))).drop("cuts")  # one row
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("range").agg(F.sum("neg").alias("total")).select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("neg_before"))  # at most ``ranges`` rows
    below = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(totals, "range").withColumn("neg_below", F.col("neg_before") + F.coalesce(F.sum("neg").over(below), F.lit(0)))
    whole = lambda c: c.cast("decimal(38,0)")
    won = F.sum(whole(F.col("pos")) * (2 * F.col("neg_below") + F.col("neg")).cast("decimal(19,0)"))  # in halves, so exact
    pairs = 2 * whole(F.sum("pos")) * F.sum("neg").cast("decimal(19,0)")
    return ranked.agg((whole(won) / F.nullif(whole(pairs), F.lit(0).cast("decimal(38,0)"))).cast("decimal(10,6)").cast("double").alias("auc"))


def brier(score: str = "score", label: str = "label") -> Column:
    """The mean squared error to six digits, the last one rounded half up; null for no rows.

    Squares are summed as decimals of twelve digits and divided once, so neither the order of rows nor their partitions
    change a digit, not even of a tie.
    """
    squares = F.sum(((F.col(score) - F.col(label)) ** 2).cast("decimal(22,12)")).cast("decimal(32,12)")
    n = F.count(F.when(F.col(score).isNotNull() & F.col(label).isNotNull(), 1)).cast("decimal(19,0)")
    return F.round(squares / F.nullif(n, F.lit(0).cast("decimal(19,0)")), 6).cast("double")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share's confidence interval; null for no rows."""
    p = k / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(n > 0, (middle - spread) / scale), F.when(n > 0, (middle + spread) / scale)


def precision_recall(predicted: Column, actual: Column) -> tuple[Column, Column]:
    """Aggregates of two boolean columns."""
    hit = F.count(F.when(predicted & actual, 1))
    return hit / F.nullif(F.count(F.when(predicted, 1)), F.lit(0)), hit / F.nullif(F.count(F.when(actual, 1)), F.lit(0))
