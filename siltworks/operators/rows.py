"""Choosing and keeping rows: latest, top-k, modes, variants, quarantine, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key by a total order; Spark cuts groups before it shuffles them."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def mode_of(value: str) -> Column:
    """Aggregate over ``(value, n)`` rows: the most frequent value, the smallest of several."""
    return F.min_by(F.col(value), F.struct(-F.col("n"), F.col(value)))


def modes(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The most frequent non-null value of each column per key, ties to the smallest.

    Values are counted before a key's rows meet, so a key with very many rows is no burden.
    """
    out = df.select(*keys).distinct()
    for c in columns:
        counted = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("n"))
        out = out.join(counted.groupBy(*keys).agg(mode_of(c).alias(c)), list(keys), "left")
    return out


def variants(value: Column | str, most: int = 25) -> Column:
    """Aggregate: the distinct values in order, at most ``most``; null if there are none."""
    found = F.slice(F.array_sort(F.collect_set(value)), 1, most)
    return F.when(F.size(found) > 0, found)


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return top_k(df, keys, order)


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str], source: str, key: Column, reason: str) -> DataFrame:
    """Rows without a parent as ``source_table, source_key, reason``; they are set aside, not dropped."""
    lost = child.join(parent.select(*keys), list(keys), "left_anti")
    return lost.select(F.lit(source).alias("source_table"), key.cast("string").alias("source_key"), F.lit(reason).alias("reason"))


def flags(**conditions: Column) -> Column:
    """Names of the conditions that hold, in the order given; null conditions don't hold."""
    # as text first: this is compiled, while a function with a lambda has all its conditions interpreted for each row
    found = F.concat_ws(",", *(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items()))
    return F.array_remove(F.split(found, ","), "")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[Column], starts: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of each key; ``starts`` says, with ``F.lag`` over :func:`ordered`, where one begins."""
    flag = F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    window = ordered(keys, order)
    return df.withColumn("_flag", flag).withColumn(name, F.sum("_flag").over(window.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_flag")


def ordered(keys: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def duplicates(new: DataFrame, existing: DataFrame | None, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``new`` with ``is_duplicate``: the key is in ``existing`` or on an earlier row; null keys never are."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    out = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if existing is None:
        again = F.col("_n") > 1
    else:
        out = out.join(existing.select(*keys).distinct().withColumn("_old", F.lit(True)), list(keys), "left")
        again = (F.col("_n") > 1) | F.col("_old").isNotNull()
    return out.withColumn("is_duplicate", known & again).drop("_n", "_old")


def hash_sample(df: DataFrame, key: Column, n: int, seed: int = 7) -> DataFrame:
    """The same ``n`` rows whatever the partitioning: the first by a digest of key and seed."""
    return df.orderBy(F.md5(F.concat(key.cast("string"), F.lit(str(seed)))), key).limit(n)


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns, matched by name."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out
