"""What stands at an address: lookups by building, shared offices, and how many candidates are kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltworks.operators.rows import top_k

#: candidates of a query that are kept in each bucket, the most alike first; matched ones all are
KEPT = {"excluded": 25, "uncertain": 200}
#: rows of a side at one place that meet the other side's in one task
BLOCK = 1_000


def word_prefixes(c: Column) -> Column:
    """What a text begins with, cut after each word but the last: names that it extends are found by equality."""
    w = F.split(c, " ")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda k: F.when(k < F.size(w), F.array_join(F.slice(w, 1, k), " ")))


def at_addresses(wanted: DataFrame, entities: DataFrame, shared: DataFrame, names: DataFrame | None = None, extending: bool = False) -> DataFrame:
    """``query_id, entity_key`` of entities in the buildings of ``wanted(query_id, addr_key, zip3, unit)``.

    ``entities`` has entity_key, clean_name, name_core, addr_key, zip5, unit; ``shared`` has addr_key, zip5, is_shared. Suites have to
    agree unless one side has none. Offices that many companies share pull nothing in. With ``names(query_id, name)`` it is the
    other way round: only entities at shared offices whose core is one of the query's names or, if ``extending``, whose
    name or core goes on after one.
    """
    offices = shared.where("is_shared").select("addr_key", "zip5").distinct()
    known = entities.where("addr_key is not null and zip5 is not null")
    known = known.join(offices, ["addr_key", "zip5"], "left_anti" if names is None else "left_semi")
    here = known.select("entity_key", "clean_name", "name_core", "addr_key", F.left("zip5", F.lit(3)).alias("zip3"), F.nullif("unit", F.lit("")).alias("own_unit"))
    found = wanted.select("query_id", "addr_key", "zip3", F.nullif("unit", F.lit("")).alias("unit")).distinct().join(here, ["addr_key", "zip3"])
    found = found.where("unit is null or own_unit is null or unit = own_unit")
    if names is not None:
        if extending:
            begins = F.array_distinct(F.array_compact(F.concat(word_prefixes(F.col("clean_name")), word_prefixes(F.col("name_core")))))
            found = found.withColumn("name", F.explode(begins))
        else:
            found = found.withColumn("name", F.col("name_core"))
        found = found.join(names.select("query_id", "name").where("name != ''").distinct(), ["query_id", "name"], "left_semi")
    return found.select("query_id", "entity_key").distinct()


def at_listed(listed: DataFrame, entities: DataFrame, shared: DataFrame, most: int = 20) -> DataFrame:
    """``query_id, entity_key, n`` at the addresses that a query lists, the entities with most records first, at most ``most``."""
    found = at_addresses(listed.where("addr_key is not null and zip3 is not null"), entities, shared).join(entities.select("entity_key", "n"), "entity_key")
    return top_k(found, ["query_id"], [F.desc("n"), F.col("entity_key")], most).select("query_id", "entity_key", "n")


def all_at(wanted: DataFrame, entities: DataFrame, place: list[str]) -> DataFrame:
    """``wanted``'s columns and the entities' at its place, all of them.

    ``wanted`` has the columns ``place`` and unit, ``entities`` those and own_unit. Units have to agree unless one side has none. Both sides of a
    place are dealt over blocks by their numbers of rows, so a task gets at most about ``BLOCK`` rows of either, however many share the place. Pairs
    are many though rows are few, so the number of partitions is stated.
    """
    n = 4 * int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda df, name: df.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    both = blocks(wanted, "_rows").join(blocks(entities, "_columns"), place)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*df.columns), F.col(own)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        placed = df.join(both, place).withColumn(f"{own}_n", mine).withColumn(f"{other}_n", copies)
        return placed.drop("_rows", "_columns").repartition(n, *keys)

    keys = [*place, "_rows_n", "_columns_n"]
    pairs = dealt(wanted, "_rows", "_columns").join(dealt(entities, "_columns", "_rows"), keys).drop("_rows_n", "_columns_n")
    return pairs.where(F.col("unit").isNull() | F.col("own_unit").isNull() | (F.col("unit") == F.col("own_unit")))


def largest_at(wanted: DataFrame, entities: DataFrame, place: list[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of :func:`all_at` for each of ``wanted`` by ``order``, a total order of the entities' own columns.

    For lists that are meant to be short; what is at an address as a whole is :func:`all_at`'s. What no query of a place and unit could keep is
    left out before queries meet it, and queries that ask the same are answered once, so no address costs the product of both sides.
    """
    best = top_k(entities, [*place, "own_unit"], order, most)
    fits = F.col("unit").isNull() | F.col("own_unit").isNull() | (F.col("unit") == F.col("own_unit"))
    answers = top_k(wanted.select(*place, "unit").distinct().join(best, place).where(fits), [*place, "unit"], order, most)
    asked = answers.withColumnsRenamed({x: f"_{x}" for x in [*place, "unit"]})
    same = F.col("unit").eqNullSafe(F.col("_unit"))
    for x in place:
        same = same & (F.col(x) == F.col(f"_{x}"))
    return wanted.join(asked, same).drop("_unit", *(f"_{x}" for x in place))


def keep_closest(decided: DataFrame, kept: dict[str, int] = KEPT) -> DataFrame:
    """``decided(query_id, entity_key, bucket, similarity)`` with so many rows of each bucket of a query; other buckets stay whole."""
    place = F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy(F.desc_nulls_last("similarity"), "entity_key"))
    within = F.lit(True)
    for bucket, most in kept.items():
        within = F.when(F.col("bucket") == bucket, F.col("_n") <= most).otherwise(within)
    return decided.withColumn("_n", place).where(within).drop("_n")


def of_entities(facts: DataFrame, keys: DataFrame, key: str = "entity_key") -> DataFrame:
    """The facts of a set of entities: a semi-join, which prunes the scan where the set is small."""
    return facts.join(keys.select(key).distinct(), key, "left_semi")
