"""What a name search needs: token index, name tiers, shared addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DISTINCTIVE_UPTO, GENERIC_FROM, SHARED_OFFICE_FROM = 5, 25, 6


def token_index(entities: DataFrame, name: str = "clean_name", key: str = "entity_key") -> DataFrame:
    """``token, entity_key``: each distinct word of each name."""
    words = F.array_distinct(F.filter(F.split(name, " "), lambda w: w != ""))
    return entities.select(F.explode(words).alias("token"), F.col(key).alias("entity_key"))


def token_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


def core_tiers(entities: DataFrame, person: str = "is_person") -> DataFrame:
    """``name_core, varieties, states, tier`` of each core; how far a shared core speaks for one entity."""
    by_core = entities.groupBy("name_core").agg(F.countDistinct("clean_name").alias("varieties"), F.countDistinct("state").alias("states"), F.bool_or(person).alias("is_person"))
    tier = (
        F.when(F.col("name_core") == "", "generic")
        .when(F.col("is_person"), "person")
        .when(F.col("varieties") <= DISTINCTIVE_UPTO, "distinctive")
        .when(F.col("varieties") >= GENERIC_FROM, "generic")
        .otherwise("medium")
    )
    return by_core.select("name_core", "varieties", "states", tier.alias("tier"))


def shared_addresses(entities: DataFrame) -> DataFrame:
    """``addr_key, zip5, cores, is_shared`` of each address; many cores at one make it a shared office."""
    found = entities.where("addr_key is not null").groupBy("addr_key", "zip5").agg(F.countDistinct("name_core").alias("cores"))
    return found.withColumn("is_shared", F.col("cores") >= SHARED_OFFICE_FROM)
