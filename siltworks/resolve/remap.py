"""Decisions that follow their records when a rebuild gives entities new keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def shared_members(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """``decision_id, new_key, shared``: how many of a decision's records each new entity holds.

    ``decisions`` has decision_id and activity_nrs (array); ``members`` has new_key and activity_nr.
    """
    old = decisions.select("decision_id", F.explode("activity_nrs").alias("activity_nr")).distinct()
    return old.join(members.select("new_key", "activity_nr"), "activity_nr").groupBy("decision_id", "new_key").agg(F.count("*").alias("shared"))


def follow(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """``decision_id, old_key, action, new_key, shared, targets``.

    A decision whose key lives on stays ("keep"). Otherwise it is carried to the one new entity that holds its
    records ("carry"); if there are several, it goes to the one with most of them and is asked about
    again ("ask"); if there is none, it is released ("release").
    """
    counts = shared_members(decisions, members)
    best = counts.groupBy("decision_id").agg(F.max_by(F.struct("new_key", "shared"), F.struct("shared", F.col("new_key"))).alias("b"), F.count("*").alias("targets"), F.array_sort(F.collect_set("new_key")).alias("keys"))
    all_ = decisions.select("decision_id", F.col("entity_key").alias("old_key")).join(best, "decision_id", "left")
    action = F.when(F.col("b").isNull(), "release").when(F.array_contains("keys", F.col("old_key")), "keep").when(F.col("targets") == 1, "carry").otherwise("ask")
    target = F.when(action == "keep", F.col("old_key")).otherwise(F.col("b.new_key"))
    return all_.select("decision_id", "old_key", action.alias("action"), target.alias("new_key"), F.coalesce("b.shared", F.lit(0)).alias("shared"), F.coalesce("targets", F.lit(0)).alias("targets"))


def persist(current: DataFrame, decided: DataFrame) -> DataFrame:
    """Rule decisions replaced by new ones, people's decisions kept; a keyed rewrite of the whole table.

    Both have sub_id, entity_key, bucket, method, rule_id. A key with a person's decision keeps it; keys of
    which an open question asks wait as ``possible``.
    """
    human = current.where("method in ('user', 'question')")
    waiting = current.where("method = 'question' and bucket = 'possible'").select("sub_id", "entity_key")
    fresh = decided.join(human.select("sub_id", "entity_key"), ["sub_id", "entity_key"], "left_anti")
    columns = ["sub_id", "entity_key", "bucket", "method", "rule_id"]
    held = human.join(waiting.withColumn("_w", F.lit(True)), ["sub_id", "entity_key"], "left").withColumn("bucket", F.when(F.col("_w"), "possible").otherwise(F.col("bucket")))
    return fresh.select(*columns).unionByName(held.select(*columns))


def settle(current: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of people applied: yes makes a match, no excludes; other rows stay."""
    said = answers.select("sub_id", "entity_key", F.when(F.col("answer") == "yes", "matched").otherwise("excluded").alias("_bucket"))
    joined = current.join(said, ["sub_id", "entity_key"], "left")
    return joined.withColumns({"bucket": F.coalesce("_bucket", "bucket"), "method": F.when(F.col("_bucket").isNotNull(), "user").otherwise(F.col("method"))}).drop("_bucket")


def by_probability(df: DataFrame, same: float = 0.85, different: float = 0.80) -> DataFrame:
    """``df(p_same, red_flags)`` with ``bucket``: sure enough either way, else uncertain; red flags always ask."""
    sure = F.when(F.col("red_flags") > 0, "question").when(F.col("p_same") >= same, "matched").when(1 - F.col("p_same") >= different, "excluded")
    return df.withColumn("bucket", F.coalesce(sure, F.lit("uncertain")))
