"""Names in another state that stand at another company's address.

A record under the query's name, matched only by that name, may be another company's record misspelt or cut short. It most
likely is if its building holds records which the rules don't tie to the query, under that name spelt another way or with a trade word
more, and these have more inspections than the query's own there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltworks.functions.names import DESCRIPTORS, GENERIC
from siltworks.functions.similarity import is_typo_equal
from siltworks.resolve.rules import MATCHED, UNCERTAIN, among, decide, words
from siltworks.sources.scratch import keeper

_TRADE = tuple(w for w in GENERIC if w not in DESCRIPTORS)
_BUILDING = ["query_id", "addr_key", "zip3"]


def _longer(name: Column, own: Column) -> Column:
    """Whether a name has all words of the other and a trade word more."""
    more = F.array_except(words(name), words(own))
    return (F.size(F.array_except(words(own), words(name))) == 0) & F.exists(more, lambda w: among(w, _TRADE))


def rivals(queries: DataFrame, held: DataFrame, entities: DataFrame, shared: DataFrame, given: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, entity_key, rival, rival_n`` of the held records at another company's address.

    ``queries`` has query_id and the query columns (q_) that :func:`decide` reads; ``held`` query_id, entity_key of records
    matched by name in another state; ``entities`` entity_key, clean_name, name_core, state, city, addr_key, zip5, n and any
    other candidate columns (c_) of :func:`decide`; ``shared`` addr_key, zip5, is_shared. Offices that many companies share say
    nothing. Records without an address or zip have no building. The rival named is the one with most inspections, then the first by name.
    What stands in the buildings is judged once and written to the shared folder, as three joins read it.
    """
    offices = shared.where("is_shared").select("addr_key", "zip5").distinct()
    site = entities.where("addr_key is not null and zip5 is not null").join(offices, ["addr_key", "zip5"], "left_anti")
    site = site.withColumn("zip3", F.left("zip5", F.lit(3))).withColumn("n", F.coalesce("n", F.lit(0)))
    held = held.select("query_id", "entity_key").distinct()
    ours = held.join(site, "entity_key").select(*_BUILDING, "entity_key", F.col("clean_name").alias("own_name"), F.col("name_core").alias("own_core"), "n")
    here = ours.select(*_BUILDING).distinct().join(site, ["addr_key", "zip3"])
    others = here.join(held, ["query_id", "entity_key"], "left_anti").withColumnsRenamed({"clean_name": "c_name", "name_core": "c_core", "state": "c_state", "city": "c_city"})
    judged = decide(others.join(queries, "query_id").withColumn("c_at_address", F.lit(True)), given)
    keep = keeper(queries.sparkSession)
    judged = keep("judged", judged.select(*_BUILDING, "entity_key", "c_name", "c_core", "n", (F.col("bucket") == MATCHED).alias("tied")))
    names = ours.select(*_BUILDING, "own_name", "own_core").distinct()
    apart = judged.where("not tied and c_core != ''").join(names, _BUILDING)
    other_spelling = apart.where("c_core != own_core and own_core != ''").where(is_typo_equal("c_core", "own_core"))
    longer = apart.where("c_core = own_core").where(_longer(F.col("c_name"), F.col("own_name")))
    found = other_spelling.unionByName(longer).select(*_BUILDING, "entity_key", "c_name", "n").distinct()
    best = found.groupBy(*_BUILDING).agg(F.sum("n").alias("rival_n"), F.min_by("c_name", F.struct(-F.col("n"), F.col("c_name"))).alias("rival"))
    own = ours.select(*_BUILDING, "n").unionByName(judged.where("tied").select(*_BUILDING, "n")).groupBy(*_BUILDING).agg(F.sum("n").alias("own_n"))
    return best.join(own, _BUILDING).where("rival_n > own_n").join(ours.select(*_BUILDING, "entity_key"), _BUILDING).select("query_id", "entity_key", "rival", "rival_n")


def doubt(decided: DataFrame, found: DataFrame) -> DataFrame:
    """``decided(query_id, entity_key, bucket, rule_id)`` with M3 records at a rival's address left uncertain (M3a)."""
    marked = decided.join(found.select("query_id", "entity_key", F.lit(True).alias("_rival")).distinct(), ["query_id", "entity_key"], "left")
    doubtful = F.coalesce(F.col("_rival") & (F.col("rule_id") == "M3"), F.lit(False))
    return marked.withColumns({"bucket": F.when(doubtful, UNCERTAIN).otherwise(F.col("bucket")), "rule_id": F.when(doubtful, "M3a").otherwise(F.col("rule_id"))}).select(*decided.columns)
