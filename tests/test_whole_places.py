"""All that stands at a place, however many rows share it."""

import random

from pyspark.sql import functions as F

from siltworks.plans import entities
from siltworks.resolve import addresses as AD


def test_all_at_against_plain_lookup(spark, monkeypatch):
    monkeypatch.setattr(AD, "BLOCK", 7)
    r = random.Random(5)
    unit = lambda: r.choice([None, "STE 1", "STE 2"])
    at = lambda: (r.choice(["1 MAIN", "1 MAIN", "2 MAIN", None]), r.choice(["100", "200", None]))
    queries = [(k, *at(), unit()) for k in range(90)] + [(7, "1 MAIN", "100", None), (8, "9 MAIN", "100", None)]
    records = [(k, *at(), unit()) for k in range(120)] + [(5, "1 MAIN", "100", None)]
    q = spark.createDataFrame(queries, "query_id int, addr_key string, zip3 string, unit string")
    e = spark.createDataFrame(records, "key int, addr_key string, zip3 string, own_unit string")
    want = [(i, k) for i, a, z, u in queries for k, ka, kz, ku in records if None not in (a, z) and (ka, kz) == (a, z) and (u is None or ku is None or u == ku)]
    got = AD.all_at(q, e, ["addr_key", "zip3"]).select("query_id", "key").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert AD.all_at(q.limit(0), e, ["addr_key", "zip3"]).count() == AD.all_at(q, e.limit(0), ["addr_key", "zip3"]).count() == 0


def test_one_place_is_dealt_over_tasks(spark):
    q = spark.range(4000).select(F.col("id").alias("query_id"), F.lit("1 MAIN").alias("addr_key"), F.lit(None).cast("string").alias("unit"))
    e = spark.range(2000).select(F.col("id").alias("key"), F.lit("1 MAIN").alias("addr_key"), F.lit(None).cast("string").alias("own_unit"))
    pairs = AD.all_at(q, e, ["addr_key"])
    by_task = [n for n, in pairs.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(by_task) == 8_000_000 and len(by_task) > 3 and max(by_task) < 4_500_000


def test_pooled_addresses_are_not_cut(spark):
    most = entities.pooled_address_join(spark, "/root/testdata/sf0.001").groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert most > 10
