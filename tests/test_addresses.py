import random

from pyspark.sql import functions as F

from siltworks.resolve import addresses as AD

from .plans import join_rows

PLACE = ["addr_key", "zip3"]


def test_largest_at_against_plain_lookup(spark):
    r = random.Random(11)
    unit = lambda: r.choice([None, "STE 1", "STE 2", "STE 3"])
    at = lambda: (r.choice(["1 MAIN", "2 MAIN", None]), r.choice(["100", "200", None]))
    queries = [(k, *at(), unit()) for k in range(80)] + [(7, "1 MAIN", "100", None)]
    records = [(k, r.randint(0, 5), *at(), unit()) for k in range(400)]
    q = spark.createDataFrame(queries, "query_id int, addr_key string, zip3 string, unit string")
    e = spark.createDataFrame(records, "key int, n int, addr_key string, zip3 string, own_unit string")
    want = []
    for i, a, z, u in queries:
        here = [(-n, k) for k, n, ka, kz, ku in records if None not in (a, z) and (ka, kz) == (a, z) and (u is None or ku is None or u == ku)]
        want += [(i, k) for _, k in sorted(here)[:4]]
    got = AD.largest_at(q, e, PLACE, [F.desc("n"), F.col("key")], 4).select("query_id", "key").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_largest_at_does_not_pair_all_at_an_address(spark):
    q = spark.range(1000).select(F.col("id").alias("query_id"), F.lit("1 MAIN").alias("addr_key"), F.lit("100").alias("zip3"), F.lit(None).cast("string").alias("unit"))
    e = spark.range(1000).select(F.col("id").alias("key"), F.lit("1 MAIN").alias("addr_key"), F.lit("100").alias("zip3"), F.lit(None).cast("string").alias("own_unit"))
    assert join_rows(AD.largest_at(q, e, PLACE, [F.col("key")], 10)) == 10_000  # 1,000,000 pairs stand at the address
