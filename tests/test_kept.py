"""What a build reads several times is written once, and per-row conditions are compiled."""

import pytest
from pyspark.sql import functions as F

from siltworks import warehouse as W
from siltworks.operators import rows as R
from siltworks.plans import builds


@pytest.fixture(scope="module")
def building(spark, tmp_path_factory):
    root, kept = tmp_path_factory.mktemp("kept"), []

    def keep(name, df):
        kept.append(name)
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    return W.Build(builds.raw(spark, "/root/testdata/sf0.001"), W.Settings(least_rated=1), keep), kept


def test_filings_are_ranked_once_and_peers_need_no_names(building):
    build, kept = building
    plan = build["ita_benchmark"]._jdf.queryExecution().optimizedPlan().toString()
    assert kept == ["filing_last", "filing_rates"] and "row_number" not in plan and "Join" not in plan
    build.filed, build.licensed
    assert kept == ["filing_last", "filing_rates", "filing", "licence_last", "licence"]


def test_codes_and_counts_are_kept(building):
    build, kept = building
    build["inspection"]
    assert {"code_hazard", "record_counts"} <= set(kept) and len(kept) == len(set(kept))


def test_flags_and_days_are_compiled(spark):
    from siltworks.functions.text import day_or_null

    df = spark.createDataFrame([(1, "2020-02-30"), (7, "2020-02-29 x"), (None, None)], "a int, d string")
    made = df.select("a", R.flags(big=F.col("a") > 3, one=F.col("a") == 1, dated=day_or_null(F.col("d")).isNotNull()).alias("f"))
    assert {r.a: r.f for r in made.collect()} == {1: ["one"], 7: ["big", "dated"], None: []}
    assert "lambdafunction" not in made._jdf.queryExecution().optimizedPlan().toString()
