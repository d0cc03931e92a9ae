import os

from pyspark.sql import functions as F

from siltworks import warehouse
from siltworks.plans import builds
from siltworks.sources import stages as S

SF = "/root/testdata/sf0.001"


def files(root):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names)


def small_build(spark, keep, path, factor=2):
    raw = spark.read.parquet(path)
    a = keep("doubled", raw.select("id", (F.col("id") * factor).alias("v")))
    b = keep("even", a.where("v % 4 = 0"))
    return keep("total", b.agg(F.sum("v").alias("s")))


def test_only_what_changed_is_done_again(spark, tmp_path):
    src, root = f"{tmp_path}/in", f"{tmp_path}/build"
    spark.range(1000).repartition(3).write.parquet(src)
    act = lambda st: [(d.stage, d.action) for d in st.report]
    first = S.Stages(spark, root, {"f": 2}, code="v1")
    total = small_build(spark, first, src).first().s
    assert act(first) == [("doubled", "written"), ("even", "written"), ("total", "written")] and total == 2 * sum(range(0, 1000, 2))
    before = files(root)
    second = S.Stages(spark, root, {"f": 2}, code="v1")
    assert small_build(spark, second, src).first().s == total
    assert {a for _, a in act(second)} == {"reused"} and files(root) == before
    # other code that comes to the same rows: run again, old tables kept
    third = S.Stages(spark, root, {"f": 2}, code="v2")
    assert small_build(spark, third, src).first().s == total and {a for _, a in act(third)} == {"same"}
    assert [f for f in files(root) if "/data/" in f] == [f for f in before if "/data/" in f]
    # more input that only the first table sees
    spark.createDataFrame([(5001,)], "id long").write.mode("append").parquet(src)
    fourth = S.Stages(spark, root, {"f": 2}, code="v2")
    assert small_build(spark, fourth, src).first().s == total
    assert act(fourth) == [("doubled", "written"), ("even", "same"), ("total", "reused")] and fourth.report[0].leaves_changed == 1
    # a lookup in memory counts by its rows
    look = spark.createDataFrame([(1, "a")], "k int, v string")
    assert S.Stages(spark, root, tables=(look,), code="v1").base == S.Stages(spark, root, tables=(look.repartition(3),), code="v1").base != S.Stages(spark, root, tables=(look.where("k > 1"),), code="v1").base


def test_trees(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"), F.array(F.lit("x")).alias("a"))
    assert S.tree(df) == S.tree(df.repartition(9).select("v", "a", "id")) and S.tree(df.limit(0)) == {}
    other = df.withColumn("v", F.when(F.col("id") == 42, -1).otherwise(F.col("v")))
    assert 1 <= len(S.changed(S.tree(df), S.tree(other))) <= 2
    assert S.changed({"1": [3, "x"]}, {}) == {"1": (3, 0)}


def test_a_warehouse_built_twice_writes_once(spark, tmp_path):
    raw = builds.raw(spark, SF)
    loose = tuple(t for t in (raw.lookup, raw.rules) if t is not None)
    settings = warehouse.Settings(least_rated=1)
    first = S.Stages(spark, f"{tmp_path}/w", settings, loose)
    one = warehouse.build(raw, settings, first)
    counts = {n: df.count() for n, df in one.items()}
    before = files(f"{tmp_path}/w")
    second = S.Stages(spark, f"{tmp_path}/w", settings, loose)
    two = warehouse.build(builds.raw(spark, SF), settings, second)
    assert {d.action for d in second.report} == {"reused"} and files(f"{tmp_path}/w") == before
    assert {n: df.count() for n, df in two.items()} == counts


def test_tables_are_made_only_when_asked_for(spark):
    """A table of the warehouse makes what it reads and no more; codes are parsed on their own, not where rules ask for them."""
    done = []

    def keep(name, df):
        done.append(name)
        return df.limit(0) if name != "code" else df

    made = warehouse.Build(builds.raw(spark, SF), warehouse.Settings(least_rated=1), keep)
    assert made["ita_benchmark"].columns and done == ["filing"]
    assert made["violation"] is made["violation"] and done[1:] == ["keys", "stg_inspection", "code", "violation"]
    assert "reference" not in done and "dq_check" in made.names and "reference" not in made.names
