import pytest
from pyspark.sql import functions as F

from siltworks.resolve.store import Conflict, DecisionStore, persist_rules
from siltworks.sources.raw import put_in_place

SCHEMA = "sub_id long, entity_key string, bucket string, method string, rule_id string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def change(spark, *found):
    return spark.createDataFrame(found, SCHEMA)


def apart(store, spark):
    """Two subjects that lie in different buckets."""
    by = {}
    for k, b in spark.range(1, 60).withColumnRenamed("id", "sub_id").select("sub_id", store._bucket()).collect():
        by.setdefault(b, k)
    return list(by.values())[:2]


def test_two_writers_one_wins(spark, tmp_path):
    store = DecisionStore(spark, f"{tmp_path}/store", SCHEMA, buckets=8)
    assert store.version == 0 and rows(store.read()) == []
    base = store.merge(change(spark, (1, "a", "possible", "rule", "U"), (2, "b", "matched", "rule", "M1")), 0)
    assert base == 1
    first = DecisionStore(spark, f"{tmp_path}/store", SCHEMA, buckets=8)
    second = DecisionStore(spark, f"{tmp_path}/store", SCHEMA, buckets=8)
    assert first.merge(change(spark, (1, "a", "matched", "user", None)), base) == 2
    with pytest.raises(Conflict):
        second.merge(change(spark, (1, "a", "excluded", "user", None)), base)
    assert store.version == 2 and (1, "a", "matched", "user", None) in rows(store.read())
    # told of it, the second reads again
    assert second.merge(change(spark, (1, "a", "excluded", "user", None)), second.version) == 3
    assert rows(store.read()) == [(1, "a", "excluded", "user", None), (2, "b", "matched", "rule", "M1")]
    assert rows(store.read(1)) == [(1, "a", "possible", "rule", "U"), (2, "b", "matched", "rule", "M1")]


def test_writers_in_other_buckets_do_not_meet(spark, tmp_path):
    store = DecisionStore(spark, f"{tmp_path}/store", SCHEMA, buckets=16)
    a, b = apart(store, spark)
    assert store.merge(change(spark, (a, "x", "matched", "rule", "M1")), 0) == 1
    assert store.merge(change(spark, (b, "y", "matched", "rule", "M1")), 0) == 2
    assert rows(store.read()) == sorted([(a, "x", "matched", "rule", "M1"), (b, "y", "matched", "rule", "M1")])


def test_a_writer_that_is_overtaken_while_it_writes(spark, tmp_path, monkeypatch):
    from siltworks.resolve import store as module

    store = DecisionStore(spark, f"{tmp_path}/store", SCHEMA, buckets=16)
    a, b = apart(store, spark)
    real, calls = put_in_place, []

    def late(spark_, path, body):
        if not calls:
            calls.append(1)
            DecisionStore(spark, f"{tmp_path}/store", SCHEMA, buckets=16).merge(change(spark, (b, "y", "matched", "rule", "M2")), 0)
        return real(spark_, path, body)

    monkeypatch.setattr(module, "put_in_place", late)
    assert store.merge(change(spark, (a, "x", "matched", "rule", "M1")), 0) == 2
    assert len(rows(store.read())) == 2
    calls.clear()
    base = store.version

    def same(spark_, path, body):
        if not calls:
            calls.append(1)
            DecisionStore(spark, f"{tmp_path}/store", SCHEMA, buckets=16).merge(change(spark, (a, "z", "matched", "rule", "M2")), base)
        return real(spark_, path, body)

    monkeypatch.setattr(module, "put_in_place", same)
    with pytest.raises(Conflict):
        store.merge(change(spark, (a, "x", "excluded", "rule", "X1")), base)
    assert (a, "x", "matched", "rule", "M1") in rows(store.read())


def test_rows_go_and_whole_buckets_too(spark, tmp_path):
    store = DecisionStore(spark, f"{tmp_path}/store", SCHEMA, buckets=4)
    v = store.merge(change(spark, (1, "a", "matched", "rule", "M1"), (1, "b", "matched", "rule", "M1"), (None, "c", "possible", "rule", "U")), 0)
    v = store.merge(change(spark, (1, "a", "matched", "rule", "M1")).withColumn("_delete", F.lit(True)), v)
    assert {r[1] for r in store.read().select("sub_id", "entity_key").collect()} == {"b", "c"}
    v = store.merge(change(spark, (1, "b", "matched", "rule", "M1")).withColumn("_delete", F.lit(True)), v)
    assert {r[1] for r in store.read().select("sub_id", "entity_key").collect()} == {"c"}
    assert store.merge(change(spark), v) == v
    with pytest.raises(ValueError):
        store.merge(change(spark, (1, "a", "x", "rule", "U"), (1, "a", "y", "rule", "U")), v)


def test_rules_leave_what_people_decided(spark, tmp_path):
    store = DecisionStore(spark, f"{tmp_path}/store", SCHEMA, buckets=4)
    v = store.merge(change(spark, (1, "a", "excluded", "user", None), (1, "b", "possible", "rule", "U"), (2, "c", "matched", "rule", "M1")), 0)
    waiting = spark.createDataFrame([(1, "d")], "sub_id long, entity_key string")
    persist_rules(store, change(spark, (1, "a", "matched", "rule", "M1"), (1, "b", "matched", "rule", "M2"), (1, "d", "matched", "rule", "M3")), v, waiting)
    assert rows(store.read()) == [(1, "a", "excluded", "user", None), (1, "b", "matched", "rule", "M2"), (1, "d", "possible", "rule", "M3"), (2, "c", "matched", "rule", "M1")]


def test_a_name_is_given_once(spark, tmp_path):
    assert put_in_place(spark, f"{tmp_path}/one/NAME", "first") and not put_in_place(spark, f"{tmp_path}/one/NAME", "second")
    assert (tmp_path / "one" / "NAME").read_text() == "first" and [f.name for f in (tmp_path / "one").iterdir() if not f.name.startswith(".")] == ["NAME"]
