import json
import random
import re

from pyspark.sql import functions as F

from siltworks.functions import jsons as J
from siltworks.operators import quotes as Q
from siltworks.sources.scratch import keeper


def deep(a, b, depth):
    out = dict(a)
    for k, v in b.items():
        out[k] = deep(a[k], v, depth - 1) if depth > 1 and isinstance(a.get(k), dict) and isinstance(v, dict) else v
    return out


def test_merge(spark):
    objects = [{}, {"a": 1}, {"a": None}, {"a": {"b": 1, "c": [1, 2]}}, {"a": {"b": {"d": "x"}}, "é": True}, {"a": {"b": {"d": None, "e": 2.5}}, "z": "q\"uo"}]
    pairs = [(json.dumps(a), json.dumps(b)) for a in objects for b in objects]
    df = spark.createDataFrame(pairs, "a string, b string")
    for depth in (1, 2, 3):
        got = df.select("a", "b", J.merge(F.col("a"), F.col("b"), depth).alias("m")).collect()
        assert all(json.loads(r.m) == deep(json.loads(r.a), json.loads(r.b), depth) for r in got)
    odd = spark.createDataFrame([(None, '{"a": 1}'), ("not json", '{"a": 1}'), ("[1]", '{"a": 1}'), ('{"a": 1}', None)], "a string, b string")
    assert [json.loads(r.m) for r in odd.select(J.merge(F.col("a"), F.col("b")).alias("m")).collect()] == [{"a": 1}] * 4


def test_field(spark):
    df = spark.createDataFrame([('{"a": {"b": [5, "x"]}, "n": null}',), ("{",), (None,)], "c string")
    got = df.select(J.field(F.col("c"), "$.a.b[0]", "int").alias("i"), J.field(F.col("c"), "$.a.b[1]", "int").alias("no"), J.field(F.col("c"), "$.n", "string").alias("n")).collect()
    assert [tuple(r) for r in got] == [(5, None, None), (None, None, None), (None, None, None)]


def test_quotes(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(12)] + ["é", "日本"]
    sources = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for k in range(80)] + [(80, None), (81, ""), (82, "w1"), (82, "w1, W2; w3!"), (83, "alone")]
    quotes = [(k, ", ".join(r.choice(words) for _ in range(r.randint(1, 4)))) for k in range(120)] + [(200, None), (201, "--"), (202, "W1 w2 W3"), (203, "ALONE"), (204, "never here"), (205, "w1"), (206, "w0 " * 30)]
    own = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = set()
    for i, t in quotes:
        q = own(t)
        for s, text in sources:
            w = own(text)
            at = [k for k in range(len(w) - len(q) + 1) if q and w[k : k + len(q)] == q]
            if at:
                want.add((i, s, at[0]))
    got = Q.standing(spark.createDataFrame(quotes, "quote_id int, text string").withColumn("at", F.lit(1)), spark.createDataFrame(sources, "source_id int, text string").withColumn("pair", F.lit(1)), keeper(spark))
    assert {tuple(x) for x in got.collect()} == want
    none = spark.createDataFrame([], "quote_id int, text string")
    assert Q.standing(none, spark.createDataFrame(sources, "source_id int, text string"), keeper(spark)).collect() == []


def test_quotes_keep_no_places_of_frequent_pairs(spark):
    """What is written grows with the quotes, not with the texts that hold their pairs."""
    kept = []

    def keep(name, df):
        kept.append(keeper(spark)(name, df))
        return kept[-1]

    quotes = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "The mat"), (3, "the"), (4, "on the dog sat")], "quote_id int, text string")
    sources = spark.createDataFrame([(k, "On the mat, the cat sat on the mat. " * 5 + ("On the dog; sat" if k % 50 == 0 else "the end")) for k in range(200)], "source_id int, text string")
    got = {(r.quote_id, r.source_id, r.at) for r in Q.standing(quotes, sources, keep).collect()}
    assert got == {(1, k, 3) for k in range(200)} | {(2, k, 1) for k in range(200)} | {(3, k, 1) for k in range(200)} | {(4, k, 45) for k in range(0, 200, 50)}
    assert sum(t.count() for t in kept) <= 4


def test_quotes_of_full_slots(spark, monkeypatch):
    """Where unlike pairs share a slot, the words decide."""
    monkeypatch.setattr(Q, "SLOTS", 2)
    test_quotes(spark)
