import random

from pyspark.sql import functions as F

from siltworks.operators.components import components
from siltworks.resolve import questions as Q
from siltworks.sources.scratch import keeper

QUESTIONS = "question_id long, sub_id long, kind string, suggestion string, created int, answer string, entity_keys array<string>"
RECORDS = [("a1", "ATKINSON", "TX", 5, 0), ("a2", "ATKINSON", "TX", 9, 0), ("a3", "ATKINSON", "OK", 7, 0), ("a4", "ATKINSON", "TX", 2, 3), ("p1", "JOHN DOE", "TX", 1, 0), ("p2", "JOHN DOE", "TX", 1, 0), ("g1", "CLARK", "TX", 1, 0), ("g2", "CLARK", "TX", 1, 0), ("o1", "OWN NAME", "TX", 1, 0), ("o2", "OWN NAME", "TX", 1, 0), ("z1", "ZENITH", "LA", 1, 0)]
TIERS = [("ATKINSON", "distinctive"), ("JOHN DOE", "person"), ("CLARK", "medium"), ("OWN NAME", "distinctive"), ("ZENITH", "distinctive")]
ASKED = [
    (1, 1, "red_flag", "yes", 5, None, ["a1"]), (2, 1, "red_flag", "yes", 3, None, ["a2", "z1"]), (3, 1, "web", "no", 4, None, ["z1"]), (4, 1, "web", "no", 9, None, ["g2"]),
    (5, 1, "red_flag", None, 1, None, ["p1"]), (6, 1, "red_flag", None, 2, None, ["p2", "p1"]), (7, 1, "red_flag", None, 2, None, ["g1"]), (8, 1, "red_flag", None, 2, "yes", ["a1"]),
    (9, 1, "remap", None, 2, None, ["a1"]), (10, 1, "red_flag", "no", 7, None, ["o1"]), (11, 1, "red_flag", "no", 8, None, ["o2"]), (12, 2, "red_flag", "no", 8, None, ["a1"]), (13, 2, "profile", "no", 8, None, ["p1", "a1"]),
]


def tables(spark):
    records = spark.createDataFrame(RECORDS, "entity_key string, name string, state string, n long, red_flags int")
    return records, spark.createDataFrame(TIERS, "name string, tier string"), spark.createDataFrame([(1, "OWN NAME")], "sub_id long, name string")


def test_united_in_any_order(spark):
    records, tiers, own = tables(spark)
    keep, r, got = keeper(spark), random.Random(3), []
    for k in range(3):
        asked = ASKED[:]
        r.shuffle(asked)
        asked = [(*q[:6], r.sample(q[6], len(q[6]))) for q in asked]
        df = keep(f"q{k}", spark.createDataFrame(asked, QUESTIONS).repartition(1 + 3 * k))
        labels = Q.united(df, records, tiers, own, keeper(spark))
        got.append((sorted(map(tuple, labels.collect())), sorted((tuple(x) for x in Q.merge_open(df, labels).collect()), key=str)))
    assert got[0] == got[1] == got[2]
    # 1 and 2 by name, 2 and 3 by record, 3 and 4 by evidence; persons, common names, own names and answered ones stay alone
    assert dict(got[0][0]) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7, 10: 10, 11: 11, 12: 12, 13: 13}
    merged = {q[0]: q for q in got[0][1]}
    assert set(merged) == {2, 5, 6, 7, 8, 9, 10, 11, 12, 13}
    assert merged[2] == (2, 1, "red_flag", None, 3, None, ["a1", "a2", "g2", "z1"])


def test_components_of_long_chains_and_hubs(spark):
    chain = [(k, f"c{k // 2}") for k in range(1, 400)] + [(k, f"d{(k + 1) // 2}") for k in range(1, 400)]
    hub = [(1000 + k, "hub") for k in range(3000)] + [(5000, None), (None, "hub")]
    got = dict(map(tuple, components(spark.createDataFrame(chain + hub, "node long, key string"), keeper(spark)).collect()))
    assert {got[k] for k in range(1, 400)} == {1} and {got[1000 + k] for k in range(3000)} == {1000} and 5000 not in got


def test_covered_and_taken_in(spark):
    records, tiers, own = tables(spark)
    questions = spark.createDataFrame([q for q in ASKED if q[0] in (1, 5, 7, 10, 9)], QUESTIONS)
    decisions = spark.createDataFrame([(1, "a3", "excluded", "user"), (1, "z1", "possible", "rule")], "sub_id long, entity_key string, bucket string, method string")
    found = Q.covered(questions, records, tiers, own, decisions)
    assert sorted((r.question_id, r.entity_key) for r in found.collect()) == [(1, "a2"), (1, "a4")]
    assert {r.question_id: r.entity_keys for r in Q.take_in(questions, found).collect()}[1] == ["a1", "a2", "a4"]
    assert [r.entity_key for r in Q.covered(questions, records, tiers, own, decisions, 1).collect()] == ["a2"]


def test_unask(spark):
    settled = spark.createDataFrame([(1, "a1"), (1, "z1"), (2, "p1")], "sub_id long, entity_key string")
    left = {r.question_id: r.entity_keys for r in Q.unask(spark.createDataFrame(ASKED, QUESTIONS), settled).collect()}
    assert 1 not in left and 3 not in left and 9 not in left and left[2] == ["a2"] and left[8] == ["a1"] and left[12] == ["a1"] and left[13] == ["a1"]


def test_carry(spark):
    records, tiers, own = tables(spark)
    decisions = spark.createDataFrame([(9, "a2", "possible", "rule")], "sub_id long, entity_key string, bucket string, method string")
    kinds = "sub_id long, entity_key string, bucket string"
    say = lambda *rows: sorted((r.entity_key, r.bucket) for r in Q.carry(spark.createDataFrame(rows, kinds), decisions, records, tiers, own).collect())
    assert say((9, "a1", "matched")) == [("a2", "matched")]  # not to another state, nor to red flags
    assert say((9, "a1", "excluded")) == [("a2", "excluded"), ("a3", "excluded")]
    assert say((9, "a1", "possible")) == [] and say((9, "p1", "excluded")) == [] and say((9, "g1", "excluded")) == [] and say((1, "o1", "excluded")) == []
    assert say((9, "a1", "matched"), (9, "a3", "excluded")) == []


def test_asking(spark):
    groups = [(1, f"N{k}", "TX", "distinctive", [f"k{k}"], "yes", k) for k in range(3)] + [(1, "N0", "OK", "distinctive", ["k9"], "no", 5)]
    person = [(2, "JOHN DOE", s, "person", [s], None, 1) for s in ("TX", "OK", "LA")]
    df = spark.createDataFrame(groups + person, "sub_id int, name string, state string, tier string, entity_keys array<string>, lean string, red_flags int")
    assert Q.questions_for(df, 4).where("sub_id = 1").count() == 4
    few = [(r.asked, r.entity_keys, r.suggestion, r.red_flags) for r in Q.questions_for(df, 2).where("sub_id = 1").orderBy("asked").collect()]
    assert few == [(1, ["k0", "k9"], None, 5), (2, ["k2"], "yes", 2), (3, ["k1"], "yes", 1)]
    assert Q.questions_for(df, 2).where("sub_id = 2").count() == 3
    assert Q.questions_for(df.where(F.lit(False))).collect() == []


def test_own_names_are_read_only_where_they_are_asked_about(spark):
    """A subject's own names grow with its questions, not with all names times all subjects."""
    from siltworks.plans import asked

    t = asked._tables(spark, "/root/testdata/sf0.001")
    about = t["asked"].select("question_id", "sub_id").join(t["lines"], "question_id").join(t["records"].select("entity_key", "name", "k"), "entity_key")
    want = {(r.sub_id, r.name) for r in about.where("k % 5 = sub_id % 5 and k % 8 = sub_id % 8").collect()}
    got = [tuple(r) for r in t["own"].select("sub_id", "name").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
