import random
import re

import duckdb
import pytest

from siltworks.llm.quality import ACCURACY, ORACLE_SQL, RULES, assess, fit, report

from .samples import awkward, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_against_plain_counts(spark):
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = assess(docs).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    assert not any(r.kept and r.base_failed for r in got)
    assert sum(r.kept for r in got) > 0.5 * len(got)
    assert all(0 <= r.posterior <= 1 for r in got)


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in assess(documents(spark, sf)).collect() if r.doc_id in labels and not r.base_failed]
    bad = [r.kept for r in got if labels[r.doc_id] == 0]
    good = [r.kept for r in got if labels[r.doc_id] == 1]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_accuracies():
    r = random.Random(5)
    truth = [0.95, 0.9, 0.8, 0.7, 0.85, 0.6]
    counts = {}
    for _ in range(20_000):
        y = 1 if r.random() < 0.7 else -1
        p = tuple(0 if r.random() < 0.2 else y if r.random() < a else -y for a in truth)
        counts[p] = counts.get(p, 0) + 1
    from math import exp

    model = fit(sorted(counts.items()))
    for rule, a in zip(RULES, truth, strict=True):
        assert abs(1 / (1 + exp(-model.weight[rule])) - a) < 0.03
    assert abs(1 / (1 + exp(-model.prior)) - 0.7) < 0.03
    assert set(fit([]).weight) == set(RULES) and ACCURACY[0] > 0.5


def test_edges(spark):
    df = awkward(spark).unionByName(awkward(spark, [(30, "x\x0by\x1cz\x85w \xa0 " * 30, None, None), (31, "a b c " * 20_000, None, None)]))
    got = sorted(assess(df).collect(), key=str)
    want = sorted((brute(r.text) for r in df.collect()), key=str)
    assert sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    assert assess(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = assess(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_against_sql(spark, sf):
    path = f"/root/testdata/sf{sf}/documents.parquet"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
        want = con.execute(ORACLE_SQL).fetchall()
    got = [tuple(r) for r in report(spark.read.parquet(path)).collect()]
    assert sorted(got) == sorted(want) and 0 < sum(r[-1] for r in got) < len(got)
