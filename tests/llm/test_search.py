import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltworks.llm import kernels as K, search
from siltworks.llm.queries import op12_ranked_lexical_search

from .samples import awkward
from ..oracle import spark_rows, sql_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i].update(terms(t))
    out = []
    for i, own in wanted.items():
        scores = []
        for d, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((i, rank, d, -s))
    return sorted(out, key=str)


ITEMS = [(1, "One TWO three word5 über"), (2, None), (3, ""), (4, "a the ß"), (4, "日本語 a A a"), (None, "no id"), (6, "--- !!"), (7, "İ wörd word976 nothing-like-it"), (8, "word1 word1 word2")]


@pytest.mark.parametrize("k,block", [(50, 1 << 20), (2, 4), (1, 1)])
def test_awkward(spark, k, block):
    more = [(None, "One no id", None, None), (50, "One Two", None, None), (49, "one two", None, None), (51, "ONE, two", None, None), (52, "wOrd\x00word1", None, None)]
    docs = awkward(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS term", "'x' AS doc_id", "2 AS score", "3 AS rank")
    got = sorted((tuple(r) for r in search.search(docs, items, k, block).collect()), key=str)
    assert got == brute(docs.select("doc_id", "text").collect(), ITEMS, k)


def test_no_rows(spark):
    docs, items = awkward(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.where("item_id = 2"))):
        none = search.search(d, i)
        assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, sf):
    assert spark_rows(op12_ranked_lexical_search(spark, sf)) == sql_rows(search.ORACLE_SQL, sf)


def test_string_ids_and_ties(spark):
    docs = [(k, "same words here") for k in range(500)] + [(1000, "same")]
    items = [("b", "words"), ("a", "same")]
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), spark.createDataFrame(items, "item_id string, text string"), 20).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 20)


def test_equal_hash_is_not_enough():
    own = search.Vocabulary(["abc", "abd"])
    data = np.frombuffer(b"abc xyz abd", np.uint8)
    start, end = np.array([0, 4, 8]), np.array([3, 7, 11])
    hit, term = own.find(data, start, end)
    assert hit.tolist() == [0, 2] and term.tolist() == [0, 1]
    own.hash = np.sort(K.span_hash(K.prefix_hash(data), np.array([4, 8]), np.array([7, 11])))
    own.term = np.array([0, 1], np.int32) if own.hash[0] == K.span_hash(K.prefix_hash(data), np.array([4]), np.array([7]))[0] else np.array([1, 0], np.int32)
    hit, term = own.find(data, start, end)
    assert hit.tolist() == [2] and term.tolist() == [1]
