import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from siltworks.llm.minhash import SKETCH_BITS, SKETCH_SAMPLES, differing_bits, most_differing_bits, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows, numerator=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= numerator * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def corpus(seed, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)]
    rows, made = [], []
    for i in range(n):
        if made and r.random() < 0.7:
            base = list(r.choice(made[:6]))
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                base[r.randrange(len(base))] = r.choice(vocabulary)
        else:
            base = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 40, 150, 400]))]
        made.append(base)
        rows.append((i, r.choice([" ", "\n"]).join(w.upper() if r.random() < 0.1 else w for w in base)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    r = random.Random(seed)
    r.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == brute(rows)


def test_edges(spark):
    long = " ".join(f"word{k}" for k in range(30_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t ", "c"), (4, "One", "d"), (5, "oNE", None), (6, long, "x"), (7, long + " tail", "x"), (None, "one", "x"), (8, "ÉÉ ßß", "z"), (4, "One", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string").selectExpr("*", "'x' AS node", "1 AS digest")
    got = defaultdict(set)
    for x in near_duplicates(df).collect():
        got[x.doc_id].add((x.n_shingles, x.component_id, x.kept))
    assert got[1] == {(0, 1, True)} and got[2] == {(0, 2, True)} and got[3] == {(0, 3, True)}
    assert got[4] == {(1, 4, True)} and got[5] == {(1, 4, False)}
    assert got[6] == {(29_996, 6, True)} and got[7] == {(29_997, 6, False)}
    assert got[None] == {(1, None, True)} and got[8] == {(1, 8, True)}
    assert near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("numerator", [80, 85])
def test_sketches_lose_less_than_stated(numerator):
    """The count's distribution as a mixture over the binomial number of differing samples."""
    n, m, p = SKETCH_SAMPLES, SKETCH_BITS, 1 - numerator / 100
    at = [1.0] + [0.0] * m
    lost = 0.0
    for d in range(n + 1):
        lost += math.comb(n, d) * p**d * (1 - p) ** (n - d) * sum(at[most_differing_bits(numerator) + 1 :])
        for _ in range(2):
            at = [(at[k - 1] * (1 - (k - 1) / m) if k else 0) + (at[k + 1] * (k + 1) / m if k < m else 0) for k in range(m + 1)]
    assert 1e-8 < lost < 1e-6


words = st.lists(st.integers(-(2**63), 2**63 - 1), min_size=16, max_size=16)


@settings(max_examples=60, deadline=None)
@given(words, words)
def test_sketch_distance_counts_all_bits(x, y):
    got = differing_bits(np.array([x], np.int64), np.array([y], np.int64))
    assert got.tolist() == [sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x, y, strict=True))]


def families(seed, n=8, size=24):
    """Families whose members are 0.80 to 0.92 alike, so many links pass no hub."""
    r = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(3000)]
    rows = []
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(400)]
        for _ in range(size):
            own = list(base)
            for at in r.sample(range(400), r.choice([1, 2, 3, 3, 4])):
                own[at] = r.choice(vocabulary)
            rows.append(" ".join(own))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,crowd", [(5, 2048), (6, 4)])
def test_links_near_the_threshold(spark, seed, crowd):
    """With and without splitting of crowded buckets; texts also share a license that fills whole buckets."""
    rows = families(seed)
    r = random.Random(seed)
    common = " ".join(f"l{k}" for k in range(300))
    rows += [(10_000 + k, common + " " + " ".join(f"x{r.randrange(10**9)}" for _ in range(r.choice([40, 150, 300])))) for k in range(60)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), crowd=crowd).collect()
    want = brute(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == want
    assert 5 < sum(k for _, _, k in want.values()) < len(rows) - 60


def test_hubs_with_many_pairs(spark, monkeypatch):
    monkeypatch.setattr("siltworks.llm.minhash.HUB_PAIRS", 3)
    rows = families(7, 2, 30)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == brute(rows)
