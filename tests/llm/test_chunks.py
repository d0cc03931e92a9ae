import hashlib
import random

import numpy as np

from siltworks.llm import chunks as C
from siltworks.llm.chunks import gear, keyed_chunks, remove_duplicates, report

from .samples import awkward, documents


def slow_gear(data):
    out, h = [], 0
    for b in data:
        h = ((h << 1) + int(C._GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def brute(rows):
    """The same chunks by a byte-wise loop, over documents in order of id."""
    first, made = {}, []
    for doc, text in rows:
        raw = (text or "").encode()
        h, at = slow_gear(raw), [0]
        for i in range(len(raw)):
            if (h[i] >> (32 - C.CUT_BITS)) == 0 and i + 1 >= C.WINDOW:
                at.append(i + 1)
        whole = lambda i: next(k for k in range(i, len(raw) + 1) if k == len(raw) or raw[k] & 0xC0 != 0x80)  # noqa: B023, E731
        at = sorted({*map(whole, at), len(raw)})
        full = []
        for a, b in zip(at, at[1:], strict=False):
            full += map(whole, range(a, b, C.MOST))
        at = sorted({*full, len(raw)})
        keys = []
        for a in at[:-1]:
            ends = [e for e in at if e >= a + C.LEAST]
            if ends:
                keys.append((a, ends[0]))
            elif a == 0 and len(raw):
                keys.append((0, len(raw)))
        made.append((doc, raw, keys))
        for a, b in keys:
            first[raw[a:b]] = min(doc, first.get(raw[a:b], doc))
    out = {}
    for doc, raw, keys in made:
        gone = np.zeros(len(raw), bool)
        for a, b in keys:
            if first[raw[a:b]] < doc:
                gone[a:b] = True
        spans = int((np.diff(np.concatenate(([False], gone, [False])).astype(int)) == 1).sum())
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_gear_is_the_rolling_hash():
    data = np.random.default_rng(1).integers(0, 256, 300, dtype=np.uint8)
    assert gear(data).tolist() == slow_gear(data.tolist())


def test_against_plain_loop(spark):
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(10_000, "a" * 5000), (10_001, "b" + "a" * 4000), (10_002, "short"), (10_003, "short")], "doc_id long, text string"))
    want = brute(sorted((r.doc_id, r.text) for r in docs.collect()))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in report(docs).collect()}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 5


def test_passages_resist_shifts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(100)]
    rows = []
    for k, p in enumerate(passages):
        rows += [(2 * k, f"{text(30)} {p} {text(25)}"), (2 * k + 1, f"{text(41)} {p} {text(17)}")]
    rows += [(1000 + k, text(100)) for k in range(200)]
    got = {x.doc_id: x.n_removed for x in report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] > 0 for k in range(100)) >= 98
    assert all(got[2 * k] == 0 for k in range(100)) and all(got[1000 + k] == 0 for k in range(200))


def test_edges(spark):
    df = awkward(spark)
    got = report(df).collect()
    assert len(got) == df.count() and all(r.n_removed == 0 for r in got)
    assert report(df.limit(0)).collect() == []
    assert keyed_chunks(np.zeros(0, np.uint8), np.array([0, 0, 0]))[0].tolist() == []
    wide = spark.createDataFrame([(k, "日本語のとても長い文章です。" * 30 + "é" * 700 + "\U0001f600" * n) for k, n in enumerate((3, 40, 700))], "doc_id long, text string")
    for r in remove_duplicates(wide).collect():
        assert bytes(r.kept_bytes).decode() is not None and (r.doc_id == 0) == (not r.removed)
    twice = df.selectExpr("doc_id + 100 AS doc_id", "text").unionByName(df.select("doc_id", "text"))
    again = {r.doc_id: r for r in report(twice).collect() if r.doc_id is not None}
    assert again[106].n_removed == again[106].n_bytes and again[106].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert again[6].n_removed == 0 and again[104].n_removed == 13
