import hashlib
import re

from siltworks.llm.decontaminate import find_contamination, report

from .samples import SF, awkward, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= own
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_every_window(spark, monkeypatch):
    docs, items = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert rows(report(docs, items)) == want
    monkeypatch.setattr("siltworks.llm.decontaminate.MOST_BITS", 1 << 10)  # a full bitmap
    assert rows(report(docs, items)) == want


def test_edges(spark):
    docs = awkward(spark).unionByName(awkward(spark, [(20, "x Word1 ÜBER1 y! a-a ... One-two THREE", None, None), (21, "t " * 3000, None, None)]))
    items = [(1, "one two three"), (2, "Über1"), (2, "a a a a a a a a a a a a"), (30, "t t t t t t t t t t t"), (None, "word1"), (5, None), (6, ""), (7, "..."), (9, "word1 über1"), (9, "word1 über1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    # Latin capitals outside A-Z stay as they are
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items)
    assert rows(report(docs, bench)) == want
    assert report(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in report(docs, bench.limit(0)).collect())
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in find_contamination(docs, bench).collect()}
    assert spans[4] == [(0, 2)]
