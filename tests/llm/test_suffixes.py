import hashlib
import random

import numpy as np
import pytest

from siltworks.llm import queries
from siltworks.llm.suffixes import LENGTH, SuffixIndex, remove_repeats, report

from .samples import SF, awkward, documents


def brute(rows):
    first = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - LENGTH + 1):
            w = raw[i : i + LENGTH]
            if d is not None:
                first[w] = min(d, first.get(w, d))
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - LENGTH + 1):
            if d is not None and first[raw[i : i + LENGTH]] < d:
                gone[i : i + LENGTH] = True
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def hard(seed, n=120):
    """Copies, shifted copies, edits, common passages of about the length, repeats within a text, tiny alphabets."""
    r = random.Random(seed)
    text = lambda k, a="abcde fghij": "".join(r.choice(a) for _ in range(k))
    common = [text(k) for k in (48, 49, 50, 51, 55, 60, 70, 90, 200)]
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.2 and out:
            t = r.choice(out)[1]
        elif kind < 0.4 and out:
            t = list(r.choice(out)[1])
            for _ in range(r.randint(1, 3)):
                t[r.randrange(len(t))] = "é"
            t = text(r.randint(0, 3)) + "".join(t)
        elif kind < 0.5:
            t = text(r.randint(60, 200), "ab")
        elif kind < 0.55:
            t = "a" * r.randint(45, 130)
        else:
            t = text(r.randint(1, 150)) + r.choice(common) + text(r.randint(0, 60)) + r.choice(common) * r.randint(0, 2) + text(5)
        out.append((r.choice([i, i * 7 % n]) if False else i, t))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 3), (3, 5)])
def test_against_every_window(spark, seed, batches):
    docs = hard(seed)
    got = rows(report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), batches))
    assert got == brute(docs) and sum(g[2] > 0 for g in got) > 20


def test_documents(spark):
    docs = documents(spark).select("doc_id", "text")
    assert rows(report(docs)) == brute([tuple(r) for r in docs.collect()])


def test_edges(spark):
    same = "x" * 20 + "the quick brown fox jumps over the lazy dog and on " * 3
    df = awkward(spark).unionByName(awkward(spark, [(50, same, None, None), (50, same + "other", None, None), (51, "pre " + same, None, None), (None, same, None, None)]))
    assert rows(report(df)) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert report(df.limit(0)).collect() == []
    kept = {r.doc_id: bytes(r.kept_bytes) for r in remove_repeats(df).collect() if r.doc_id}
    assert kept[51] == b"pre "


def test_levels_merge(spark):
    index, sizes = SuffixIndex(spark), []
    for k in range(5):
        batch = spark.createDataFrame([(10 * k + i, f"{i} " * 40 + f"batch {k} " * 9) for i in range(4)], "doc_id long, text string")
        assert not index.add(batch).isEmpty()
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1]]
    for _, level in index.levels:
        own = [r.suffix for r in index._array(level).collect()]
        assert own and len(own) == len(set(own))
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("suffixes_")]


def test_query_goes_through_levels(spark, monkeypatch):
    """The registered query indexes several batches, scans older levels and merges two of them."""
    seen, scanned = [], []
    add = SuffixIndex.add

    def spy(self, batch):
        out = add(self, batch)
        seen.append([n for n, _ in self.levels])
        scanned.append(out.count())
        return out

    monkeypatch.setattr(SuffixIndex, "add", spy)
    assert queries.op7_suffix_index_dedup(spark, SF).where("n_removed > 0").count() > 0
    assert seen == [[1], [1, 1], [2, 1]] and all(scanned)


def test_levels_are_merge_scanned_without_a_shuffle(spark):
    index = SuffixIndex(spark, 3)
    for k in range(2):
        index.add(spark.createDataFrame([(10 * k + i, f"{i} some text " * 40) for i in range(4)], "doc_id long, text string"))
    with index._settings():
        a, b = (spark.table(t).select("suffix").hint("merge") for _, t in index.levels)
        plan = a.join(b, "suffix", "left_semi")._jdf.queryExecution().executedPlan().toString()
        counted = index._array(index.levels[0][1])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort " not in plan
    assert "SortAggregate" in counted and "Exchange" not in counted and " Sort " not in counted
    index.close()


def test_a_text_is_indexed_once(spark, monkeypatch):
    """Copies of a text go as a whole; rows that share its first id stay, and it is the only one that is indexed."""
    one, two, tail = "a text of which there are very many copies " * 4, "some other text that stands here alone, " * 3, "and a text with an end of its own "
    rows_ = [(k, one) for k in (7, 3, 3, *range(20, 60))] + [(3, two), (5, tail + one), (4, "short"), (6, "short"), (8, two), (None, one), (9, None), (10, "")]
    seen, add = [], SuffixIndex.add

    def spy(self, batch):
        seen.extend(r.doc_id for r in batch.select("doc_id").collect())
        return add(self, batch)

    monkeypatch.setattr(SuffixIndex, "add", spy)
    got = report(spark.createDataFrame(rows_, "doc_id long, text string"))
    assert rows(got) == brute(rows_)
    assert sorted(seen) == [3, 3, 3, 5]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]
