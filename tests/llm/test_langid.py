import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from siltworks.llm.langid import TOP, _counted, grams, identify, learn, least_score, predict

from .samples import awkward, documents


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: (r.lang, len(r.text)) for r in docs.collect()}
    got = identify(docs).collect()
    assert len(got) == len(truth)
    test = [r for r in got if r.held_out]
    assert {r.doc_id for r in test} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum(r.lang_pred == truth[r.doc_id][0] for r in test if truth[r.doc_id][1] > 40)
    assert right >= 0.97 * sum(truth[r.doc_id][1] > 40 for r in test)
    assert all(0 <= r.score <= 1 for r in got)


def test_lang_and_held_out_rows_teach_nothing(spark):
    docs = documents(spark).select("doc_id", "text", "lang")
    a = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs).collect()}
    wrong = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 'zz' ELSE lang END AS lang")
    assert {r.doc_id: (r.lang_pred, r.score) for r in identify(wrong).collect()} == a


def test_edges(spark):
    df = awkward(spark)
    got = {r.doc_id: r for r in identify(df).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und"
    assert got[1].score == 0.0 and got[None].held_out is False
    assert identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in predict(df, learn(df.limit(0))).collect()} == {"und"}


def plain_grams(text):
    """n-grams of one to three letters of words between boundary marks, by string operations."""
    marked = "".join(c if c.isalpha() else " " for c in text.lower())
    marked = " " + " ".join(marked.split()) + " "
    if marked.strip() == "":
        return []
    out = [c for c in marked if c != " "] + [marked[i : i + 2] for i in range(len(marked) - 1)]
    return out + [marked[i : i + 3] for i in range(len(marked) - 2) if marked[i + 1] != " "]


def plain_rank(all_grams):
    value = lambda g: sum((1 if c == " " else ord(c)) << (21 * k) for k, c in enumerate(g))
    return sorted(Counter(all_grams), key=lambda g, n=Counter(all_grams): (-n[g], value(g)))[:TOP]


def test_against_plain_out_of_place_distances(spark):
    docs = documents(spark).select("doc_id", "text", "lang")
    rows = docs.collect()
    learned = {}
    for r in rows:
        if r.lang is not None and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            learned.setdefault(r.lang, []).extend(plain_grams(r.text))
    profiles = {lang: {g: k for k, g in enumerate(plain_rank(g))} for lang, g in learned.items()}
    got = {r.doc_id: r for r in identify(docs).collect()}
    for r in rows:
        own = plain_rank(plain_grams(r.text or ""))
        if not own:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        distance = {lang: sum(abs(p[g] - k) if g in p else TOP for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(distance), key=distance.get)
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - (1 - distance[best] / (TOP * len(own)))) < 1e-12


def test_least_score(spark):
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    profiles = learn(docs)
    floor = least_score(docs, profiles)
    assert predict(docs, profiles).where(f"lang_pred != 'und' and score < {floor}").count() == 0 < floor
    other = spark.createDataFrame([("съешь же ещё этих мягких французских булок да выпей чаю",), ("いろはにほへと ちりぬるを",)], "text string")
    assert predict(other, profiles).where(f"score >= {floor}").count() == 0
    assert least_score(docs.limit(0), profiles) == 0.0


def test_every_labelled_document_counts(spark):
    """More documents of a language than were once drawn: all n-grams are counted, and the floor is that of all scores."""
    rows = [(k, f"ab{chr(99 + k % 20)} " * (1 + k % 3), "xx") for k in range(4800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = learn(docs)
    want = plain_rank([g for _, text, _ in rows for g in plain_grams(text)])
    value = lambda g: sum((1 if c == " " else ord(c)) << (21 * k) for k, c in enumerate(g))
    got = [v for _, v in sorted(zip(profiles.rank[0].tolist(), profiles.sorted[0].tolist(), strict=True))]
    assert got == [value(g) for g in want]
    scores = sorted(r.score for r in predict(docs, profiles).collect())
    assert abs(least_score(docs, profiles) - 0.5 * scores[47]) < 1e-4


def test_counting_holds_a_few_texts_at_a_time():
    text = [f"every text number{i} of a large batch " * 60 for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 1000), pa.array(text)], names=["lang", "text"])
    counted = {}
    tracemalloc.start()
    for out in _counted(iter([batch])):
        for lang, gram, n in zip(*(x.to_pylist() for x in out.columns), strict=True):
            counted[lang, gram] = counted.get((lang, gram), 0) + n
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10 * sum(map(len, text))  # all n-grams at once take over 50 bytes a character
    value, n = np.unique(np.concatenate([grams(x) for x in text[::2]]).view(np.int64), return_counts=True)
    assert {g: k for (lang, g), k in counted.items() if lang == "en"} == dict(zip(value.tolist(), n.tolist(), strict=True))
