import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from siltworks.llm import storage

from . import test_decontaminate as dec, test_minhash as mh, test_secrets as sec
from .samples import SF, awkward, documents


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into and comes out of each stage."""
    docs, out = documents(spark, "/root/testdata/sf0.01"), []
    for name, stage in P.STAGES:
        made = storage.materialise(stage(spark, docs, SF.replace("0.001", "0.01")), name)
        out.append((docs, made))
        docs = made
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_language(stages):
    before, after = stages[0]
    assert ids(before) - ids(after) == {r.doc_id for r in before.collect() if not any(c.isalpha() for c in r.text or "")}


def test_other_languages_go(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    foreign = spark.createDataFrame([(900_001, "съешь же ещё этих мягких французских булок да выпей чаю " * 3), (900_002, "いろはにほへと ちりぬるを わかよたれそ"), (900_003, "12345 -- 678")], "doc_id long, text string")
    mixed = docs.unionByName(foreign.select("*", *(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes if c not in ("doc_id", "text"))))
    assert ids(mixed) - ids(P.identify_language(spark, mixed, "")) == {900_001, 900_002, 900_003}


def test_clashing_columns_keep_their_values(spark):
    mine = {"lang_pred": F.lit("mine"), "score": F.lit(7), "spans": F.concat(F.lit("s"), "doc_id"), "n_words": F.col("doc_id") + 77, "item_ids": F.lit("i"), "secrets": F.lit("none"), "kept": F.lit(True), "k1": F.lit("k"), "component_id": F.lit("c"), "own_score": F.lit(3)}
    docs = documents(spark).withColumns(mine)
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and [t for _, t in got.dtypes] == [t for _, t in docs.dtypes]
        rows = {r.doc_id: tuple(r[c] for c in mine) for r in got.collect()}
        assert rows and all(v == ("mine", 7, f"s{i}", i + 77, "i", "none", True, "k", "c", 3) for i, v in rows.items())


def test_run_deletes_what_stages_wrote(spark):
    import os

    root = storage.shared_dir(spark)
    before = set(os.listdir(root))
    assert P.run(spark, SF).count() > 0
    left = {name.partition("-")[0] for name in set(os.listdir(root)) - before}
    assert left <= {"secrets", "pieces", "lengths"}


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    want = mh.brute([(r.doc_id, r.text) for r in before.where("n_chars < 1200").collect()])
    small = P.drop_near_duplicates(before.sparkSession, before.where("n_chars < 1200"), "")
    assert ids(small) == {i for i, (_, _, kept) in want.items() if kept}
    assert len(ids(after)) < len(ids(before))


def test_near_copies_from_080_on(spark):
    """Pairs of 1,000 shingles, each planted at a similarity that the stage links or doesn't."""
    rows, gone = [], set()
    for k, changed in enumerate([81, 92, 100, 111, 112, 150] * 4):  # 111: (1000 - 111) / (1000 + 111) = 0.8002; 112: 0.7986
        base = [f"p{k}w{i}" for i in range(1004)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: 1004 - changed] + [f"p{k}x{i}" for i in range(changed)]))]
        if 1000 - changed >= 0.8 * (1000 + changed):
            gone.add(2 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ids(docs) - ids(dict(P.STAGES)["near_duplicates"](spark, docs, "")) == gone


def test_near_copies_against_all_pairs(stages):
    before, after = stages[1]
    before = before.where("n_chars < 1200")
    sets = [(r.doc_id, mh.shingles(r.text)) for r in before.collect()]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert ids(dict(P.STAGES)["near_duplicates"](before.sparkSession, before, "")) == {i for i, _ in sets if find(i) == i}


def test_decontamination(stages):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in before.sparkSession.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    want = dec.brute([(r.doc_id, r.text) for r in before.collect()], items)
    assert ids(after) == {r[0] for r in want if not r[5]} != ids(before)


def test_secrets(stages):
    before, after = stages[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        n = sum(sec.brute(texts[r.doc_id])[:3])
        assert (r.text == texts[r.doc_id]) == (n == 0) and r.n_chars == len(r.text)
        assert sum(sec.brute(r.text)[:3]) == 0


def test_packing(stages):
    before, after = stages[4]
    assert ids(after) == ids(before)
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()


def test_run(spark, stages):
    got = P.run(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, stages[-1][1].select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_edges(spark):
    for docs in (awkward(spark).withColumn("n_chars", F.length("text").cast("long")), awkward(spark).withColumn("n_chars", F.lit(0).cast("long")).limit(0)):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).collect()
        P.pack(spark, docs, SF).collect()
