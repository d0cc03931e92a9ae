import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from siltworks.llm import infill

from .samples import awkward, documents
from ..oracle import spark_rows, sql_rows

TRICKY = [
    (20, "<", None, None), (21, "<<S", None, None), (22, "a<P>b", None, None), (23, "x<S>", None, None), (24, "<M>", None, None), (25, "<P<S<M", None, None),
    (26, "é‍\U0001f468\U0001f469", None, None), (27, "\r\n\x00\n", None, None), (None, None, None, None), (28, "S>M>P>", None, None), (29, "<S<S<S<P<M" * 50, None, None),
]


def plain(doc_id, text):
    """The contract over Python strings."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = text[:p], text[p:q], text[q:]
    form, out = ("spm", f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < 20 else ("psm", f"<P>{a}<S>{c}<M>{b}")
    return doc_id, n, form, p, q - p, sha(out), sha(text)


def test_report(spark):
    more = spark.createDataFrame([(1000 + k, "<S" * (k % 7) + "é<\n" * (k % 11) + ">" * (k % 3), None, None) for k in range(400)], "doc_id long, text string, lang string, source string")
    docs = documents(spark).select("doc_id", "text", "lang", "source").union(awkward(spark).select("doc_id", "text", "lang", "source"))
    docs = docs.union(spark.createDataFrame(TRICKY, docs.schema)).union(more)
    got = [tuple(r) for r in infill.report(docs).collect()]
    want = [plain(d, t) for d, t, *_ in docs.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, sf):
    assert spark_rows(infill.report(documents(spark, sf))) == sql_rows(infill.ORACLE_SQL, sf)


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t<PSM>aé1"), st.characters(exclude_categories=["Cs"])), max_size=40), st.sampled_from(["code_point", "word", "line"]))
def test_boundaries(text, unit):
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    cuts = infill.boundaries(points, unit).tolist()
    units = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    assert "".join(units) == text and all(units)
    if unit == "code_point":
        assert len(units) == len(text)
    if unit == "line":
        assert [u for u in text.split("\n")] == [u.removesuffix("\n") for u in units] + [""] * (not text or text.endswith("\n"))


@pytest.mark.parametrize("unit", ["word", "line"])
def test_cut_between_units(spark, unit):
    docs = documents(spark).select("doc_id", "text")
    texts = dict(docs.collect())
    for r in infill.fill_in_middle(docs, unit=unit, rate=100).withColumn("back", infill.restore(infill.F.col("output"), infill.F.col("form"))).collect():
        text = texts[r.doc_id] or ""
        assert r.back == text
        if r.form != "plain":
            cuts = set(infill.boundaries(np.frombuffer(text.encode("utf-32-le"), "<u4"), unit).tolist())
            assert {r.prefix_chars, r.prefix_chars + r.middle_chars} <= cuts


def test_extra_columns_and_no_rows(spark):
    clash = awkward(spark).selectExpr("*", "1 AS n", "'x' AS form", "'y' AS output", "2 AS h1", "0 AS prefix_chars")
    assert infill.report(clash).count() == clash.count()
    assert infill.report(clash.limit(0)).collect() == []
    with pytest.raises(ValueError):
        infill.fill_in_middle(clash, markers=("<A>", "<A>", "<M>"))
