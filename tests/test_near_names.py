"""Near names at crowded places: compared in blocks, each link once, none lost; filings ask only whether there is one."""

import random

import pytest
from pyspark.sql import functions as F

from siltworks import outside as O, warehouse as W
from siltworks.functions.similarity import winkler, winkler_batch, winkler_grid
from siltworks.plans import builds
from siltworks.resolve import candidates as C

EST, REF = "establishment_key string, clean_name string, state string, zip5 string, addr_key string, is_placeholder boolean", "source string, ref_id string, name string, state string, zip5 string, addr_key string"


@pytest.mark.filterwarnings("error")
def test_grid_against_pairs():
    r = random.Random(1)
    words = ["", "A", "AB", "Ä" * 3, "X" * 64, "X" * 65, "AB" * 33]
    for _ in range(60):
        w = "".join(r.choice("ABCDE 12") for _ in range(r.randint(1, 22)))
        k = r.randrange(len(w))
        words += [w, w[:k] + w[k + 1 :], w[:k] + "É" + w[k:], w[:k] + w[k : k + 2][::-1] + w[k + 2 :], w * 4]
    a = words[::2]
    for least in (0.6, 0.75, 0.93, 1.0):
        want = winkler_batch([u for u in a for _ in words], words * len(a)).reshape(len(a), len(words)) >= least
        assert (winkler_grid(a, words, least) == want).all() and want.any()
    assert winkler_grid([], words, 0.9).shape == (0, len(words)) and winkler_grid(a, [""], 0.9).sum() == 0


@pytest.mark.parametrize("few, block", [(0, 3), (20, 7), (10**9, 1000)])
def test_links_against_each_pair(spark, monkeypatch, few, block):
    monkeypatch.setattr(C, "FEW", few)
    monkeypatch.setattr(C, "BLOCK", block)
    r = random.Random(2)
    name = lambda: "".join(r.choice(["ACME", "ACNE", "OAK", "ZENITH"]) for _ in range(2)) + r.choice(["", " ROOFING", " ROFING"])
    at = lambda: ("TX", r.choice(["1", "1", "2", None]), r.choice(["1 MAIN", "1 MAIN", "2 MAIN", None]))
    est = [(f"e{k}", name(), *at(), k % 9 == 0) for k in range(40)]
    refs = list({(r.choice(["ita", "licence:x"]), r.choice([None, *map(str, range(25))]), name(), *at()) for _ in range(90)})
    want = {}
    for key, a, state, zip5, addr, placeholder in est:
        for source, ref, b, s, z, d in refs:
            same = a == b and state == s
            near = a != b and None not in (zip5, addr) and (state, zip5, addr) == (s, z, d) and min(len(a), len(b)) >= 5 and winkler(a, b) >= 0.93
            how = "M1" if same and zip5 and zip5 == z else "M2" if same and addr and addr == d else "M3" if near else None
            if how and not placeholder:
                want[key, source, ref] = min(how, want.get((key, source, ref), how))
    got = O.links(spark.createDataFrame(est, EST), spark.createDataFrame(refs, REF)).collect()
    assert {(x.establishment_key, x.source, x.ref_id): x.method for x in got} == want and len(got) == len(want)
    assert {"M1", "M2", "M3"} == set(want.values())


def test_what_is_linked_needs_no_citations_and_is_not_written(spark):
    """Links and filings read names and places; neither waits for citations, and no link is written or looked up in full for filings."""
    done = []

    def keep(name, df):
        done.append(name)
        return df

    build = W.Build(builds.raw(spark, "/root/testdata/sf0.001"), W.Settings(least_rated=1), keep)
    assert build["ita_establishment_year"].columns and not {"violation", "inspection", "ref_link", "reference"} & set(done)
    assert build["ref_link"].columns and not {"violation", "inspection", "ref_link"} & set(done)


def test_entities_are_named_alike(spark):
    build = builds.built(spark, "/root/testdata/sf0.001")
    columns = ["establishment_key", "clean_name", "addr_key", "zip5", "state", "is_placeholder"]
    named, served = build.named.select(*columns), build["establishment"].select(*columns)
    assert named.exceptAll(served).count() == served.exceptAll(named).count() == 0 < named.agg(F.count("*")).first()[0]
