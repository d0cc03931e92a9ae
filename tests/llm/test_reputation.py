import duckdb
import pytest

from siltworks.llm.reputation import ORACLE_SQL, Rule, judge, report, with_domains

from .samples import SF


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_against_sql(spark, sf):
    pages, labels = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    with duckdb.connect() as con:
        for t in ("pages", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        want = con.execute(ORACLE_SQL).fetchall()
    got = [tuple(r) for r in report(pages, labels).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == pages.count()


def frame(spark, rows):
    return spark.createDataFrame([(i, u, "x", "y", True) for i, u in enumerate(rows)], "page_id long, url string, host string, rule string, bad boolean")


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "page_id long, bad int")


def test_parts_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.NET/en/a?b#c", "x://net", "x://a.net/", "x://anet/", "x://q.org/fr/?x", "x://q.org/fr", "a://b://c/d", "x://example.com?q=/de/", "x://b.example.com/de/\nnext", "x://ÀB.net/é#", "x://"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(frame(spark, urls), outcomes(spark, [])).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("www.example.net", "/en/a", "example.net/en/", "allow"), 4: ("net", "", None, "allow"), 5: ("a.net", "/", "net/", "block"),
        6: ("anet", "/", None, "allow"), 7: ("q.org", "/fr/", "org/fr/", "allow"), 8: ("q.org", "/fr", None, "allow"), 9: ("b:", "//c/d", None, "allow"),
        10: ("example.com", "", None, "allow"), 11: ("b.example.com", "/de/\nnext", "example.com/de/", "block"), 12: ("Àb.net", "/é", "net/", "block"), 13: ("", "", None, "allow"),
    }
    assert judge(frame(spark, []), outcomes(spark, [(1, 1)])).collect() == []


def test_reputation(spark):
    bad = [f"x://bad{i % 3}.spam.com/{i}" for i in range(300)]
    good = [f"x://good{i % 3}.fine.org/{i}" for i in range(300)]
    new = ["x://new.spam.com/", "x://other.org/", "x://one.fine.org/"]
    rows = frame(spark, bad + good + new)
    known = [(i, int(i < 300)) for i in range(0, 600, 2)] + [(None, 1), (3, None), (0, 1)]
    got = {r.page_id: r for r in judge(rows, outcomes(spark, known), rules=[Rule("allow", "bad0.spam.com/7")]).collect()}
    assert len(got) == 603 and got[1].verdict == "block" and got[301].verdict == "allow"
    assert got[602].verdict == "allow" and got[600].bad_rate > 0.8 > 0.4 > got[602].bad_rate
    assert (got[72].rule, got[72].verdict) == ("bad0.spam.com/7", "allow")
    # a single bad page does not condemn a host
    one = judge(frame(spark, ["x://a.com/1", *good]), outcomes(spark, [(0, 1)] + [(i, 0) for i in range(1, 300)])).where("page_id = 0").first()
    assert one.verdict == "allow"


def test_suffix_rules(spark):
    rules = spark.createDataFrame([("com",), ("co.uk",), ("*.ck",), ("!www.ck",), ("city.kawa.jp",)], "suffix_rule string")
    want = {
        "a.b.com": ("b.com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "p.q.r.ck": ("q.r.ck", "r.ck"), "a.www.ck": ("www.ck", "ck"),
        "d.e.city.kawa.jp": ("e.city.kawa.jp", "city.kawa.jp"), "u@h.com:80": ("h.com", "com"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "": ("", ""), "local": ("local", "local"), "a.b.zz": ("b.zz", "zz"),
    }
    got = {r.host: (r.domain, r.suffix) for r in with_domains(spark.createDataFrame([(h,) for h in want], "host string"), rules).collect()}
    assert got == want


def test_rules_of_any_length(spark):
    long = "a.b.c.d.e.f.g.h"
    hosts = spark.createDataFrame([(f"x.y.{long}",), ("y.h",)], "host string")
    got = {r.host: (r.domain, r.suffix) for r in with_domains(hosts, spark.createDataFrame([(long,)], "suffix_rule string")).collect()}
    assert got == {f"x.y.{long}": (f"y.{long}", long), "y.h": ("y.h", "h")}
    assert with_domains(hosts, spark.createDataFrame([], "suffix_rule string")).count() == 2
