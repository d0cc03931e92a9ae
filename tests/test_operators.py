import datetime

from pyspark.sql import functions as F

from siltworks.operators import evaluate as E, grounding as G, levels as L, pasted, rows as R, rulematch, verdict as V
from siltworks.functions.names import name_core
from siltworks.resolve import candidates as C, index as I, remap as M, rules as D
from siltworks.streaming import marts as S


def test_modes_break_ties_by_value(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "k int, v string")
    assert {r.k: r.v for r in R.modes(df, ["k"], ["v"]).collect()} == {1: "a", 2: None}


def test_duplicates_and_nulls(spark):
    new = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")], "i int, k string")
    old = spark.createDataFrame([("y",)], "k string")
    assert {r.i: r.is_duplicate for r in R.duplicates(new, old, ["k"], [F.col("i")]).collect()} == {1: False, 2: True, 3: False, 4: False, 5: True}
    assert not any(r.is_duplicate for r in R.duplicates(new.where("i != 2"), None, ["k"], [F.col("i")]).collect())


def test_flags_ignore_nulls(spark):
    df = spark.createDataFrame([(1, None), (5, True)], "a int, b boolean").select("a", R.flags(big=F.col("a") > 3, b=F.col("b")).alias("f"))
    assert [r.f for r in df.orderBy("a").collect()] == [[], ["big", "b"]]


def test_rule_precedence(spark):
    rules = spark.createDataFrame([("f", "exact", "1926.501", None, "e"), ("f", "range", "1926.500", "1926.599", "wide"), ("f", "range", "1926.501", "1926.503", "inner"), ("f", "prefix", "1926", None, "p"), ("f", "prefix", "1926.9", None, "pp")], "family string, match_type string, pattern string, range_to string, hazard_code string")
    facts = spark.createDataFrame([("f", "1926.501"), ("f", "1926.502"), ("f", "1926.510"), ("f", "1926.901"), ("f", "1926.1"), ("f", "7"), ("g", "1926.501"), ("f", None), ("f", "1926.501")], "family string, section_key string")
    got = sorted((str(r.section_key), r.family, r.hazard_code) for r in rulematch.match_rules(facts, rules).collect())
    assert got == sorted([("1926.501", "f", "e")] * 2 + [("1926.502", "f", "inner"), ("1926.510", "f", "wide"), ("1926.901", "f", "pp"), ("1926.1", "f", "p"), ("7", "f", "other"), ("1926.501", "g", "other"), ("None", "f", "other")])
    assert rulematch.range_faults(rules).isEmpty()
    crossing = rules.union(spark.createDataFrame([("f", "range", "1926.502", "1926.700", "x")], rules.schema))
    assert rulematch.range_faults(crossing).count() == 2


# name, state, city of query and candidate, tier, at the address, same kind of business; what follows
PAIRS = [
    ("ACME", "TX", "DALLAS", "ACME", "TX", "WACO", "distinctive", False, False, "matched", "M1"),
    ("ACME", "TX", "DALLAS", "ACME SERVICES", "TX", "WACO", "distinctive", False, False, "matched", "M1b"),
    ("ACME", "TX", "DALLAS", "ACME", "OK", "TULSA", "distinctive", False, False, "matched", "M3"),
    ("ACME", "TX", "DALLAS", "ACME", "TX", "DALLAS", "distinctive", False, True, "uncertain", "N1"),
    ("ACME ROOFING", "TX", "DALLAS", "ACME PLUMBING", "TX", "DALLAS", "distinctive", False, False, "uncertain", "U3"),
    ("ACME", "TX", "DALLAS", "ZENITH", "TX", "DALLAS", "distinctive", False, False, "excluded", "X1"),
    ("BEST ROOFING", "TX", "DALLAS", "QUALITY ROOFING", "TX", "DALLAS", "generic", False, False, "excluded", "X2"),
    ("BEST ROOFING", "TX", "DALLAS", "BEST ROOFING", "OK", "TULSA", "generic", False, False, "uncertain", "U4"),
    ("SMITH", "TX", "DALLAS", "SMITH GROUP", "TX", "DALLAS", "medium", False, False, "uncertain", "U2"),
    ("SMITH", "TX", "DALLAS", "SMITH GROUP", "TX", "WACO", "medium", False, False, "excluded", "X3"),
    ("ACME WELDERS", "TX", "DALLAS", "ACME WELDRES", "OK", "TULSA", "distinctive", True, False, "matched", "M2"),
    ("ACME", "TX", "DALLAS", "ACME ZULU", "TX", "DALLAS", "distinctive", True, False, "uncertain", "S3"),
    ("ACME", "TX", "DALLAS", "ACME BRANCH 2", "TX", "DALLAS", "distinctive", False, False, "uncertain", "S2"),
    ("ACME", "TX", "DALLAS", "ACME TEXAS", "TX", "DALLAS", "distinctive", False, False, "uncertain", "S4"),
    ("ACME", "TX", "DALLAS", "ACME ZULU", "TX", "DALLAS", "distinctive", False, False, "excluded", "X1"),
]


def _pairs(spark):
    df = spark.createDataFrame([(i, *r[:9]) for i, r in enumerate(PAIRS)], "pair long, q_name string, q_state string, q_city string, c_name string, c_state string, c_city string, q_tier string, c_at_address boolean, c_other_kind boolean")
    return df.withColumns({"q_core": name_core(F.col("q_name")), "c_core": name_core(F.col("c_name"))})


def test_rule_cascade(spark):
    got = {r.pair: (r.bucket, r.rule_id) for r in D.decide(_pairs(spark)).collect()}
    assert got == {i: tuple(p[9:]) for i, p in enumerate(PAIRS)}


def test_trades(spark):
    df = spark.createDataFrame([("Roofing",), ("Plumbing & HVAC",), ("Baker",), (None,), ("238160",), ("paving",)], "t string").select(F.sort_array(D.trade_industries(F.col("t"))).alias("x"))
    assert [r.x for r in df.collect()] == [["2381"], ["2382"], [], [], ["2381"], ["2373", "2389"]]


BASE = dict(q_name="TOLMAR", q_core="TOLMAR", q_state="NV", q_city="Reno", q_tier="distinctive", c_name="TOLMAR", c_core="TOLMAR", c_state="NV", c_city="RENO")
PERSON = dict(q_name="ANNA VOSS", q_core="ANNA VOSS", q_tier="person", c_name="ANNA VOSS", c_core="ANNA VOSS")
COMPANY = dict(q_name="ANNA VOSS BUILDERS", q_core="ANNA VOSS", q_tier="person", c_name="ANNA VOSS BUILDERS", c_core="ANNA VOSS")
COMMON = dict(q_name="BEST ROOFING", q_core="", q_tier="generic", c_name="BEST ROOFING", c_core="")
#: one case or more for each way out of the cascade
CASES = [
    ("S1", dict(c_name="TOLMAR OF UTAH", c_core="TOLMAR UTAH", c_suffix=" OF UTAH")), ("S1", dict(q_suffix=" AT ELMS", q_name="TOLMAR AT ELMS", q_core="TOLMAR ELMS")),
    ("S2", dict(c_name="TOLMAR ELKO OFFICE", c_core="TOLMAR ELKO OFFICE")), ("M1", {}), ("M1", dict(q_tier="medium")), ("M1", dict(q_tier="medium", q_city="St. Louis", c_city="SAINT LOUIS")),
    ("M1", dict(q_aliases=["ORNE"], c_name="ORNE", c_core="ORNE")), ("M1", dict(c_name="X DBA Y", c_dba="TOLMAR")), ("M1_trade", dict(q_trade="roofing", c_industry="2382")), ("N1", dict(c_other_kind=True)),
    ("M1", dict(q_trade="roofing", c_industry="2362")), ("M1b", dict(c_name="TOLMAR GENERAL CONTRACTORS", c_city="ELKO")), ("J1", dict(c_name="TOLMAR JV", c_core="TOLMAR JV", c_jv=True, c_at_address=True)),
    ("U3", dict(q_name="TOLMAR ROOFING", c_name="TOLMAR PLUMBING", c_at_address=True)), ("U3", dict(q_name="TOLMAR ROOFING", c_name="TOLMAR PLUMBING")), ("M2", dict(c_name="TOLMARR", c_core="TOLMARR", c_at_address=True)),
    ("M2", dict(q_name="TOLMAR ROOF", c_name="TOLMAR ROOFING", c_at_address=True)), ("P2", dict(PERSON, c_name="ANNA VOSS JR", c_core="ANNA VOSS JR", c_at_address=True)),
    ("S3", dict(c_name="TOLMAR ZENITH", c_core="TOLMAR ZENITH", c_at_address=True)), ("P3", dict(COMPANY, c_state="OR", c_city="BEND")), ("P3", dict(COMPANY, c_city="ELKO")), ("X5", dict(PERSON, c_state="OR")),
    ("P3", dict(PERSON, c_city="ELKO", q_incorporated=True, c_incorporated=True)), ("X5", dict(PERSON, c_city="ELKO")), ("P1", dict(PERSON, c_city="RENOO")), ("P1", dict(PERSON, q_city=None, q_state=None)),
    ("M3", dict(c_state="OR")), ("M3_trade", dict(c_state="OR", q_trade="electrician", c_industry="2381")), ("S4", dict(c_name="TOLMAR NEVADA", c_core="TOLMAR NEVADA")), ("S4", dict(c_name="TOLMAR NEV", c_core="TOLMAR NEV")),
    ("S4", dict(c_name="TOLMAR ELKO", c_core="TOLMAR ELKO", c_city="ELKO")), ("X1", dict(c_name="TOLMAR ZENITH", c_core="TOLMAR ZENITH")), ("X1", dict(c_name="BRANDT", c_core="BRANDT")), ("X2", dict(COMMON, c_name="QUALITY ROOFING")),
    ("U4", dict(COMMON, c_state="OR")), ("U2", dict(q_tier="medium", c_name="TOLMAR HOMES", q_name="TOLMAR TILE")), ("X3", dict(q_tier="medium", q_name="TOLMAR TILE", c_name="TOLMAR HOMES", c_city="ELKO")),
    ("G1", dict(q_tier="medium", q_name="AB", q_core="AB", c_name="AB", c_core="AB", c_city="ELKO", q_initials=True)), ("U", dict(q_tier="medium", c_city="ELKO")), ("U", dict(q_tier="medium", c_state="OR")),
    ("U", dict(c_name="TOLMARR", c_core="TOLMARR")), ("U4", dict(q_aliases=["BEST ROOFING"], c_name="BEST ROOFING", c_core="", c_state="OR", q_alias_queries=[("BEST ROOFING", "", "generic", None, False)])),
]


def cases(spark, rows):
    kinds = {**dict.fromkeys(BASE, "string"), **D.OPTIONAL, "i": "int", "query_id": "int", "c_address": "string", "c_zip3": "string", "red_flags": "int", "by_licence": "boolean"}
    rows = [{"i": i, "query_id": 1, **BASE, **r} for i, r in enumerate(rows)]
    used = sorted({c for r in rows for c in r})
    return spark.createDataFrame([tuple(r.get(c) for c in used) for r in rows], ", ".join(f"{c} {kinds[c]}" for c in used))


def test_every_rule(spark):
    got = {r.i: r.rule_id for r in D.decide(cases(spark, [c for _, c in CASES]), given=("ANNA",)).collect()}
    assert [got[i] for i in range(len(CASES))] == [rule for rule, _ in CASES]
    assert {r for r, _, _ in D.rule_table()} - set(got.values()) == {"M1b_trade", "M2_trade"}


def test_address_expansion_only_raises(spark):
    rows = [dict(c_address="1 OAK"), dict(c_name="TOLMARR", c_core="TOLMARR", c_state="OR", c_address="1 OAK"), dict(c_name="TOLMAR ZENITH", c_core="TOLMAR ZENITH", c_address="1 OAK"), dict(c_name="BRANDT", c_core="BRANDT", c_address="1 OAK"), dict(c_name="TOLMAR ZENITH", c_core="TOLMAR ZENITH", c_address=None)]
    got = {r.i: (r.bucket, r.rule_id) for r in D.expand_addresses(cases(spark, rows)).collect()}
    assert got == {0: ("matched", "M1"), 1: ("matched", "M2"), 2: ("uncertain", "S3"), 3: ("excluded", "X1"), 4: ("excluded", "X1")}


def test_second_pass(spark):
    s1 = dict(q_tier="medium", c_address="1 OAK", c_zip3="895")
    rows = [
        dict(s1, c_name="TOLMAR OF RENO", c_core="TOLMAR RENO", c_suffix=" OF RENO"), dict(s1, c_name="TOLMAR CO OF UTAH", c_core="TOLMAR UTAH", c_suffix=" OF UTAH", c_city="ELKO"), dict(c_name="TOLMAR OF BEND", c_core="TOLMAR BEND", c_suffix=" OF BEND", c_address="2 OAK", c_zip3="895", q_tier="medium"),
        dict(q_tier="medium", c_industry="2381"), dict(c_name="TOLMAR ELECTRIC", q_name="TOLMAR ELECTRIC", c_state="OR", c_industry="2382"), dict(c_name="BRANDT", c_core="BRANDT", c_address="1 OAK", red_flags=2), dict(c_name="BRANDT", c_core="BRANDT", c_address="9 OAK", red_flags=2), dict(c_name="BRANDT", c_core="BRANDT", by_licence=True),
    ]
    rows = [{"c_address": None, "c_zip3": None, "red_flags": 0, "by_licence": False, **r} for r in rows]
    rows[3]["c_address"] = "1 OAK"
    got = {r.i: (r.bucket, r.rule_id) for r in D.second_pass(D.decide(cases(spark, rows))).collect()}
    assert got == {0: ("matched", "M1s"), 1: ("uncertain", "S1"), 2: ("uncertain", "S1"), 3: ("matched", "M1"), 4: ("uncertain", "M3u"), 5: ("uncertain", "R1"), 6: ("excluded", "X1"), 7: ("matched", "L1")}


def test_respelling(spark):
    rows = [("SERVICES OAKE", "OAKE", "OAK"), ("NORTH CREEK TILE", "NORTH CREEK", "NORTHCREEK"), ("NORTH TILE CREEK", "NORTH CREEK", "NORTHCREEK")]
    df = spark.createDataFrame(rows, "a string, b string, c string").select(D.respell(F.col("a"), F.col("b"), F.col("c")).alias("x"))
    assert [r.x for r in df.collect()] == ["SERVICES OAK", "NORTHCREEK TILE", None]


def test_search_tolerates_slips(spark):
    e = spark.createDataFrame([("k1", "ACME WELDERS", "ACME WELDERS", "TX", 5), ("k2", "ACME WELDRES", "ACME WELDRES", "OK", 1), ("k3", "ZENITH", "ZENITH", "TX", 9)], "entity_key string, clean_name string, name_core string, state string, n int")
    ix = I.token_index(e)
    q = spark.createDataFrame([(1, "ACME WELDERS", "ACME WELDERS", "TX"), (2, "NOTHING", "NOTHING", None)], "query_id int, clean_name string, name_core string, state string")
    got = {(r.query_id, r.entity_key): r.by for r in C.search(q, e, ix, I.token_frequency(ix)).collect()}
    assert got == {(1, "k1"): "name", (1, "k2"): "token"}


def test_remap(spark):
    dec = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", [3, 4, 5]), (3, "c", [6]), (4, "d", [9])], "decision_id int, entity_key string, activity_nrs array<int>")
    mem = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("y", 4), ("z", 5), ("c", 6)], "new_key string, activity_nr int")
    assert {r.decision_id: (r.action, r.new_key, r.shared) for r in M.follow(dec, mem).collect()} == {1: ("carry", "x", 2), 2: ("ask", "y", 2), 3: ("keep", "c", 1), 4: ("release", None, 0)}


def test_persist_and_settle(spark):
    cols = "sub_id int, entity_key string, bucket string, method string, rule_id string"
    now = spark.createDataFrame([(1, "a", "matched", "user", None), (1, "b", "excluded", "rule", "X1"), (1, "c", "uncertain", "question", "U")], cols)
    new = spark.createDataFrame([(1, "a", "excluded", "rule", "X1"), (1, "b", "matched", "rule", "M1")], cols)
    assert {(r.entity_key, r.bucket, r.method) for r in M.persist(now, new).collect()} == {("a", "matched", "user"), ("b", "matched", "rule"), ("c", "uncertain", "question")}
    said = spark.createDataFrame([(1, "c", "no")], "sub_id int, entity_key string, answer string")
    assert {r.entity_key: r.bucket for r in M.settle(now, said).collect()} == {"a": "matched", "b": "excluded", "c": "excluded"}
    p = spark.createDataFrame([(0.9, 0), (0.9, 1), (0.1, 0), (0.5, 0)], "p_same double, red_flags int")
    assert [r.bucket for r in M.by_probability(p).collect()] == ["matched", "question", "excluded", "uncertain"]


def judge(spark, facts=(), flags=(), hazards=()):
    """Codes and verdict of one entity."""
    known = dict(facts)
    df = spark.createDataFrame([("e", *(float(known[c]) if c in known else None for c in V.FACTS))], "entity string, " + ", ".join(f"{c} double" for c in V.FACTS))
    f = spark.createDataFrame([("e", kind, datetime.date(year, 3, 1) if year else None, visit, n) for n, (kind, year, visit) in enumerate(flags)], "entity string, kind string, day date, visit string, event_id long")
    h = spark.createDataFrame([("e", code, a, w, list(range(30))) for code, a, w in hazards], "entity string, hazard_code string, insp_all long, insp_window long, evidence array<long>")
    day = lambda y: F.lit(datetime.date(y, 1, 1))
    r = V.verdict(V.reasons(df, V.flag_reasons(f, day(2016), day(2019)), V.hazard_reasons(h))).first()
    return [x.code for x in r.reasons], r.verdict, {x.code: x for x in r.reasons}


def test_verdicts(spark):
    seen = dict(inspections_all=9, inspections_window=9)
    for facts, flags, hazards, codes, verdict in [
        (seen, [("willful", 2017, "a"), ("fta", 2010, "b"), ("fatcat_cited", None, None)], [], ["H_willful", "R_old_fatcat_cited", "R_old_fta"], "high"),
        (seen, [("fatality_pending", 2001, "a"), ("fatcat_not_cited", 2001, "b"), ("catastrophe_cited", 2018, "c")], [], ["R_fatality_pending", "R_catastrophe_cited"], "review"),
        (seen, [("repeat", 2020, "a"), ("repeat", 2020, "a")], [], ["R_repeat"], "review"),
        (seen, [("repeat", 2020, "a"), ("repeat", 2021, "b"), ("repeat", 2010, "c"), ("repeat", 2011, "d")], [], ["H_repeat"], "high"),
        (seen, [("repeat", 2020, "a"), ("repeat", 2010, "c"), ("repeat", 2011, "d")], [], ["R_repeat", "R_old_repeat_pattern"], "review"),
        (seen, [("repeat", 2010, "c")], [], ["R_old_repeat"], "no_flags"),
        (seen, [], [("falls", 3, 1), ("ladder", 3, 0), ("dust", 2, 1), ("other", 9, 9)], ["R_recurring_falls", "I_past_ladder"], "review"),
        (dict(rated_window=5, serious_window=4, p75=0.5, p90=0.8, peers=30, **seen), [], [], ["H_rate"], "high"),
        (dict(rated_window=4, serious_window=4, p75=0.5, p90=0.8, peers=30, **seen), [], [], ["R_rate"], "review"),
        (dict(rated_window=5, serious_window=4, p75=0.5, p90=0.8, peers=29, **seen), [], [], [], "no_flags"),
        (dict(files_without_inspection=2), [], [], ["I_no_inspection"], "no_record"),
        (dict(inspections_all=2, other_questions=1, ai_unchecked=1), [], [], ["I_ai_unchecked", "I_questions"], "no_recent"),
        (dict(licence_lapsed=1, deaths_reported=2, stale_records=1, **seen), [], [], ["R_stale", "R_licence", "R_ita_deaths"], "review"),
    ]:
        assert judge(spark, facts, flags, hazards)[:2] == (codes, verdict)
    by = judge(spark, seen, [("willful", 2018, f"v{k}") for k in range(25)], [("falls", 40, 2)])[2]
    assert by["H_willful"]["count"] == 25 and by["H_willful"].evidence == list(range(20)) == by["R_recurring_falls"].evidence
    events = spark.createDataFrame([("e", 1, "fatcat_not_cited", 1), ("e", 1, "fatality_cited", 2), ("e", 1, "willful", 3), ("e", 2, "fatcat_not_cited", 4)], "entity string, visit int, kind string, event_id int")
    assert {r.event_id for r in V.one_event_per_visit(events).collect()} == {2, 3, 4}


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "score double, label int")
    assert E.auc(df).first().auc == round((3 + 1.5 + 1 - 0) / 6, 6) or abs(E.auc(df).first().auc - 4.5 / 6) < 1e-6
    low, high = E.wilson(F.lit(8), F.lit(10))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert abs(r.a - 0.4902) < 1e-3 and abs(r.b - 0.9433) < 1e-3
    p, q = E.precision_recall(F.col("score") > 0.75, F.col("label") == 1)
    assert tuple(df.agg(p, q).first()) == (0.5, 0.5)


def test_levels(spark):
    df = spark.createDataFrame([(y, "a") for y in (1996, 1998, 2000)], "year int, k string")
    assert {r.window_years: r["count"] for r in L.over_windows(df, "year", 2000, (1, 3, 5)).groupBy("window_years").count().collect()} == {1: 1, 3: 2, 5: 3}


def test_grounding(spark):
    f = lambda a, e: spark.range(1).select(G.ungrounded(F.lit(a), F.lit(e)).alias("x")).first().x
    assert f("12 visits and 1,250.50", "12 1250.5") == [] and f("12%", "12") == ["12%"] and f("123", "1234") == ["123"] and f("two", "[2]") == [] and f("on 2020-01-02", "2020-01-03") == ["2020-01-02"]


def test_pasted_cap(spark):
    lines = spark.createDataFrame([(1, i, f"Sub {i}X") for i in range(60)], "paste_id int, line_no int, line string")
    assert pasted.parse_pasted(lines).count() == pasted.MOST_ROWS


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    events.write.parquet(src)
    S.run_stream(spark, src, events.schema, sink, ck)
    late = events.select((F.col("ts") + F.expr("INTERVAL '60' DAY")).alias("ts")).agg(F.max("ts")).first()[0]
    end = spark.createDataFrame([(-1, late, 0, "end", 0.0, "{}")], events.schema)
    end.write.mode("append").parquet(src)
    S.run_stream(spark, src, events.schema, sink, ck)
    S.run_stream(spark, src, events.schema, sink, ck)
    key = lambda r: (r.start, r.event_type)
    got = sorted(spark.read.parquet(sink).where("event_type != 'end'").collect(), key=key)
    want = sorted(S.additive(events).collect(), key=key)
    assert got == want and isinstance(got[0].start, datetime.datetime)
    halves = [S.additive(events.where(f"event_id % 2 = {k}")) for k in (0, 1)]
    merged = {key(r): r.n for r in S.merge_levels(*halves).collect()}
    assert merged == {key(r): r.n for r in want}
