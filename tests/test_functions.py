import duckdb
import pytest
from pyspark.sql import functions as F

from siltworks.functions import addresses as A, codes, names as N, narrative, similarity as S, text as T


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, a string, b string" if isinstance(rows[0], tuple) else "i int, a string")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


NAMES = {
    "Smith & Sons Roofing, L.L.C.": "SMITH SONS ROOFING",
    "THE  A. B. C. Builders Inc": "ABC BUILDERS",
    "12345678 - Acme Co.": "ACME",
    "AB12CD34567 - Acme Corp": "ACME",
    "Ｐérez Ｃonst. (TX)": "PEREZ CONST",
    "Jones d/b/a Quick Roof LLC": "JONES DBA QUICK ROOF",
    "Big Oak (JV)": "BIG OAK JV",
    "Company LLC": "COMPANY",
    "Straße Ør Ltd": "STRASSE OR",
    "A 1 Plumbing": "A1 PLUMBING",
    "Rock L.P.": "ROCK",
    None: "",
    "O'Neil’s Homes": "ONEILS HOMES",
    "Ohio Valley (Ohio)": "OHIO VALLEY",
}


def test_clean_name(spark):
    got = values(spark, list(NAMES), N.clean_name("a"))
    assert dict(zip(NAMES, got, strict=True)) == NAMES
    assert values(spark, got, N.clean_name("a")) == got


def test_name_parts(spark):
    rows = ["JONES DBA QUICK ROOF", "ABC ROOFING", "JOHN SMITH", "UNKNOWN COMPANY", "US DOL OSHA", "ROOFS OF TEXAS", "A JOINT VENTURE", "SMITH JOHN A", "SAN JOHN"]
    got = values(spark, rows, N.legal_part(F.col("a")), N.trade_part(F.col("a")), N.name_core(F.col("a")), N.initials_only(F.col("a")), N.is_placeholder(F.col("a")), N.place_suffix(F.col("a")), N.is_joint_venture(F.col("a")), N.is_person(F.col("a"), ("JOHN", "MARY"), ("SMITH",)))
    assert got[0][:3] == ("JONES", "QUICK ROOF", "JONES")
    assert got[1][2:4] == ("ABC", True)
    assert [g[4] for g in got] == [False, False, False, True, True, False, False, False, False]
    assert got[5][5] == " OF TEXAS" and got[6][6]
    assert [g[7] for g in got] == [False, False, True, False, False, False, False, True, False]


def test_addresses(spark):
    rows = ["123 N Main Street Suite 4", "123 north main st", "P.O. Box 55", "12B WESTPARK DRIVE", "500 N WEST TEMPLE", "Main street", None, "77 Eastern Ave"]
    assert values(spark, rows, A.address_key("a")) == ["123 MAIN", "123 MAIN", "POBOX 55", "12 PARK", "500 TEMPLE", None, None, "77 EASTERN"]
    assert values(spark, rows, A.address_unit("a"))[0] == "SUITE 4"
    assert values(spark, ["00000", "1234", "12345-6789", "abc", None, " 54321"], A.zip5("a")) == [None, "01234", "12345", None, None, "54321"]
    assert values(spark, [("1 N Oak", "1 S Oak"), ("1 NE Oak", "2 SE Oak"), ("1 Oak", "1 S Oak"), ("1 West Oak", "1 E Oak")], A.opposite_sides("a", "b")) == [True, True, False, True]


CODES = {
    ("19260651 J02", None): ("federal_1926", "1926.651", "1926.651(j)(2)"),
    ("19260062  d01iv", None): ("federal_1926", "1926.62", "1926.62(d)(1)(iv)"),
    ("19100147 C04 II B 3", "TX"): ("federal_1910", "1910.147", "1910.147(c)(4)(ii)(B)(3)"),
    ("19040007", None): ("federal_other", "1904.7", "1904.7"),
    ("19260405 C 4455 66", None): ("federal_1926", "1926.405", "1926.405(c) 4455 66"),
    ("19260405 1234567", None): ("federal_1926", "1926.405", "1926.405 1234567"),
    ("5A0002", None): ("general_duty", "5(a)(2)", "5(a)(2)"),
    ("General  duty clause", None): ("general_duty", "5(a)(1)", "5(a)(1)"),
    ("296-307-14510(04)(B)(II)", "WA"): ("state_WA", "WAC 296-307-14510", "WAC 296-307-14510(4)(b)(ii)"),
    ("296-62-07105A", None): ("state_WA", "WAC 296-62-07105a", "WAC 296-62-07105a"),
    ("0620040102 B03", "WA"): ("state_WA", "WAC 296-62-401", "WAC 296-62-401(2)(b)(iii)"),
    ("1552460901AC", "WA"): ("state_WA", "WAC 296-155-24609", "WAC 296-155-24609(1)(a)(C)"),
    ("155246090102 03X", "WA"): ("state_WA", "WAC 296-155-24609", "WAC 296-155-24609(1)(2)(iii)(X)"),
    ("15524609010203X", "WA"): ("state_WA", "WAC 296-155-24609", "WAC 296-155-24609(1)(2)(iii)(X)"),
    ("155246093 A00", "WA"): ("state_WA", "WAC 296-155-24609", "WAC 296-155-24609(a)"),
    ("15524609 ABC", "WA"): ("state_WA", "WAC 296-155-24609", "WAC 296-155-24609 ABC"),
    ("15500611", None): ("state_WA", "WAC 296-155-611", "WAC 296-155-611"),
    ("OAR 437-002-0221(03)(C)(B)(IV)", "OR"): ("state_OR", "OAR 437-002-0221", "OAR 437-002-0221(3)(c)(B)(iv)"),
    ("40 CFR 170.405(A)(2)(III)", "OR"): ("state_OR", "40 CFR 170.405", "40 CFR 170.405(a)(2)(iii)"),
    ("701005504 C  D", "OR"): ("state_OR", "OAR 437-001-0055", "OAR 437-001-0055(4)(c)(D)"),
    ("7010055 9Z", "OR"): ("state_OR", "OAR 437-001-0055", "OAR 437-001-0055 9Z"),
    ("7654321", "OR"): ("state_OR", "OR-OLD 765", "OR 7654321"),
    ("408.41463A(02)(B)", "MI"): ("state_MI", "R 408.41463a", "R 408.41463a(2)(b)"),
    ("408.1014(C)", None): ("state_MI", "MCL 408.1014", "MCL 408.1014(c)"),
    ("338.1502", "MI"): ("state_MI", "MCL 338.1502", "MCL 338.1502"),
    ("Rule (6)(02)", "MI"): ("state_MI", "MI RULE 6", "MI Rule 6(2)"),
    ("4080109202C3 D04", "MI"): ("state_MI", "MCL 408.1092", "MCL 408.1092(2)(c)(3)(d)(4)"),
    ("32551234", "MI"): ("state_MI", "R 325.51234", "R 325.51234"),
    ("325512340607 E", "MI"): ("state_MI", "R 325.51234", "R 325.51234(6)(7)(e)"),
    ("5155(D)(03)(A)(I)-2", "CA"): ("state_CA", "T8 CCR 5155", "T8 CCR 5155(d)(3)(A)(i)-2"),
    ("1644 A07 B", "CA"): ("state_CA", "T8 CCR 1644", "T8 CCR 1644(a)(7)(B)"),
    ("1644 77", "CA"): ("state_CA", "T8 CCR 1644", "T8 CCR 1644 77"),
    ("32030000", "CA"): ("state_CA", "T8 CCR 3203", "T8 CCR 3203"),
    ("3420012", "CA"): ("state_CA", "T8 CCR 342.12", "T8 CCR 342.12"),
    ("14300032 A", "CA"): ("state_CA", "T8 CCR 14300.32", "T8 CCR 14300.32(a)"),
    ("64010011", "CA"): ("state_CA", "LC 6401.11", "LC 6401.11"),
    ("3395.5", None): ("state_CA", "T8 CCR 3395.5", "T8 CCR 3395.5"),
    ("9 QRS 44.2", "UT"): ("state_other", "UT 9 QRS 44.2", "UT 9 QRS 44.2"),
    ("33 C 4", "PR"): ("state_other", "PR 33", "PR 33 C 4"),
    ("77 (B)(2)", "UT"): ("state_other", "UT 77", "UT 77 (B)(2)"),
    ("x9", None): ("state_other", "X9", "X9"),
    ("n/a", "CA"): ("unknown", None, "N/A"),
    ("", None): ("unknown", None, None),
}


def test_codes(spark):
    got = values(spark, list(CODES), codes.parse("a", "b").alias("p"))
    assert {k: tuple(g) for k, g in zip(CODES, got, strict=True)} == CODES


def test_natural_order(spark):
    keys = ["1926.10", "1926.9", "WAC 296-155-9", "WAC 296-155-24609"]
    got = values(spark, keys, T.natural_key(F.col("a")))
    assert sorted(range(4), key=got.__getitem__) == [1, 0, 2, 3]


@pytest.mark.parametrize("said,dead", [("The employee died.", True), ("He later died in the hospital", True), ("Diedrich drill rig", False), ("the engine died", False), ("She died of a heart attack", False), (None, False), ("Employee #1 was killed", True)])
def test_narrative(spark, said, dead):
    assert values(spark, [said, "x"], narrative.reports_death("a"))[0] is dead


def test_similarity_equals_duckdb():
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("ABCD") for _ in range(r.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(400)]
    with duckdb.connect() as con:
        want = [con.execute("SELECT jaro_winkler_similarity(?, ?), damerau_levenshtein(?, ?)", [a, b, a, b]).fetchall()[0] for a, b in pairs]
    for (a, b), (jw, dl) in zip(pairs, want, strict=True):
        assert abs(S.winkler(a, b) - jw) < 1e-9 and S.damerau(a, b) == dl, (a, b)


def test_batches_equal_single_pairs_and_bound(spark):
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("ABCDÉ") for _ in range(r.randint(0, 11)))
    pairs = [(word(), word()) for _ in range(500)] + [("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("A", "A")]
    batch = S.winkler_batch([a for a, _ in pairs], [b for _, b in pairs])
    assert all(abs(S.winkler(a, b) - x) < 1e-12 for (a, b), x in zip(pairs, batch, strict=True))
    got = values(spark, pairs, S.jaro_winkler("a", "b"), *(S.may_reach(F.col("a"), F.col("b"), k) for k in (0.5, 0.8, 0.92)))
    for (jw, *may), x in zip(got, batch, strict=True):
        assert abs(jw - x) < 1e-12 and all(m for m, k in zip(may, (0.5, 0.8, 0.92), strict=True) if x >= k)
    assert sum(not g[3] for g in got) > 300


def test_typo_equal():
    assert S.typo_equal("GARRISON BUILT", "GARISON BUILT") and S.typo_equal("NORTH STAR", "NORTHSTAR") and not S.typo_equal("COLMAR", "COLE") and not S.typo_equal("", "")


def test_coded_numbers_and_days(spark):
    assert values(spark, ["12.0", "2.5", "x", None, "7"], T.number_or_null(F.col("a"))) == [12, 2, None, None, 7]
    assert [str(x) for x in values(spark, ["2020-01-02 00:00:00", "2020", "2020-13-01"], T.day_or_null(F.col("a")))] == ["2020-01-02", "None", "None"]
