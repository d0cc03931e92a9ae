"""Filings, licences and links on hand-written rows, and checks that must notice a fault."""

import datetime as dt

from siltworks import outside as O
from siltworks.operators import checks as C

FILING = "id year_filing_for establishment_id company_name establishment_name ein street_address city state zip_code naics_code annual_average_employees total_hours_worked total_deaths total_dafw_cases total_djtr_cases total_other_cases created_timestamp".split()


def table(spark, columns, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))


def filing(n, firm, **more):
    return dict(id=str(n), year_filing_for="2020.0", establishment_id=f"{firm}.00", company_name=f"Acme{firm} Roofing LLC", establishment_name="Main Yard", ein="12-3456780", street_address="12 Main Street", state="tx", zip_code="75001-1234", naics_code="238160", annual_average_employees="20", total_hours_worked="40000", total_dafw_cases="1.0", total_djtr_cases="1") | more


def filed(spark, *rows):
    return {r.filing_id: r for r in O.filings(table(spark, FILING, rows)).collect()}


def test_last_filing_and_rates(spark):
    got = filed(spark, filing(1, 7), filing(2, 7, total_other_cases="2"), filing(3, 7, year_filing_for="2021"), filing(4, 8, total_hours_worked="0"), filing(5, 9, total_hours_worked="100", annual_average_employees="0"), filing(6, 10, total_hours_worked=None, zip_code="x", state=" "))
    assert set(got) == {2, 3, 4, 5, 6}
    assert (got[2].establishment_id, got[2].year, got[2].trir, got[2].dart, got[2].ein, got[2].company_clean, got[2].zip5, got[2].state, got[2].addr_key, got[2].dq_flags) == ("7", 2020, 20.0, 10.0, "123456780", "ACME7 ROOFING", "75001", "TX", "12 MAIN", [])
    assert got[4].dq_flags == ["hours_missing"] and got[4].trir is None and got[5].dq_flags == ["too_small_to_rate", "rate_implausible"] and got[6].dq_flags == ["hours_missing"] and got[6].zip5 is None and got[6].state is None


def test_implausible_hours(spark):
    got = filed(spark, filing(1, 1, annual_average_employees="100"), filing(2, 2, annual_average_employees="9"), filing(3, 3, annual_average_employees="10"), filing(4, 4, annual_average_employees="80"))
    assert {n: r.dq_flags for n, r in got.items()} == {1: ["hours_per_employee_implausible"], 2: ["hours_per_employee_implausible"], 3: [], 4: []}


def test_numbers_of_nobody(spark):
    many = [filing(n, n, ein="987654320") for n in range(26)]
    few = [filing(100 + n, 100 + n, ein="98-7654322") for n in range(25)]
    got = filed(spark, *many, *few, filing(200, 200, ein="00-0000000"), filing(201, 201, ein="12345"), filing(202, 202, ein=None))
    assert {n for n, r in got.items() if r.ein} == set(range(100, 125))


def test_nulls_repeats_and_no_rows(spark):
    empty = {c: None for c in FILING}
    rows = O.filings(table(spark, FILING, [empty, empty, filing(1, 1), filing(1, 1)])).collect()
    assert sorted((r.filing_id or 0, r.year or 0) for r in rows) == [(0, 0), (1, 2020)]
    none = O.filings(table(spark, FILING, []))
    assert none.count() == 0 and O.benchmark(none).count() == 0
    more = table(spark, [*FILING, "filed by", "trir"], [filing(1, 1) | {"filed by": "x", "trir": "9"}])
    assert O.filings(more).first().trir == 10.0


def test_licences_of_three_layouts(spark):
    a = table(spark, ["ContractorLicenseNumber", "UBI", "BusinessName", "Address1", "Zip", "State", "ContractorLicenseStatus", "LicenseExpirationDate"], [dict(ContractorLicenseNumber="A1", BusinessName="Old Name Inc", LicenseExpirationDate="1/2/2019"), dict(ContractorLicenseNumber="A1", BusinessName="Acme Roofing LLC", Address1="12 Main St", Zip="75001", State="tx", LicenseExpirationDate="12/31/2024"), dict(ContractorLicenseNumber="A1", BusinessName="Undated"), dict(BusinessName="No Number")])
    b = table(spark, ["license_number", "full_name", "lic_exp_date"], [dict(license_number="9", full_name="Beta Co", lic_exp_date="not a day")])
    d = table(spark, ["LicenseNo", "BusinessName", "BUS-NAME-2", "ExpirationDate", "Classifications(s)"], [{"LicenseNo": "5", "BusinessName": "Gamma", "BUS-NAME-2": "Gamma Roofs, Inc.", "ExpirationDate": "03/04/2025", "Classifications(s)": "C39"}, {"LicenseNo": "6", "BusinessName": "Delta", "BUS-NAME-2": ""}])
    got = {(r.source, r.number): r for r in O.licences({"WA L&I": a, "OR CCB": b, "CA CSLB": d}).collect()}
    first = got["WA L&I", "A1"]
    assert len(got) == 4 and (first.clean_name, first.expires, first.addr_key, first.state, first.dba_clean) == ("ACME ROOFING", dt.date(2024, 12, 31), "12 MAIN", "TX", None)
    assert (got["OR CCB", "9"].status, got["OR CCB", "9"].expires) == ("ACTIVE", None)
    assert (got["CA CSLB", "5"].dba_clean, got["CA CSLB", "5"].specialty, got["CA CSLB", "6"].dba_clean) == ("GAMMA ROOFS", "C39", None)


def test_links(spark):
    est = spark.createDataFrame([("e1", "ACME ROOFING", "TX", "75001", "12 MAIN", False), ("e2", "ZULU ROOFING", "TX", None, None, False), ("e3", "UNKNOWN", "TX", "75001", "12 MAIN", True)], "establishment_key string, clean_name string, state string, zip5 string, addr_key string, is_placeholder boolean")
    refs = spark.createDataFrame(
        [("ita", "1", "ACME ROOFING", "TX", "75001", "9 ELM"), ("ita", "2", "ACME ROOFING", "TX", "75999", "12 MAIN"), ("ita", "3", "ACMEE ROOFING", "TX", "75001", "12 MAIN"), ("ita", "3", "ACME ROOFING", "TX", "75001", "12 MAIN"), ("licence:x", "1", "ACME ROOFIN", "TX", "75001", "12 MAIN"), ("ita", "4", "ZULU ROOFING", "TX", None, None), ("ita", "5", "UNKNOWN", "TX", "75001", "12 MAIN"), ("ita", "6", "ACME ROOFING", "OK", "75001", "12 MAIN")],
        "source string, ref_id string, name string, state string, zip5 string, addr_key string",
    )
    got = {(r.establishment_key, r.source, r.ref_id): r.method for r in O.links(est, refs).collect()}
    assert got == {("e1", "ita", "1"): "M1", ("e1", "ita", "2"): "M2", ("e1", "ita", "3"): "M1", ("e1", "licence:x", "1"): "M3"}


def test_rules(spark):
    n = lambda **v: C.counted(spark.range(1), **{k: C.F.sum(C.F.lit(x)) for k, x in v.items()})
    rules = [C.Rule("same", "a", "b"), C.Rule("off", "a", "c"), C.Rule("sum", "c", "a + b + 1"), C.Rule("near", "a", "c", "warn", 6), C.Rule("most", "a", "11", "warn", at_most=True), C.Rule("more", "c", "10", "warn", at_most=True), C.Rule("none", "d")]
    got = C.judge([n(a=5, b=5), n(c=11, d=None)], rules)
    assert {r.check_name: r.passed for r in got.collect()} == dict(same=True, off=False, sum=True, near=True, most=True, more=False, none=True)
    assert [r.check_name for r in C.failed_errors(got).collect()] == ["off"]
