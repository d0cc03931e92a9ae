"""A build of a small raw set: hand-written records, one of each case that matters."""

import datetime as dt

import pytest

from siltworks.warehouse import Raw, Settings, build

INSPECTION = "activity_nr estab_name site_address site_city site_state site_zip mail_street mail_city mail_state mail_zip reporting_id owner_type insp_type insp_scope naics_code sic_code nr_in_estab open_date close_case_date".split()
VIOLATION = "activity_nr citation_id delete_flag standard viol_type issuance_date contest_date final_order_date initial_penalty current_penalty fta_insp_nr fta_issuance_date nr_instances nr_exposed gravity".split()
INJURY = "summary_nr rel_insp_nr injury_line_nr load_dt age sex nature_of_inj part_of_body degree_of_inj fat_cause const_op const_op_cause fall_distance".split()
ACCIDENT = "summary_nr event_date event_desc project_type const_end_use fatality".split()


def table(spark, columns, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))


def insp(n, name, day="2020-05-01", **more):
    return dict(activity_nr=str(n), estab_name=name, mail_street="12 Main Street", mail_city="DALLAS", mail_state="TX", mail_zip="75001", site_address="5 Oak Rd", site_zip="75002", site_state="TX", reporting_id="0625100", insp_type="H", insp_scope="B", naics_code="238160", open_date=f"{day} 00:00:00", close_case_date="2021-01-01") | more


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    inspections = [
        insp(1, "Acme Roofing LLC"), insp(2, "ACME ROOFING, INC.", "2021-05-01", insp_type="M"), insp(3, "Acme Roofing", "2024-05-01", naics_code="111111", close_case_date=None), insp(4, "Acme Zulu Co", naics_code="111111", mail_street="1 Elm St"),
        insp(5, "Acme Zulu Co", "2020-06-01", mail_street="2 Elm St", nr_in_estab="20000"), insp(6, "UNKNOWN", "2020-07-01"), insp(7, "Farm", naics_code="111111", mail_street="9 Far Rd"), insp(8, "Old Co", "1999-01-01"), insp(9, "Acme Roofing", "2022-03-01", insp_type="F", insp_scope="D", reporting_id="0055100"),
    ]
    violations = [
        dict(activity_nr="1", citation_id="01001", standard="19260501 B13", viol_type="S", issuance_date="2020-06-01", initial_penalty="1000.00", current_penalty="1200", final_order_date="2020-08-01", nr_instances="2.0"),
        dict(activity_nr="1", citation_id="01002", standard="19260501 B13", viol_type="W", issuance_date="2020-04-01", initial_penalty="", current_penalty=None), dict(activity_nr="1", citation_id="01003", standard="X", viol_type="R", delete_flag="X"),
        dict(activity_nr="2", citation_id="01001", standard="19261053 A", viol_type="O", fta_insp_nr="77", initial_penalty="0.00"), dict(activity_nr="404", citation_id="01001", standard="19260501"),
    ]
    injuries = [
        dict(summary_nr="50", rel_insp_nr="1", injury_line_nr="1", age="30.0", sex="M", degree_of_inj="1.0", nature_of_inj="12.0", load_dt="2020"), dict(summary_nr="50", rel_insp_nr="1", injury_line_nr="1", age="31", sex="M", degree_of_inj="0", nature_of_inj="0", load_dt="2020"),
        dict(summary_nr="50", rel_insp_nr="1", injury_line_nr="1", age="45", sex="M", degree_of_inj="2", load_dt="2020"), dict(summary_nr="51", rel_insp_nr="5", injury_line_nr="1", age="99", sex="F", degree_of_inj="3", load_dt="2026", const_op_cause="7"), dict(summary_nr="52", rel_insp_nr="909", injury_line_nr="1", load_dt="2020"),
    ]
    wrapped = "x" * 78 + "di"
    raw = Raw(
        table(spark, INSPECTION, inspections), table(spark, VIOLATION, violations), table(spark, ACCIDENT, [dict(summary_nr="50", event_date="2020-04-30", event_desc="fall", project_type="A", fatality="X")]), table(spark, INJURY, injuries),
        table(spark, ["summary_nr", "line_nr", "abstract_text"], [dict(summary_nr="51", line_nr="2", abstract_text="ed later. "), dict(summary_nr="51", line_nr="1", abstract_text="The employee " + wrapped[13:]), dict(summary_nr="51", line_nr="3", abstract_text="Done.")]),
        table(spark, ["accident_code", "accident_number", "accident_letter", "accident_value"], [dict(accident_code="PTYP", accident_letter="A", accident_value="New building"), dict(accident_code="IN", accident_number="12.0", accident_value="Fracture")]),
        spark.createDataFrame([("federal_1926", "exact", "1926.501", None, "fall")], "family string, match_type string, pattern string, range_to string, hazard_code string"),
    )
    root = tmp_path_factory.mktemp("build")

    kept = {}

    def keep(name, df):
        df.write.parquet(f"{root}/{name}")
        kept[name] = spark.read.parquet(f"{root}/{name}")
        return kept[name]

    return build(raw, Settings(least_rated=1), keep) | {"_raw": raw, "_keys": kept["keys"], "_people": kept["injury_people"]}


def rows(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_scope(built):
    assert rows(built["inspection"], "activity_nr", "scope_reason") == {1: "naics23", 2: "naics23", 3: "same_establishment", 4: "related_name", 5: "naics23", 6: "naics23", 9: "naics23"}


def test_inspections(built):
    got = rows(built["inspection"], "activity_nr", "clean_name", "fatality_status", "citation_n", "is_open", "jurisdiction")
    assert got[1] == ("ACME ROOFING", "fatality_cited", 2, False, "federal") and got[2][1] == "fatcat_not_cited" and got[9][4] == "state_plan" and got[3][3]
    assert rows(built["inspection"], "activity_nr", "dq_flags")[5] == ["employees_implausible"] and rows(built["inspection"], "activity_nr", "dq_flags")[6] == ["placeholder_name"]
    assert rows(built["inspection"], "activity_nr", "is_provisional")[3] is True and rows(built["inspection"], "activity_nr", "open_date")[1] == dt.date(2020, 5, 1)


def test_violations(built):
    got = {(r.activity_nr, r.citation_id): r for r in built["violation"].collect()}
    a, b = got[1, "01001"], got[1, "01002"]
    assert (a.hazard_code, a.section_key, a.standard_cite, a.is_final, a.nr_instances) == ("fall", "1926.501", "1926.501(b)(13)", True, 2) and a.dq_flags == ["penalty_increased"]
    assert b.penalty_initial is None and b.dq_flags == ["issued_before_open", "penalty_not_recorded"] and got[2, "01001"].hazard_code == "other" and got[2, "01001"].is_fta
    assert {(r.source_table, r.source_key) for r in built["quarantine"].collect()} == {("violation", "404/01001"), ("accident_injury", "52/1/909"), ("accident_injury", "51/1/1")}


def test_accidents(built):
    got = {r.summary_nr: r for r in built["accident"].collect()}
    assert got[50].fatality_flag and got[50].injured_n == 2 and got[50].fatal_n == 1 and got[50].project_type == "New building" and got[50].dq_flags == ["no_narrative"]
    assert got[51].record_missing and got[51].dq_flags[0] == "accident_record_missing" and "died later. Done." in got[51].narrative
    people = {(r.summary_nr, r.person_n): (r.age, r.degree, r.nature) for r in built["injury"].collect()}
    assert people == {(50, 1): (31, "fatality", "Fracture"), (50, 2): (45, "hospitalized", None), (51, 1): (None, "not hospitalized", None)}


def test_entities_and_marts(built):
    est = {r.clean_name: r for r in built["establishment"].where("addr_key = '12 MAIN'").collect()}
    assert est["ACME ROOFING"].insp_n == 4 and est["ACME ROOFING"].name_variants[0] == "ACME ROOFING, INC." and est["ACME ROOFING"].display_name == "Acme Roofing"
    year = {(r.establishment_key, r.year): r for r in built["establishment_year"].collect()}[est["ACME ROOFING"].establishment_key, 2020]
    assert (year.insp_n, year.viol_n, year.viol_w_n, year.penalty_known_n, year.fatality_cited_n) == (1, 2, 1, 1, 1)
    assert {(r.kind, r.activity_nr) for r in built["red_flag"].collect()} == {("fatality_cited", 1), ("willful", 1), ("fta", 2), ("fatcat_not_cited", 2)}
    bench = {(r.level, r.window_years): r.peer_n for r in built["trade_benchmark"].collect()}
    assert (bench["all", 10], bench["all", 5], bench["all", 3]) == (2, 2, 1)
    assert [r.check_name for r in built["dq_check"].where("severity = 'error' and not passed").collect()] == []


def test_checks_notice_faults(built, spark):
    """Tables spoilt in one place each: the rule that watches it fails."""
    from siltworks import quality

    found = lambda **spoilt: {r.check_name for r in quality.checks(built["_raw"], built["_keys"], built["_people"], built | spoilt, Settings(least_rated=1)).collect() if r.severity == "error" and not r.passed}
    assert found() == set()
    insp, viol, flags = built["inspection"], built["violation"], built["red_flag"]
    assert {"inspection_key_unique", "scope_counted_again"} <= found(inspection=insp.union(insp.where("activity_nr = 1")))
    assert {"scope_counted_again", "violations_have_inspections", "flags_have_inspections"} <= found(inspection=insp.where("activity_nr != 1"))
    assert found(violation=viol.where("citation_id != '01002'")) >= {"citations_counted_again", "year_mart_citations", "flags_from_citations"}
    assert found(red_flag=flags.where("activity_nr != 2")) == {"fatcat_without_detail_is_flagged", "flags_from_citations"}
    assert found(establishment=built["establishment"].where("clean_name != 'ACME ROOFING'")) == {"inspections_have_establishments"}
    assert found(establishment=built["establishment"].withColumn("clean_name", quality.lit("FCX2024XEG41 ROOFING"))) == {"no_case_number_in_names"}
    late = insp.withColumn("fatality_status", quality.F.when(quality.c("activity_nr") == 1, "fatality_pending").otherwise(quality.c("fatality_status")))
    assert found(inspection=late) == {"pending_within_deadline"}
    assert found(inspection=late.replace("fatality_pending", "fatcat_not_cited")) == {"not_cited_nowhere_on_visit"}
    assert found(accident=built["accident"].withColumn("death_in_narrative", quality.lit(True)), inspection=late.replace("fatality_pending", "none")) == {"told_deaths_have_status"}
