"""The warehouse build over raw-like tables made from the driver's, each served table beside its SQL.

The raw tables are written by expressions that both engines read alike; names and streets are such that
cleaning leaves them as they are, so the SQL can say what a build must come to without cleaning anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks import warehouse as W
from siltworks.session import table
from siltworks.sources.scratch import keeper

from .marts import query

_DAY = "CAST(CAST({} AS DATE) AS STRING)"
_LATER = "CAST(CAST(CAST({} AS DATE) + INTERVAL {} DAY AS DATE) AS STRING)"
_NAME = "'FIRMA' || CAST(o_custkey AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN ' ROOFING' WHEN 1 THEN ' BUILDERS' ELSE '' END"
INSPECTION = f"""SELECT CAST(o_orderkey AS STRING) AS activity_nr, {_NAME} AS estab_name, CAST(o_orderkey % 90 + 1 AS STRING) || ' OAK RD' AS site_address, 'WACO' AS site_city, 'TX' AS site_state, CAST(20000 + o_custkey % 1000 AS STRING) AS site_zip,
 CAST(o_custkey % 90 + 1 AS STRING) || ' MAIN ST' AS mail_street, CASE WHEN o_orderkey % 4 = 0 THEN 'WACO' ELSE 'DALLAS' END AS mail_city, 'TX' AS mail_state, CAST(10000 + o_custkey % 900 AS STRING) AS mail_zip,
 CASE WHEN o_custkey % 4 = 0 THEN '0650000' ELSE '0620000' END AS reporting_id, 'A' AS owner_type, CASE o_orderkey % 7 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'A' ELSE 'H' END AS insp_type, CASE o_orderkey % 11 WHEN 0 THEN 'D' ELSE 'A' END AS insp_scope,
 CASE WHEN o_custkey % 3 = 0 OR o_orderkey % 5 = 0 THEN '111111' ELSE '238160' END AS naics_code, '' AS sic_code, CAST(o_orderkey % 12000 AS STRING) AS nr_in_estab, {_DAY.format('o_orderdate')} AS open_date,
 CASE WHEN o_orderstatus = 'P' THEN '' ELSE {_LATER.format('o_orderdate', 90)} END AS close_case_date FROM orders"""
VIOLATION = f"""SELECT CAST(CASE WHEN l_suppkey % 10 = 3 AND l_linenumber = 1 THEN l_orderkey + 90000000 ELSE l_orderkey END AS STRING) AS activity_nr, CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS citation_id, CASE WHEN l_returnflag = 'R' THEN 'X' ELSE '' END AS delete_flag,
 '1926' || lpad(CAST(l_partkey % 1500 AS STRING), 4, '0') || ' A01' AS standard, CASE l_suppkey % 6 WHEN 0 THEN 'W' WHEN 1 THEN 'R' WHEN 2 THEN 'O' WHEN 3 THEN 'U' ELSE 'S' END AS viol_type, {_DAY.format('l_shipdate')} AS issuance_date, '' AS contest_date,
 {_LATER.format('l_shipdate', 30)} AS final_order_date, CAST(CAST(l_quantity AS INT) * 100 AS STRING) AS initial_penalty, CAST(CAST(l_quantity AS INT) * 50 AS STRING) AS current_penalty, CASE WHEN l_linenumber = 7 THEN '77' ELSE '' END AS fta_insp_nr, '' AS fta_issuance_date,
 '1.0' AS nr_instances, '2' AS nr_exposed, '05' AS gravity FROM lineitem"""
ACCIDENT = f"SELECT CAST(900000 + o_orderkey AS STRING) AS summary_nr, {_DAY.format('o_orderdate')} AS event_date, 'fall' AS event_desc, 'A' AS project_type, 'B' AS const_end_use, CASE WHEN o_orderkey % 12 = 0 THEN 'X' ELSE '' END AS fatality FROM orders WHERE o_orderkey % 6 = 0"
INJURY = "SELECT CAST(900000 + o_orderkey AS STRING) AS summary_nr, CAST(o_orderkey AS STRING) AS rel_insp_nr, '1' AS injury_line_nr, '2020' AS load_dt, '30.0' AS age, 'M' AS sex, '12.0' AS nature_of_inj, '3.0' AS part_of_body, CASE WHEN o_orderkey % 24 = 0 THEN '1.0' ELSE '2.0' END AS degree_of_inj, '1' AS fat_cause, '1' AS const_op, '1' AS const_op_cause, '10' AS fall_distance FROM orders WHERE o_orderkey % 6 = 0"
# a full first line breaks off within a word; some second lines tell of a death
_FULL, _REST, _DIED = "The employee was working on a steep roof of a large house when he fell to the gr", "ound below. ", "He later died."
ABSTRACT = f"""SELECT CAST(900000 + o_orderkey AS STRING) AS summary_nr, line_nr, CASE line_nr WHEN '1' THEN '{_FULL}' WHEN '2' THEN '{_REST}' ELSE CASE WHEN o_orderkey % 18 = 0 THEN '{_DIED}' ELSE 'He was treated.' END END AS abstract_text
 FROM (SELECT o_orderkey, '1' AS line_nr FROM orders UNION ALL SELECT o_orderkey, '2' FROM orders UNION ALL SELECT o_orderkey, '3' FROM orders) WHERE o_orderkey % 6 = 0"""
# filings of the same firms, some with a slip in the name, at another place or of another trade; licences in two layouts
_SLIP = f"CASE o_custkey % 5 WHEN 1 THEN replace({_NAME}, 'FIRMA', 'FIRMMA') WHEN 2 THEN 'OTHER ' || {_NAME} ELSE {_NAME} END"
_FILED_AT = "CAST(o_custkey % 90 + 1 AS STRING) || ' MAIN ST' AS {}, CASE WHEN o_custkey % 7 = 3 THEN '99999' ELSE CAST(10000 + o_custkey % 900 AS STRING) END AS {}"
FILING = f"""SELECT CAST(o_orderkey AS STRING) AS id, CAST(CAST(year(o_orderdate) AS INT) AS STRING) || '.0' AS year_filing_for, CAST(o_custkey AS STRING) || '.00' AS establishment_id, {_SLIP} AS company_name, 'PLANT ' || CAST(o_custkey % 7 AS STRING) AS establishment_name,
 CASE o_custkey % 3 WHEN 0 THEN '12-3450000' WHEN 1 THEN '00-0000000' ELSE CAST(200000000 + o_custkey AS STRING) END AS ein, {_FILED_AT.format('street_address', 'zip_code')}, 'Dallas' AS city, 'tx' AS state, CASE WHEN o_custkey % 4 = 1 THEN '111111' ELSE '2381' || CAST(60 + o_custkey % 3 AS STRING) END AS naics_code,
 CAST(o_orderkey % 60 AS STRING) AS annual_average_employees, CAST(o_orderkey * 37 % 90000 AS STRING) AS total_hours_worked, '0' AS total_deaths, CAST(o_orderkey % 3 AS STRING) || '.0' AS total_dafw_cases, CAST(o_orderkey % 2 AS STRING) AS total_djtr_cases, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '1' END AS total_other_cases, '' AS created_timestamp FROM orders"""
_EXPIRES = "lpad(CAST(CAST(month(o_orderdate) AS INT) AS STRING), 2, '0') || '/' || lpad(CAST(CAST(day(o_orderdate) AS INT) AS STRING), 2, '0') || '/' || CAST(CAST(year(o_orderdate) AS INT) AS STRING)"
LICENCE_A = f"SELECT 'A' || CAST(o_custkey AS STRING) AS ContractorLicenseNumber, 'U' || CAST(o_custkey AS STRING) AS UBI, {_SLIP} AS BusinessName, {_FILED_AT.format('Address1', 'Zip')}, 'Dallas' AS City, 'tx' AS State, CASE WHEN o_orderstatus = 'F' THEN 'EXPIRED' ELSE 'ACTIVE' END AS ContractorLicenseStatus, {_EXPIRES} AS LicenseExpirationDate, '' AS SpecialtyCode1Desc FROM orders WHERE o_orderkey % 2 = 0"
LICENCE_B = f"SELECT CAST(o_custkey AS STRING) AS LicenseNo, 'OWNER ' || CAST(o_custkey AS STRING) AS BusinessName, {_NAME} AS `BUS-NAME-2`, {_FILED_AT.format('MailingAddress', 'ZIPCode')}, 'Dallas' AS City, 'TX' AS State, 'CLEAR' AS PrimaryStatus, {_EXPIRES} AS ExpirationDate, 'C39' AS `Classifications(s)` FROM orders WHERE o_orderkey % 3 = 0"
RULES = [("federal_1926", "exact", "1926.501", None, "fall"), ("federal_1926", "range", "1926.100", "1926.199", "ppe"), ("federal_1926", "prefix", "1926.9", None, "electric")]
LOOKUP = [("PTYP", None, "A", "New building"), ("ENDU", None, "B", "Bridge"), ("IN", "12.0", None, "Fracture"), ("BD", "3", None, "Arm")]


def raw(spark: SparkSession, d: str) -> W.Raw:
    def read(text: str) -> DataFrame:
        source = "lineitem" if "FROM lineitem" in text else "orders"
        return spark.sql(text.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: table(spark, d, source)})

    lookup = spark.createDataFrame(LOOKUP, "accident_code string, accident_number string, accident_letter string, accident_value string")
    rules = spark.createDataFrame(RULES, "family string, match_type string, pattern string, range_to string, hazard_code string")
    return W.Raw(read(INSPECTION), read(VIOLATION), read(ACCIDENT), read(INJURY), read(ABSTRACT), lookup, rules, None, read(FILING), {"WA L&I": read(LICENCE_A), "CA CSLB": read(LICENCE_B)})


_built: dict[tuple[str, str], W.Build] = {}


def built(spark: SparkSession, d: str) -> W.Build:
    """The warehouse of these tables; each is built once a session, with what it needs and no more, and then served."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        _built[key] = W.Build(raw(spark, d), W.Settings(least_rated=1), keeper(spark))
    return _built[key]


_CTES = (
    f"""WITH ri AS ({INSPECTION}), rv AS ({VIOLATION}), k AS (SELECT *, split_part(estab_name, ' ', 1) AS core, naics_code LIKE '23%' AS coded, md5(estab_name || '|' || replace(mail_street, ' ST', '') || '|' || mail_zip || '|TX') AS ek, CAST(open_date AS DATE) AS od,
 TRY_CAST(nullif(close_case_date, '') AS DATE) AS cd FROM ri), e AS (SELECT ek, bool_or(coded) AS any_coded FROM k GROUP BY 1), n AS (SELECT core, avg(CASE WHEN coded THEN 1.0 ELSE 0.0 END) AS share, count(DISTINCT estab_name) AS variety, bool_or(coded) AS any_coded FROM k GROUP BY 1),
 s AS (SELECT * FROM (SELECT k.*, CASE WHEN coded THEN 'naics23' WHEN e.any_coded THEN 'same_establishment' WHEN n.any_coded AND share >= 0.5 AND variety <= 5 THEN 'related_name' END AS reason FROM k JOIN e USING (ek) JOIN n USING (core)) WHERE reason IS NOT NULL),
 v AS (SELECT CAST(rv.activity_nr AS BIGINT) AS a, citation_id, delete_flag = 'X' AS is_deleted, CAST(substr(standard, 5, 4) AS BIGINT) AS sec, viol_type, CAST(issuance_date AS DATE) AS issued, CAST(final_order_date AS DATE) AS final_on, CAST(initial_penalty AS BIGINT) AS p0, CAST(current_penalty AS BIGINT) AS p1,
  fta_insp_nr <> '' AS is_fta, s.ek, s.od, s.cd IS NULL AS is_open FROM rv JOIN s ON rv.activity_nr = s.activity_nr),
 h AS (SELECT *, CASE WHEN sec = 501 THEN 'fall' WHEN sec BETWEEN 100 AND 199 THEN 'ppe' WHEN CAST(sec AS STRING) LIKE '9%' THEN 'electric' ELSE 'other' END AS hazard, viol_type IN ('S', 'W', 'R', 'U') AS serious, final_on <= (SELECT max(od) FROM s) AS is_final FROM v)"""
).replace("STRING", "VARCHAR")


@query(_CTES + """ SELECT CAST(activity_nr AS BIGINT) AS activity_nr, ek AS establishment_key, reason AS scope_reason, CASE WHEN reporting_id LIKE '__5%' THEN 'state_plan' ELSE 'federal' END AS jurisdiction, od AS open_date, cd AS close_date, cd IS NULL AS is_open, insp_scope = 'D' AS no_inspection,
 md5(replace(site_address, ' RD', '') || '|' || site_zip || '|' || open_date) AS site_group_id, concat_ws(',', CASE WHEN CAST(nr_in_estab AS BIGINT) >= 10000 THEN 'employees_implausible' END, CASE WHEN insp_scope = 'D' THEN 'no_inspection_conducted' END) AS flags FROM s""")
def build_inspections(spark: SparkSession, d: str) -> DataFrame:
    """Scope with its reasons, typed and flagged records."""
    t = built(spark, d)["inspection"]
    return t.select("activity_nr", "establishment_key", "scope_reason", "jurisdiction", "open_date", "close_date", "is_open", "no_inspection", "site_group_id", F.array_join("dq_flags", ",").alias("flags"))


@query(_CTES + """ SELECT a AS activity_nr, citation_id, is_deleted, 'federal_1926' AS std_family, '1926.' || sec AS section_key, '1926.' || sec || '(a)(1)' AS standard_cite, hazard AS hazard_code, serious AS is_serious_plus, is_final, is_fta, CAST(p0 AS DOUBLE) AS penalty_initial, issued < od AS early FROM h""")
def build_violations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of records in scope, their codes read and matched to hazards."""
    t = built(spark, d)["violation"]
    columns = ["activity_nr", "citation_id", "is_deleted", "std_family", "section_key", "standard_cite", "hazard_code", "is_serious_plus", "is_final", "is_fta"]
    return t.select(*columns, F.col("penalty_initial").cast("double").alias("penalty_initial"), F.array_contains("dq_flags", "issued_before_open").alias("early"))


@query(_CTES + """, c AS (SELECT a, count(*) FILTER (NOT is_deleted) AS citation_n, count(*) FILTER (NOT is_deleted AND serious) AS serious_plus_n, sum(p0) FILTER (NOT is_deleted) AS penalty FROM h GROUP BY 1)
 SELECT CAST(activity_nr AS BIGINT) AS activity_nr, coalesce(citation_n, 0) AS citation_n, coalesce(serious_plus_n, 0) AS serious_plus_n, CAST(penalty AS DOUBLE) AS penalty_initial, CASE WHEN CAST(activity_nr AS BIGINT) % 6 = 0 THEN 1 ELSE 0 END AS accident_n FROM s LEFT JOIN c ON a = CAST(activity_nr AS BIGINT)""")
def build_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Citations and accidents of each record, counted."""
    t = built(spark, d)["inspection"]
    return t.select("activity_nr", "citation_n", "serious_plus_n", F.col("penalty_initial").cast("double").alias("penalty_initial"), F.coalesce("accident_n", F.lit(0)).alias("accident_n"))


_FATAL = """, g AS (SELECT md5(replace(site_address, ' RD', '') || '|' || site_zip || '|' || open_date) AS visit, s.*, CAST(activity_nr AS BIGINT) AS a FROM s), c AS (SELECT a, count(*) FILTER (NOT is_deleted) AS cn, count(*) FILTER (NOT is_deleted AND serious) AS sn FROM h GROUP BY 1),
 f AS (SELECT g.*, coalesce(cn, 0) AS cn, coalesce(sn, 0) AS sn, a % 6 = 0 AS has_acc, a % 12 = 0 OR a % 18 = 0 AS fatal, insp_type = 'M' AS m, insp_scope = 'D' AS none_, cd IS NULL AND od >= CAST((SELECT max(od) FROM s) - INTERVAL 7 MONTH AS DATE) AS open_late FROM g LEFT JOIN c USING (a)),
 w AS (SELECT *, sum(sn) OVER (PARTITION BY ek, visit) AS vs, bool_or(m) OVER (PARTITION BY ek, visit) AS vm, bool_or(m AND NOT has_acc) OVER (PARTITION BY visit) AS sm FROM f)"""
_FATALITY = """CASE WHEN fatal AND vs > 0 THEN 'fatality_cited' WHEN (fatal OR m) AND none_ AND vs = 0 THEN 'fatcat_no_inspection' WHEN fatal AND cn = 0 AND open_late THEN 'fatality_pending' WHEN fatal THEN 'fatality_inspected_not_cited' WHEN m AND NOT has_acc AND vs > 0 THEN 'fatcat_cited'
  WHEN m AND has_acc AND vs > 0 THEN 'catastrophe_cited' WHEN m AND NOT has_acc AND open_late THEN 'fatality_pending' WHEN m AND NOT has_acc THEN 'fatcat_not_cited' WHEN NOT m AND NOT has_acc AND sn > 0 AND sm AND NOT vm THEN 'fatcat_site_cited' WHEN insp_type = 'A' AND NOT has_acc THEN 'accident_outcome_unknown' ELSE 'none' END"""


@query(f"{_CTES}{_FATAL} SELECT a AS activity_nr, {_FATALITY} AS fatality_status FROM w")
def build_statuses(spark: SparkSession, d: str) -> DataFrame:
    """What is known of a fatality at each record, in an order of precedence over visits and sites."""
    return built(spark, d)["inspection"].select("activity_nr", "fatality_status")


@query(_CTES + """ SELECT ek AS establishment_key, min(estab_name) AS clean_name, min(core) AS name_core, min(od) AS first_seen, count(*) AS insp_n, count(*) FILTER (insp_scope <> 'D') AS insp_conducted_n, count(*) FILTER (reason = 'naics23') AS construction_insp_n, bool_and(reason = 'related_name') AS related_only,
 (SELECT q.mail_city FROM s q WHERE q.ek = s.ek GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS city, (SELECT left(q.naics_code, 4) FROM s q WHERE q.ek = s.ek GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS primary_naics4 FROM s GROUP BY ek""")
def build_establishments(spark: SparkSession, d: str) -> DataFrame:
    """Entities with their counts and most frequent values."""
    t = built(spark, d)["establishment"]
    return t.select("establishment_key", "clean_name", "name_core", "first_seen", "insp_n", "insp_conducted_n", "construction_insp_n", "related_only", "city", "primary_naics4")


@query(_CTES + """, i AS (SELECT ek, year(od)::INTEGER AS y, count(*) AS insp_n, count(*) FILTER (insp_type <> 'F' AND insp_scope <> 'D') AS insp_rated_n, count(*) FILTER (cd IS NULL) AS open_insp_n FROM s GROUP BY 1, 2),
 c AS (SELECT ek, year(od)::INTEGER AS y, count(*) AS viol_n, count(*) FILTER (serious) AS viol_serious_plus_n, count(*) FILTER (is_fta) AS viol_fta_n, sum(p0) AS p FROM h WHERE NOT is_deleted GROUP BY 1, 2)
 SELECT ek AS establishment_key, y AS year, insp_n, insp_rated_n, open_insp_n, coalesce(viol_n, 0) AS viol_n, coalesce(viol_serious_plus_n, 0) AS viol_serious_plus_n, coalesce(viol_fta_n, 0) AS viol_fta_n, CAST(p AS DOUBLE) AS penalty_initial_sum FROM i LEFT JOIN c USING (ek, y)""")
def build_years(spark: SparkSession, d: str) -> DataFrame:
    """The yearly mart, additive over years and entities."""
    t = built(spark, d)["establishment_year"]
    return t.select("establishment_key", "year", "insp_n", "insp_rated_n", "open_insp_n", "viol_n", "viol_serious_plus_n", "viol_fta_n", F.col("penalty_initial_sum").cast("double").alias("penalty_initial_sum"))


@query(_CTES + " SELECT ek AS establishment_key, year(od)::INTEGER AS year, hazard AS hazard_code, count(*) AS viol_n, count(DISTINCT a) AS insp_n, count(*) FILTER (serious) AS viol_serious_plus_n FROM h WHERE NOT is_deleted GROUP BY 1, 2, 3")
def build_hazards(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d)["establishment_hazard_year"].select("establishment_key", "year", "hazard_code", "viol_n", "insp_n", "viol_serious_plus_n")


@query(_CTES + """ SELECT md5(kind || '|' || a || '|' || citation_id) AS flag_id, kind, a AS activity_nr, ek AS establishment_key, issued AS event_date FROM (
 SELECT *, CASE viol_type WHEN 'W' THEN 'willful' ELSE 'repeat' END AS kind FROM h WHERE viol_type IN ('W', 'R') UNION ALL SELECT *, 'fta' FROM h WHERE is_fta) WHERE NOT is_deleted""")
def build_citation_flags(spark: SparkSession, d: str) -> DataFrame:
    """Red flags that come from citations, with their lineage."""
    t = built(spark, d)["red_flag"].where("kind in ('willful', 'repeat', 'fta')")
    return t.select("flag_id", "kind", "activity_nr", "establishment_key", "event_date")


@query(_CTES + " SELECT 'violation' AS source_table, activity_nr || '/' || citation_id AS source_key, 'citation references an inspection that does not exist' AS reason FROM rv WHERE activity_nr NOT IN (SELECT activity_nr FROM ri)")
def build_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Rows that point at records which don't exist."""
    return built(spark, d)["quarantine"]


_STATUS = f"""{_FATAL}, st AS (SELECT a, ek, visit, od, {_FATALITY} AS status FROM w)"""
_EXPECT = """SELECT * FROM (VALUES ('inspection_key_unique', 'error', (SELECT count(*) FROM s), (SELECT count(DISTINCT activity_nr) FROM s)), ('violation_key_unique', 'error', (SELECT count(*) FROM h), (SELECT count(DISTINCT (a, citation_id)) FROM h)),
 ('flag_id_unique', 'error', (SELECT count(*) FROM fl), (SELECT count(DISTINCT (kind, a, citation)) FROM fl)), ('members_cover_inspections', 'error', (SELECT count(*) FROM s), (SELECT count(*) FROM s)), ('year_mart_inspections', 'error', (SELECT count(*) FROM s), (SELECT count(od) FROM s)),
 ('year_mart_citations', 'error', (SELECT count(*) FROM live), (SELECT count(*) FROM live)), ('hazards_add_up', 'error', (SELECT count(*) FROM live), (SELECT count(*) FROM live)), ('only_inspected_are_rated', 'error', (SELECT count(*) FROM s WHERE insp_type <> 'F' AND insp_scope <> 'D'), (SELECT count(*) FROM s WHERE insp_type <> 'F' AND insp_scope <> 'D')),
 ('violations_have_inspections', 'error', (SELECT count(*) FROM h WHERE a NOT IN (SELECT CAST(activity_nr AS BIGINT) FROM s)), 0), ('inspections_have_establishments', 'error', (SELECT count(*) FROM s WHERE ek IS NULL), 0), ('flags_have_inspections', 'error', (SELECT count(*) FROM fl WHERE a NOT IN (SELECT CAST(activity_nr AS BIGINT) FROM s)), 0),
 ('fatcat_without_detail_is_flagged', 'error', (SELECT count(*) FROM s WHERE insp_type = 'M' AND CAST(activity_nr AS BIGINT) % 6 <> 0 AND CAST(activity_nr AS BIGINT) NOT IN (SELECT a FROM fl)), 0), ('flags_from_citations', 'error', (SELECT count(*) FROM fl WHERE citation IS NOT NULL), (SELECT count(*) FILTER (viol_type IN ('W', 'R')) + count(*) FILTER (is_fta) FROM live)),
 ('coded_inspections_in_scope', 'error', (SELECT count(*) FROM s WHERE reason = 'naics23'), (SELECT count(*) FROM k WHERE coded)), ('short_sic_not_in_scope', 'error', (SELECT count(*) FROM s WHERE length(sic_code) BETWEEN 1 AND 3), 0),
 ('scope_counted_again', 'error', (SELECT count(*) FROM s), (SELECT count(*) FROM k WHERE coded OR ek IN (SELECT ek FROM e WHERE any_coded) OR core IN (SELECT core FROM n WHERE any_coded AND share >= 0.5 AND variety <= 5))), ('citations_counted_again', 'error', (SELECT count(*) FROM h), (SELECT count(DISTINCT (activity_nr, citation_id)) FROM rv WHERE activity_nr IN (SELECT activity_nr FROM s))),
 ('persons_not_distinctive', 'error', 0, 0), ('injuries_of_one_person', 'error', (SELECT count(*) FROM (SELECT summary_nr FROM ij GROUP BY summary_nr, injury_line_nr HAVING min(sex) <> max(sex))), 0), ('no_case_number_in_names', 'error', (SELECT count(*) FROM s WHERE regexp_matches(estab_name, '^[A-Z]+[0-9][A-Z0-9]{8,}( |$)')), 0),
 ('pending_within_deadline', 'error', (SELECT count(*) FROM st WHERE status = 'fatality_pending' AND od < CAST((SELECT max(od) FROM s) - INTERVAL 7 MONTH AS DATE)), 0), ('told_deaths_have_status', 'error', (SELECT count(*) FROM st WHERE a % 18 = 0 AND status NOT IN ('fatality_cited', 'fatality_inspected_not_cited', 'fatality_pending', 'fatcat_no_inspection')), 0),
 ('not_cited_nowhere_on_visit', 'error', (SELECT count(*) FROM st WHERE status IN ('fatality_inspected_not_cited', 'fatcat_not_cited', 'fatcat_no_inspection') AND (ek, visit) IN (SELECT (g.ek, g.visit) FROM g JOIN live ON g.a = live.a WHERE serious)), 0), ('no_future_inspection', 'error', (SELECT count(*) FROM k WHERE od > current_date), 0),
 ('deaths_only_told', 'warn', (SELECT count(*) FROM g WHERE a % 18 = 0 AND a % 12 <> 0), 10), ('accident_detail_days_behind', 'warn', (SELECT date_diff('day', max(od) FILTER (CAST(activity_nr AS BIGINT) % 6 = 0), max(od)) FROM s), 548),
 ('hazard_other_percent', 'warn', (SELECT 100.0 * count(*) FILTER (hazard = 'other') / count(*) FROM live), 5), ('quarantined_citations', 'warn', (SELECT count(*) FROM rv WHERE activity_nr NOT IN (SELECT activity_nr FROM ri)), 374)) t(check_name, severity, f, x)"""


@query(f"""{_CTES}{_STATUS}, live AS (SELECT * FROM h WHERE NOT is_deleted), ij AS ({INJURY.replace('STRING', 'VARCHAR')}), fl AS (SELECT 'status' AS kind, a, NULL AS citation FROM st WHERE status NOT IN ('none', 'accident_outcome_unknown') UNION ALL SELECT viol_type, a, citation_id FROM live WHERE viol_type IN ('W', 'R') UNION ALL SELECT 'fta', a, citation_id FROM live WHERE is_fta), cc AS ({_EXPECT})
 SELECT check_name, severity, CAST(f AS DOUBLE) AS found, CAST(x AS DOUBLE) AS expected, CASE WHEN check_name IN ('accident_detail_days_behind', 'hazard_other_percent') THEN f <= x ELSE abs(f - x) <= CASE check_name WHEN 'deaths_only_told' THEN 10 WHEN 'quarantined_citations' THEN 50 ELSE 0 END END AS passed FROM cc""")
def build_checks(spark: SparkSession, d: str) -> DataFrame:
    """All checks of the build: totals counted in two ways, faults that must not be there, shares that must not grow."""
    return built(spark, d)["dq_check"]


@query(_CTES + f""" SELECT 900000 + CAST(activity_nr AS BIGINT) AS summary_nr, od AS event_date, 'New building' AS project_type, 'Bridge' AS const_end_use, '{_FULL}{_REST}' || CASE WHEN CAST(activity_nr AS BIGINT) % 18 = 0 THEN '{_DIED}' ELSE 'He was treated.' END AS narrative, CAST(1 AS BIGINT) AS injured_n,
 CASE WHEN CAST(activity_nr AS BIGINT) % 24 = 0 THEN 1 ELSE 0 END::BIGINT AS fatal_n, CAST(activity_nr AS BIGINT) % 12 = 0 AS fatality_flag, CAST(activity_nr AS BIGINT) % 18 = 0 AS death_in_narrative, CASE WHEN CAST(activity_nr AS BIGINT) % 18 = 0 AND CAST(activity_nr AS BIGINT) % 12 <> 0 THEN 'death_only_in_narrative' ELSE '' END AS flags FROM s WHERE CAST(activity_nr AS BIGINT) % 6 = 0""")
def build_accidents(spark: SparkSession, d: str) -> DataFrame:
    """Accidents of records in scope; their narratives' lines are joined, one that was broken off within a word without a blank."""
    t = built(spark, d)["accident"]
    return t.select("summary_nr", "event_date", "project_type", "const_end_use", "narrative", "injured_n", "fatal_n", "fatality_flag", "death_in_narrative", F.array_join("dq_flags", ",").alias("flags"))


@query(_CTES + " SELECT 900000 + CAST(activity_nr AS BIGINT) AS summary_nr, 1 AS line_nr, 30 AS age, 'M' AS sex, CASE WHEN CAST(activity_nr AS BIGINT) % 24 = 0 THEN 'fatality' ELSE 'hospitalized' END AS degree, 'Fracture' AS nature, 'Arm' AS body_part, CAST(10 AS DOUBLE) AS fall_distance_ft FROM s WHERE CAST(activity_nr AS BIGINT) % 6 = 0")
def build_injuries(spark: SparkSession, d: str) -> DataFrame:
    """People who were hurt, their codes in words."""
    return built(spark, d)["injury"].select("summary_nr", "line_nr", "age", "sex", "degree", "nature", "body_part", "fall_distance_ft")


_OUTSIDE = _CTES + f""", rf AS ({FILING}), ra AS ({LICENCE_A}), rb AS ({LICENCE_B}),
 f0 AS (SELECT CAST(id AS BIGINT) AS filing_id, CAST(CAST(year_filing_for AS DOUBLE) AS INTEGER) AS year, split_part(establishment_id, '.', 1) AS establishment_id, company_name AS company_clean, establishment_name AS establishment_clean, replace(ein, '-', '') AS e9, replace(street_address, ' ST', '') AS addr_key, upper(state) AS state, zip_code AS zip5, naics_code AS naics,
  CAST(annual_average_employees AS DOUBLE) AS employees, CAST(total_hours_worked AS DOUBLE) AS hours, CAST(CAST(total_dafw_cases AS DOUBLE) AS INTEGER) AS dafw, CAST(total_djtr_cases AS INTEGER) AS djtr, coalesce(TRY_CAST(total_other_cases AS INTEGER), 0) AS other_cases FROM rf QUALIFY row_number() OVER (PARTITION BY establishment_id, year_filing_for ORDER BY CAST(id AS BIGINT) DESC) = 1),
 jk AS (SELECT e9 FROM f0 GROUP BY 1 HAVING count(DISTINCT split_part(company_clean, ' ', 1)) > 25),
 fi AS (SELECT *, CASE WHEN e9 <> '000000000' AND e9 NOT IN (SELECT e9 FROM jk) THEN e9 END AS ein, CASE WHEN hours > 0 THEN (dafw + djtr + other_cases) * 200000.0::DOUBLE / hours END AS trir, CASE WHEN hours > 0 THEN (dafw + djtr) * 200000.0::DOUBLE / hours END AS dart,
  concat_ws(',', CASE WHEN hours <= 0 THEN 'hours_missing' END, CASE WHEN employees > 0 AND hours > 0 AND (hours / employees < 500 OR hours / employees > 4000) THEN 'hours_per_employee_implausible' END, CASE WHEN hours > 0 AND hours < 20000 THEN 'too_small_to_rate' END, CASE WHEN hours > 0 AND (dafw + djtr + other_cases) * 200000.0::DOUBLE / hours > 50 THEN 'rate_implausible' END) AS flags FROM f0),
 li AS (SELECT DISTINCT ON (source, number) * FROM (SELECT 'WA L&I' AS source, ContractorLicenseNumber AS number, UBI AS entity_id, BusinessName AS name, NULL AS dba, replace(Address1, ' ST', '') AS addr_key, Zip AS zip5, ContractorLicenseStatus AS status, strptime(LicenseExpirationDate, '%m/%d/%Y')::DATE AS expires FROM ra
  UNION ALL SELECT 'CA CSLB', LicenseNo, LicenseNo, BusinessName, "BUS-NAME-2", replace(MailingAddress, ' ST', ''), ZIPCode, PrimaryStatus, strptime(ExpirationDate, '%m/%d/%Y')::DATE FROM rb) ORDER BY source, number, expires DESC, status, name, entity_id, addr_key, dba),
 rr AS (SELECT 'ita' AS source, establishment_id AS ref_id, company_clean AS name, zip5, addr_key FROM fi UNION SELECT 'ita', establishment_id, establishment_clean, zip5, addr_key FROM fi UNION SELECT 'licence:' || source, number, name, zip5, addr_key FROM li UNION SELECT 'licence:' || source, number, dba, zip5, addr_key FROM li WHERE dba IS NOT NULL),
 es AS (SELECT DISTINCT ek, estab_name AS name, mail_zip AS zip5, replace(mail_street, ' ST', '') AS addr_key FROM s),
 lk AS (SELECT ek AS establishment_key, source, ref_id, min(method) AS method FROM (SELECT ek, source, ref_id, 'M1' AS method FROM es JOIN rr USING (name, zip5) UNION ALL SELECT ek, source, ref_id, 'M2' FROM es JOIN rr USING (name, addr_key)
  UNION ALL SELECT ek, source, ref_id, 'M3' FROM es JOIN rr USING (addr_key, zip5) WHERE es.name <> rr.name AND length(es.name) >= 5 AND length(rr.name) >= 5 AND jaro_winkler_similarity(es.name, rr.name) >= 0.93) GROUP BY 1, 2, 3)""".replace("STRING", "VARCHAR").replace("`", '"')


@query(_OUTSIDE + " SELECT filing_id, year, establishment_id, company_clean, addr_key, zip5, state, naics, ein, hours, round(trir, 6) AS trir, round(dart, 6) AS dart, flags FROM fi WHERE naics LIKE '23%' OR establishment_id IN (SELECT ref_id FROM lk WHERE source = 'ita')")
def build_filings(spark: SparkSession, d: str) -> DataFrame:
    """The last injury filing of each establishment and year, of the trade or of a linked entity; employer numbers that many share are none."""
    t = built(spark, d)["ita_establishment_year"]
    return t.select("filing_id", "year", "establishment_id", "company_clean", "addr_key", "zip5", "state", "naics", "ein", "hours", F.round("trir", 6).alias("trir"), F.round("dart", 6).alias("dart"), F.array_join("dq_flags", ",").alias("flags"))


@query(_OUTSIDE + " SELECT source, number, entity_id, name AS clean_name, dba AS dba_clean, addr_key, zip5, status, expires FROM li")
def build_licences(spark: SparkSession, d: str) -> DataFrame:
    """Licences of two layouts, the row of each that expires last."""
    return built(spark, d)["licence"].select("source", "number", "entity_id", "clean_name", "dba_clean", "addr_key", "zip5", "status", "expires")


@query(_OUTSIDE + " SELECT * FROM lk")
def build_links(spark: SparkSession, d: str) -> DataFrame:
    """Filings and licences of each entity, with the best way in which they are the same."""
    return built(spark, d)["ref_link"]


@query(_OUTSIDE + """ SELECT left(naics, 4) AS naics4, year, count(*) AS peer_n, round(sum(dafw + djtr + other_cases) * 200000.0::DOUBLE / sum(hours), 6) AS trir_pooled, round(sum(dafw + djtr) * 200000.0::DOUBLE / sum(hours), 6) AS dart_pooled,
 round(quantile_cont(trir, 0.5), 6) AS trir_p50, round(quantile_cont(trir, 0.75), 6) AS trir_p75, round(quantile_cont(dart, 0.5), 6) AS dart_p50, round(quantile_cont(dart, 0.75), 6) AS dart_p75 FROM fi WHERE naics LIKE '23%' AND flags = '' AND hours >= 20000 GROUP BY 1, 2""")
def build_rate_benchmarks(spark: SparkSession, d: str) -> DataFrame:
    """Injury rates of a trade's peers, pooled and by percentiles."""
    t = built(spark, d)["ita_benchmark"]
    return t.select("naics4", "year", "peer_n", *(F.round(x, 6).alias(x) for x in ("trir_pooled", "dart_pooled", "trir_p50", "trir_p75", "dart_p50", "dart_p75")))
