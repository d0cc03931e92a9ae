"""Verdicts over the driver's tables: every kind of reason, with its count and evidence, beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.operators import verdict as V
from siltworks.session import table

from .marts import query

#: kinds of red flags by order number; numbers beyond have none
KINDS = (
    "fatality_cited", "fatcat_cited", "willful", "fta", "fatality_pending", "fatality_inspected_not_cited", "fatcat_not_cited", "fatcat_site_cited",
    "catastrophe_cited", "fatcat_no_inspection", "repeat", "repeat", "repeat",
)
RECENT, WINDOW = "1997-06-01", "1998-01-01"
_FLAGS = f"""SELECT o_custkey AS entity, o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS STRING) AS visit,
 CASE CAST(floor(o_totalprice) AS BIGINT) % 40 {' '.join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(KINDS))} END AS kind FROM orders"""
_HAZARDS = f"""SELECT o_custkey AS entity, CASE o_orderkey % 5 WHEN 0 THEN 'other' ELSE 'h' || CAST(o_orderkey % 5 AS STRING) END AS hazard_code, o_orderkey AS event_id, CAST(o_orderdate AS DATE) >= DATE '{WINDOW}' AS inside FROM orders WHERE o_totalprice > 150000"""
_PEOPLE = f"""SELECT c_custkey AS entity, c_name AS name, c_custkey % 40 + 5 AS peers, 0.4 AS p75, 0.6 AS p90,
 CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 0 END AS pending_questions, CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS unresolved_flags, CASE WHEN c_custkey % 7 = 0 THEN 3 ELSE 0 END AS ai_unchecked,
 CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS stale_records, CASE WHEN c_custkey % 19 = 0 THEN 4 ELSE 0 END AS profile_questions, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS other_questions,
 CASE WHEN c_acctbal < -900 THEN 2 ELSE 0 END AS dart_years_above, CASE WHEN c_custkey % 29 = 0 THEN 1 ELSE 0 END AS licence_lapsed, CASE WHEN c_custkey % 31 = 0 THEN 1 ELSE 0 END AS deaths_reported,
 c_custkey % 3 AS files_without_inspection FROM customer"""
_COUNTS = f"""SELECT o_custkey AS entity, count(*) AS inspections_all, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) >= DATE '{WINDOW}') AS inspections_window, count(*) FILTER (WHERE CAST(o_orderdate AS DATE) >= DATE '{WINDOW}' AND o_orderstatus <> 'P') AS rated_window,
 count(*) FILTER (WHERE CAST(o_orderdate AS DATE) >= DATE '{WINDOW}' AND o_orderstatus <> 'P' AND o_totalprice > 200000) AS serious_window, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice > 200000) AS open_cases FROM orders GROUP BY o_custkey"""

_position = " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(V.REASONS))
_known = ", ".join(f"'{k}'" for k in V.SERIOUS_KINDS)
_site = " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in V.SITE_KINDS.items())
_facts = {
    "R_open": "open_cases", "R_questions": "pending_questions", "R_unresolved": "unresolved_flags", "I_ai_unchecked": "ai_unchecked", "R_stale": "stale_records", "I_profile_questions": "profile_questions",
    "I_questions": "other_questions", "R_ita": "dart_years_above", "R_licence": "licence_lapsed", "R_ita_deaths": "deaths_reported",
}
_SQL = f"""WITH flags AS ({_FLAGS}), hazards AS ({_HAZARDS}), facts AS (SELECT * FROM ({_PEOPLE}) LEFT JOIN ({_COUNTS}) USING (entity)),
coded AS (SELECT entity, event_id, CASE WHEN kind IN ({_known}) THEN CASE WHEN day >= DATE '{RECENT}' THEN 'H_' ELSE 'R_old_' END || kind WHEN kind = 'fatality_pending' THEN 'R_fatality_pending' WHEN day >= DATE '{RECENT}' THEN CASE kind {_site} END END AS code FROM flags),
rep AS (SELECT entity, event_id, visit, day >= DATE '{WINDOW}' AS inside FROM flags WHERE kind = 'repeat'),
visits AS (SELECT entity, count(DISTINCT visit) FILTER (inside) AS now_, count(DISTINCT visit) FILTER (NOT inside) AS old_ FROM rep GROUP BY 1),
rcode AS (SELECT entity, true AS inside, CASE WHEN now_ >= 2 THEN 'H_repeat' WHEN now_ = 1 THEN 'R_repeat' END AS code FROM visits
 UNION ALL SELECT entity, false, CASE WHEN old_ >= 2 AND now_ < 2 THEN 'R_old_repeat_pattern' WHEN old_ >= 1 AND now_ = 0 THEN 'R_old_repeat' END FROM visits),
events AS (SELECT entity, event_id, code FROM coded WHERE code IS NOT NULL UNION ALL SELECT entity, event_id, code FROM rep JOIN rcode USING (entity, inside) WHERE code IS NOT NULL),
h AS (SELECT entity, hazard_code, count(*) AS a, count(*) FILTER (inside) AS w, list(event_id ORDER BY event_id) AS e FROM hazards GROUP BY 1, 2),
every AS (SELECT entity, code, count(*) AS n, list(DISTINCT event_id ORDER BY event_id)[1:20] AS e FROM events GROUP BY 1, 2
 UNION ALL SELECT entity, CASE WHEN w > 0 THEN 'R_recurring_' ELSE 'I_past_' END || hazard_code, a, e[1:20] FROM h WHERE hazard_code <> 'other' AND (a >= 3 OR w >= 2)
 UNION ALL SELECT entity, 'H_rate', 1, [] FROM facts WHERE peers >= 30 AND rated_window >= 5 AND serious_window / rated_window >= p90
 UNION ALL SELECT entity, 'R_rate', 1, [] FROM facts WHERE peers >= 30 AND rated_window >= 3 AND serious_window / rated_window >= p75 AND NOT (rated_window >= 5 AND serious_window / rated_window >= p90)
 UNION ALL SELECT entity, 'I_no_inspection', files_without_inspection, [] FROM facts WHERE coalesce(inspections_all, 0) = 0 AND files_without_inspection > 0
 {' '.join(f"UNION ALL SELECT entity, '{code}', {fact}, [] FROM facts WHERE {fact} > 0" for code, fact in _facts.items())}),
ranked AS (SELECT *, CASE WHEN code LIKE 'H!_%' ESCAPE '!' THEN 1 WHEN code LIKE 'R!_%' ESCAPE '!' AND code <> 'R_old_repeat' THEN 2 ELSE 3 END AS s,
 CASE CASE WHEN code LIKE 'R!_recurring!_%' ESCAPE '!' THEN 'R_recurring_' WHEN code LIKE 'I!_past!_%' ESCAPE '!' THEN 'I_past_' ELSE code END {_position} END AS p FROM every),
listed AS (SELECT entity, string_agg(code || ':' || n || ':' || array_to_string(e, '+'), ',' ORDER BY s, p, code) AS reasons, count(*) FILTER (s = 1) AS n_high, count(*) FILTER (s = 2) AS n_review FROM ranked GROUP BY 1),
v AS (SELECT facts.entity, name, coalesce(reasons, '') AS reasons, coalesce(n_high, 0) AS n_high, coalesce(inspections_all, 0) AS inspections_all,
 CASE WHEN n_high > 0 THEN 'high' WHEN n_review > 0 THEN 'review' WHEN coalesce(inspections_all, 0) = 0 THEN 'no_record' WHEN inspections_window = 0 THEN 'no_recent' ELSE 'no_flags' END AS verdict FROM facts LEFT JOIN listed USING (entity))""".replace("STRING", "VARCHAR")


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    return spark.sql(text.replace("FROM orders", "FROM {orders}").replace("FROM customer", "FROM {customer}"), **{t: table(spark, d, t) for t in ("orders", "customer") if f"FROM {t}" in text})


def judged(spark: SparkSession, d: str) -> DataFrame:
    """All entities' facts, reasons and verdicts: one grouping each of flags, hazards and records."""
    day = lambda x: F.lit(x).cast("date")
    flags = _sql(spark, d, _FLAGS).where("kind is not null")
    hazards = _sql(spark, d, _HAZARDS).groupBy("entity", "hazard_code").agg(F.count("*").alias("insp_all"), F.count_if("inside").alias("insp_window"), F.array_sort(F.collect_list("event_id")).alias("evidence"))
    facts = _sql(spark, d, _PEOPLE).join(_sql(spark, d, _COUNTS), "entity", "left").fillna(0, ["inspections_all", "inspections_window"])
    return V.verdict(V.reasons(facts, V.flag_reasons(flags, day(RECENT), day(WINDOW)), V.hazard_reasons(hazards)))


def _listed():
    return F.array_join(F.transform("reasons", lambda r: F.concat_ws(":", r["code"], r["count"].cast("string"), F.array_join(r["evidence"].cast("array<string>"), "+"))), ",")


@query(_SQL + " SELECT entity, verdict, reasons, inspections_all FROM v")
def verdict_reasons(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("entity", "verdict", _listed().alias("reasons"), "inspections_all")


@query(_SQL + """ SELECT entity, name, verdict, inspections_all FROM v
ORDER BY list_position(['high', 'review', 'no_record', 'no_recent', 'no_flags'], verdict), n_high DESC, inspections_all DESC, name LIMIT 50""")
def scorecard_sorted(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).orderBy(*V.scorecard_order()).limit(50).select("entity", "name", "verdict", "inspections_all")


@query(_SQL + " SELECT regexp_extract(x, '^[^:]*') AS code, count(*) AS entities, sum(CAST(split_part(x, ':', 2) AS BIGINT))::BIGINT AS events FROM (SELECT unnest(string_split(reasons, ',')) AS x FROM v WHERE reasons <> '') GROUP BY 1")
def reason_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many entities have each reason, and on how many events."""
    each = judged(spark, d).select(F.explode("reasons").alias("r"))
    return each.groupBy(F.col("r.code").alias("code")).agg(F.count("*").alias("entities"), F.sum("r.count").alias("events"))
