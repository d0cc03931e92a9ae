"""Checks of the warehouse: what its tables hold, counted a second time in another way.

All counts of a table are taken in one pass; rules compare them. An error stops a publication (:func:`siltworks.operators.checks.failed_errors`),
a warning is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltworks import warehouse as W
from siltworks.functions import names as N
from siltworks.functions.text import day_or_null
from siltworks.operators.checks import Rule, counted, judge
from siltworks.operators.rulematch import DEFAULT

c, lit = F.col, F.lit
# The statuses that a death told in a narrative may come to, and those that say that nobody was cited.
DEATH_KNOWN = ("fatality_cited", "fatality_inspected_not_cited", "fatality_pending", "fatcat_no_inspection")
NOT_CITED = ("fatality_inspected_not_cited", "fatcat_not_cited", "fatcat_no_inspection")
#: A case number that the cleaner left before a name: letters, a digit, eight more signs or digits.
CASE_NUMBER = r"\A[A-Z]+[0-9][A-Z0-9]{8,}(?: |\z)"
LEAST_DIGITS = 4


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def scope_again(keys: DataFrame, s) -> DataFrame:
    """Records that belong into scope, found by three semi-joins instead of one ordered choice."""
    inside, entities = keys.where("in_window"), W.coded_entities(keys)
    own = inside.where("is_naics23 or is_sic")
    entity = inside.join(entities, "establishment_key", "left_semi")
    name = inside.where("not is_placeholder").join(W.related_cores(keys, entities, s), "name_core", "left_semi")
    return own.select("activity_nr").union(entity.select("activity_nr")).union(name.select("activity_nr")).distinct()


def checks(raw, keys: DataFrame, people: DataFrame, t: dict[str, DataFrame], s) -> DataFrame:
    """``check_name, severity, found, expected, passed`` of every rule below."""
    insp, viol, flags, est, acc = t["inspection"], t["violation"], t["red_flag"], t["establishment"], t["accident"]
    own = insp.select("activity_nr")
    live = viol.where("not is_deleted")
    newest = insp.agg(F.max("open_date").alias("_newest"))
    late = (c("fatality_status") == "fatality_pending") & (c("open_date") < F.add_months("_newest", -7))
    first = F.split_part("clean_name", lit(" "), lit(1))
    numbered = c("clean_name").rlike(CASE_NUMBER) & (F.length(F.regexp_replace(first, "[^0-9]", "")) >= LEAST_DIGITS)
    cited = live.where("is_serious_plus").select("activity_nr").join(insp.select("activity_nr", "establishment_key", "visit_id"), "activity_nr").select("establishment_key", "visit_id").distinct()
    told = acc.where("death_in_narrative").select("summary_nr").join(t["accident_inspection"], "summary_nr").join(insp.select("activity_nr", "fatality_status"), "activity_nr")
    again = raw.violation.select(c("activity_nr").try_cast("bigint").alias("activity_nr"), "citation_id").join(own, "activity_nr", "left_semi").distinct()
    counts = [
        counted(
            insp.join(F.broadcast(newest)),  # one row
            insp_n=F.count("*"), insp_keys=F.countDistinct("activity_nr"), insp_dated=F.count("open_date"), insp_coded=_n(c("scope_reason").isin("naics23", "sic15_17")), insp_rated=_n(W.rated() & c("open_date").isNotNull()), pending_late=_n(late), insp_day=F.max(F.unix_date("open_date")),
        ),
        counted(viol, viol_n=F.count("*"), viol_keys=F.countDistinct(F.struct("activity_nr", "citation_id")), live_n=_n(~c("is_deleted")), live_other=_n(~c("is_deleted") & (c("hazard_code") == DEFAULT)), live_severe=_n(~c("is_deleted") & c("viol_type").isin("W", "R")), live_fta=_n(~c("is_deleted") & c("is_fta"))),
        counted(t["establishment_year"], year_insp=F.sum("insp_n"), year_viol=F.sum("viol_n"), year_rated=F.sum("insp_rated_n")),
        counted(t["establishment_hazard_year"], hazard_viol=F.sum("viol_n")),
        counted(flags, flag_n=F.count("*"), flag_keys=F.countDistinct("flag_id"), flag_citations=_n(c("kind").isin("willful", "repeat", "fta"))),
        counted(est, id_prefixed=_n(numbered)),
        counted(acc, told_only=_n(F.array_contains("dq_flags", "death_only_in_narrative")), accident_day=F.max(F.unix_date("event_date"))),
        counted(keys, key_coded=_n(c("in_window") & (c("is_naics23") | c("is_sic"))), short_sic=_n(c("in_window") & c("is_sic") & ~c("is_naics23") & (F.length(F.trim("sic_code")) < 4))),
        counted(t["establishment_member"], member_n=F.count("*")),
        counted(live.join(insp.where("open_date is not null").select("activity_nr"), "activity_nr", "left_semi"), live_dated=F.count("*")),
        counted(viol.join(own, "activity_nr", "left_anti"), viol_lost=F.count("*")),
        counted(insp.join(est, "establishment_key", "left_anti"), insp_lost=F.count("*")),
        counted(flags.join(own, "activity_nr", "left_anti"), flag_lost=F.count("*")),
        counted(insp.where("insp_type = 'M' and accident_n = 0").join(flags, "activity_nr", "left_anti"), unflagged=F.count("*")),
        counted(t["core_stats"], person_distinctive=_n((c("tier") == "distinctive") & N.is_person(c("name_core"), s.given_names, s.surnames))),
        counted(people, mixed=_n(c("person_conflict"))),
        counted(scope_again(keys, s), scope_n=F.count("*")),
        counted(again, raw_citations=F.count("*")),
        counted(told, untold=_n(~c("fatality_status").isin(*DEATH_KNOWN))),
        counted(insp.where(c("fatality_status").isin(*NOT_CITED)).join(cited, ["establishment_key", "visit_id"], "left_semi"), uncited=F.count("*")),
        counted(raw.inspection, future=_n(day_or_null(c("open_date")) > F.current_date())),
        counted(t["quarantine"], quarantined=_n(c("source_table") == "violation")),
    ]
    return judge(counts, [
        Rule("inspection_key_unique", "insp_n", "insp_keys"), Rule("violation_key_unique", "viol_n", "viol_keys"), Rule("flag_id_unique", "flag_n", "flag_keys"), Rule("members_cover_inspections", "member_n", "insp_n"),
        Rule("year_mart_inspections", "year_insp", "insp_dated"), Rule("year_mart_citations", "year_viol", "live_dated"), Rule("hazards_add_up", "hazard_viol", "year_viol"), Rule("only_inspected_are_rated", "year_rated", "insp_rated"),
        Rule("violations_have_inspections", "viol_lost"), Rule("inspections_have_establishments", "insp_lost"), Rule("flags_have_inspections", "flag_lost"), Rule("fatcat_without_detail_is_flagged", "unflagged"), Rule("flags_from_citations", "flag_citations", "live_severe + live_fta"),
        Rule("coded_inspections_in_scope", "insp_coded", "key_coded"), Rule("short_sic_not_in_scope", "short_sic"), Rule("scope_counted_again", "insp_n", "scope_n"), Rule("citations_counted_again", "viol_n", "raw_citations"),
        Rule("persons_not_distinctive", "person_distinctive"), Rule("injuries_of_one_person", "mixed"), Rule("no_case_number_in_names", "id_prefixed"),
        Rule("pending_within_deadline", "pending_late"), Rule("told_deaths_have_status", "untold"), Rule("not_cited_nowhere_on_visit", "uncited"), Rule("no_future_inspection", "future"),
        Rule("deaths_only_told", "told_only", str(s.narrative_deaths), "warn", s.narrative_deaths), Rule("accident_detail_days_behind", "insp_day - accident_day", "548", "warn", at_most=True),
        Rule("hazard_other_percent", "100 * live_other / greatest(live_n, 1)", "5", "warn", at_most=True), Rule("quarantined_citations", "quarantined", str(s.orphan_citations), "warn", 50),
    ])
