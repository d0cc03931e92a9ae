"""Explainable verdicts, one set-based pass for all entities.

Every reason is a row with its code, severity, count and the events behind it. Red flags and hazards bring their
reasons by grouping; the other facts are one row an entity. ``REASONS`` says in which order reasons are shown;
the worst severity among them, then how much record there is, gives the verdict.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .rows import top_k


@dataclass(frozen=True)
class Thresholds:
    recent_years: int = 10
    repeat_visits: int = 2
    rate_high_visits: int = 5
    rate_review_visits: int = 3
    least_peers: int = 30
    recurring_all: int = 3
    recurring_window: int = 2
    evidence: int = 20


# Kinds of red flags. Serious ones count for ever, but only recent ones as high.
SERIOUS_KINDS = ("fatality_cited", "fatcat_cited", "willful", "fta")
PENDING_KIND, REPEAT_KIND = "fatality_pending", "repeat"
#: what happened at a site without being the entity's own offence, and its code; counts while recent
SITE_KINDS = {
    "fatality_inspected_not_cited": "R_fatality_site",
    "fatcat_not_cited": "R_fatcat_site",
    "fatcat_site_cited": "R_fatcat_site_cited",
    "catastrophe_cited": "R_catastrophe_cited",
    "fatcat_no_inspection": "R_fatcat_no_inspection",
}
#: the most serious first; one of these stands for a visit
EVENT_ORDER = ("fatality_cited", "fatcat_cited", "catastrophe_cited", "fatality_pending", "fatcat_site_cited", "fatality_inspected_not_cited", "fatcat_not_cited", "fatcat_no_inspection")
#: reasons in the order in which they are found; those per hazard stand where their prefix does
REASONS = (
    *(f"H_{k}" for k in SERIOUS_KINDS), "H_repeat", "H_rate", *(f"R_old_{k}" for k in SERIOUS_KINDS), "R_fatality_pending", *SITE_KINDS.values(),
    "R_repeat", "R_old_repeat_pattern", "R_old_repeat", "R_rate", "R_recurring_", "I_past_", "R_open", "R_questions", "R_unresolved", "I_ai_unchecked", "R_stale",
    "I_profile_questions", "I_questions", "R_ita", "R_licence", "R_ita_deaths", "I_no_inspection",
)
SEVERITIES = ("high", "review", "info")
INFO = ("R_old_repeat",)

#: numbers about an entity that :func:`reasons` reads; a missing column or null counts as 0, or as unknown for the rates
FACTS = (
    "inspections_all", "inspections_window", "rated_window", "serious_window", "p75", "p90", "peers", "open_cases", "pending_questions", "unresolved_flags", "ai_unchecked",
    "stale_records", "profile_questions", "other_questions", "dart_years_above", "licence_lapsed", "deaths_reported", "files_without_inspection",
)


def severity(code: Column) -> Column:
    return F.when(code.isin(*INFO), "info").when(code.startswith("H_"), "high").when(code.startswith("R_"), "review").otherwise("info")


def _reason_rows(df: DataFrame, code: Column, count: Column, evidence: Column) -> DataFrame:
    return df.select("entity", code.alias("code"), count.cast("long").alias("count"), evidence.alias("evidence"))


def flag_reasons(flags: DataFrame, recent_since: Column, window_since: Column, t: Thresholds = Thresholds()) -> DataFrame:
    """``entity, code, count, evidence`` from ``flags(entity, kind, day, visit, event_id)``.

    A flag without a day is older than any limit; one without a visit is a visit of its own.
    """
    recent, inside = (F.coalesce(F.col("day") >= since, F.lit(False)) for since in (recent_since, window_since))
    site = reduce(lambda out, kind: F.when(F.col("kind") == kind, SITE_KINDS[kind]).otherwise(out), SITE_KINDS, F.lit(None).cast("string"))
    serious = F.col("kind").isin(*SERIOUS_KINDS)
    code = F.when(serious & recent, F.concat(F.lit("H_"), "kind")).when(serious, F.concat(F.lit("R_old_"), "kind")).when(F.col("kind") == PENDING_KIND, "R_fatality_pending").when(recent, site)
    named = flags.withColumn("code", code).where("code is not null")

    # repeats count by visits: one visit may have several inspections
    repeats = flags.where(F.col("kind") == REPEAT_KIND).withColumn("inside", inside).withColumn("visit", F.coalesce("visit", F.col("event_id").cast("string")))
    visits = lambda c: F.countDistinct(F.when(c, F.col("visit")))
    by = repeats.groupBy("entity").agg(visits(F.col("inside")).alias("now"), visits(~F.col("inside")).alias("old"))
    now_code = F.when(F.col("now") >= t.repeat_visits, "H_repeat").when(F.col("now") == 1, "R_repeat")
    old_code = F.when((F.col("old") >= t.repeat_visits) & (F.col("now") < t.repeat_visits), "R_old_repeat_pattern").when((F.col("old") > 0) & (F.col("now") == 0), "R_old_repeat")
    codes = by.select("entity", F.explode(F.array(F.struct(F.lit(True).alias("inside"), now_code.alias("code")), F.struct(F.lit(False).alias("inside"), old_code.alias("code")))).alias("r")).select("entity", "r.*").where("code is not null")
    named = named.select("entity", "code", "event_id").unionByName(repeats.join(codes, ["entity", "inside"]).select("entity", "code", "event_id"))

    counts = named.groupBy("entity", "code").agg(F.count("*").alias("count"))
    shown = top_k(named.distinct(), ["entity", "code"], [F.col("event_id")], t.evidence).groupBy("entity", "code").agg(F.array_sort(F.collect_list("event_id")).alias("evidence"))
    return _reason_rows(counts.join(shown, ["entity", "code"]), F.col("code"), F.col("count"), F.col("evidence"))


def hazard_reasons(hazards: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``entity, code, count, evidence`` from ``hazards(entity, hazard_code, insp_all, insp_window, evidence)``."""
    often = (F.col("insp_all") >= t.recurring_all) | (F.col("insp_window") >= t.recurring_window)
    rows = hazards.where((F.col("hazard_code") != "other") & often)
    code = F.concat(F.when(F.col("insp_window") >= 1, "R_recurring_").otherwise("I_past_"), "hazard_code")
    return _reason_rows(rows, code, F.col("insp_all"), F.slice("evidence", 1, t.evidence))


def fact_reasons(facts: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``entity, code, count, evidence`` from one row of ``FACTS`` an entity."""
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in facts.columns else F.lit(0.0)
    limit = lambda c: F.col(c).cast("double") if c in facts.columns else F.lit(None).cast("double")
    rate = F.when(n("rated_window") > 0, n("serious_window") / n("rated_window"))
    rated = n("peers") >= t.least_peers
    high = F.coalesce(rated & (n("rated_window") >= t.rate_high_visits) & (rate >= limit("p90")), F.lit(False))
    review = F.coalesce(rated & (n("rated_window") >= t.rate_review_visits) & (rate >= limit("p75")), F.lit(False)) & ~high
    nothing = (n("inspections_all") == 0) & (n("files_without_inspection") > 0)
    one = F.lit(1)
    rules: list[tuple[str, Column, Column]] = [("H_rate", high, one), ("R_rate", review, one), ("I_no_inspection", nothing, n("files_without_inspection"))]
    for code, fact in (
        ("R_open", "open_cases"), ("R_questions", "pending_questions"), ("R_unresolved", "unresolved_flags"), ("I_ai_unchecked", "ai_unchecked"), ("R_stale", "stale_records"),
        ("I_profile_questions", "profile_questions"), ("I_questions", "other_questions"), ("R_ita", "dart_years_above"), ("R_licence", "licence_lapsed"), ("R_ita_deaths", "deaths_reported"),
    ):
        rules.append((code, n(fact) > 0, n(fact)))
    found = F.array(*(F.when(holds, F.struct(F.lit(code).alias("code"), count.cast("long").alias("count"))) for code, holds, count in rules))
    rows = facts.select("entity", F.explode(F.array_compact(found)).alias("r"))
    return _reason_rows(rows, F.col("r.code"), F.col("r.count"), F.array().cast("array<long>"))


def _position(code: Column) -> Column:
    """A reason's place; reasons per hazard share that of their prefix."""
    prefix = F.when(code.startswith("R_recurring_"), "R_recurring_").when(code.startswith("I_past_"), "I_past_").otherwise(code)
    return F.array_position(F.array(*map(F.lit, REASONS)), prefix)


def reasons(facts: DataFrame, *rows: DataFrame) -> DataFrame:
    """``facts`` with ``reasons``, an array of (severity, code, count, evidence): high ones first, then in order.

    ``rows`` are tables of :func:`flag_reasons` and :func:`hazard_reasons`; those of the facts themselves are added.
    """
    every = reduce(DataFrame.unionByName, [fact_reasons(facts), *rows])
    said = severity(F.col("code"))
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), said)
    listed = every.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), _position(F.col("code")).alias("p"), "code", said.alias("severity"), "count", "evidence"))).alias("r"))
    shown = listed.select("entity", F.transform("r", lambda r: F.struct(r["severity"].alias("severity"), r["code"].alias("code"), r["count"].alias("count"), r["evidence"].alias("evidence"))).alias("reasons"))
    empty = F.array().cast("array<struct<severity:string,code:string,count:bigint,evidence:array<bigint>>>")
    return facts.join(shown, "entity", "left").withColumn("reasons", F.coalesce("reasons", empty))


def verdict(df: DataFrame) -> DataFrame:
    """``df`` with ``verdict``: high, review, no_record, no_recent or no_flags, the first that holds."""
    has = lambda s: F.exists("reasons", lambda r: r["severity"] == s)
    all_, window = (F.coalesce(F.col(c), F.lit(0)) for c in ("inspections_all", "inspections_window"))
    return df.withColumn("verdict", F.when(has("high"), "high").when(has("review"), "review").when(all_ == 0, "no_record").when(window == 0, "no_recent").otherwise("no_flags"))


def one_event_per_visit(events: DataFrame, order: tuple[str, ...] = EVENT_ORDER) -> DataFrame:
    """``events(entity, visit, kind, event_id)`` with one event of the kinds in ``order`` a visit, the most serious; others all stay."""
    known = F.col("kind").isin(*order)
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    best = top_k(events.where(known).withColumn("_rank", rank), ["entity", "visit"], [F.col("_rank"), F.col("event_id")]).drop("_rank")
    return best.unionByName(events.where(~known))


VERDICT_ORDER = ("high", "review", "no_record", "no_recent", "no_flags")


def scorecard_order() -> list[Column]:
    """Worst first: verdict, number of high reasons, inspections, name."""
    high = F.size(F.filter("reasons", lambda r: r["severity"] == "high"))
    return [F.array_position(F.array(*map(F.lit, VERDICT_ORDER)), F.col("verdict")).asc(), high.desc(), F.col("inspections_all").desc_nulls_last(), F.col("name").asc_nulls_last()]
