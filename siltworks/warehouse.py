"""The warehouse of workplace inspections: raw text tables to facts, entities and marts.

:func:`build` takes the raw tables, all columns as text, and returns the served tables by name. It plans
everything as joins and groupings over whole tables; ``keep`` is called where a table is read several
times; a build should write it there and read it back, which also keeps plans small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from siltworks import outside as O
from siltworks.functions import addresses as A, codes, names as N, narrative
from siltworks.functions.text import day_or_null, null_if_empty, number_or_null, text
from siltworks.operators import levels as L, rows as R, rulematch
from siltworks.resolve import index as I

__all__ = ["Build", "Raw", "Settings", "build"]


@dataclass(frozen=True)
class Settings:
    history_years: int = 10
    distinctive_most: int = 5
    related_least_share: float = 0.5
    least_rated: int = 3
    windows: tuple[int, ...] = (3, 5, 10)
    given_names: tuple[str, ...] = ()
    surnames: tuple[str, ...] = ()
    # what is known of the source: citations without a record, deaths that only a narrative tells
    orphan_citations: int = 374
    narrative_deaths: int = 10


@dataclass(frozen=True)
class Raw:
    inspection: DataFrame
    violation: DataFrame
    accident: DataFrame
    injury: DataFrame
    abstract: DataFrame
    lookup: DataFrame
    rules: DataFrame
    trades: DataFrame | None = None
    filings: DataFrame | None = None
    licences: dict[str, DataFrame] = field(default_factory=dict)


c, lit = F.col, F.lit
SERIOUS = ("S", "W", "R", "U")
UNRATED_TYPES = ("F", "D", "E")
# Codes of the source.
DEGREES = {1: "fatality", 2: "hospitalized", 3: "not hospitalized"}
FLAGGED = ("fatality_cited", "fatality_inspected_not_cited", "fatality_pending", "fatcat_cited", "fatcat_not_cited", "fatcat_site_cited", "catastrophe_cited", "fatcat_no_inspection")


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _or(column: str, default) -> Column:
    return F.coalesce(c(column), lit(default))


def keyed(raw: DataFrame, since: DataFrame) -> DataFrame:
    """Cleaned name and address, entity key and industry of every record, whatever its year.

    Names and streets are cleaned once per distinct value.
    """
    names = raw.select("estab_name").distinct().withColumn("clean_name", N.clean_name("estab_name")).withColumns({"name_core": N.name_core(c("clean_name")), "is_placeholder": N.is_placeholder(c("clean_name"))})
    streets = raw.select("mail_street").distinct().select("mail_street", A.address_key("mail_street").alias("addr_key"), A.clean_address("mail_street").alias("addr_clean"))
    known = raw.alias("i").join(names.alias("n"), c("i.estab_name").eqNullSafe(c("n.estab_name")), "left").join(streets.alias("a"), c("i.mail_street").eqNullSafe(c("a.mail_street")), "left")
    out = known.select("i.*", "clean_name", "name_core", "is_placeholder", "addr_key", "addr_clean").withColumns({"mail_zip5": A.zip5("mail_zip"), "state": null_if_empty(F.upper(F.trim("mail_state"))), "opened": day_or_null(c("open_date"))})
    return out.join(F.broadcast(since)).withColumns(  # one row
        {
            "establishment_key": A.entity_key(c("clean_name"), c("addr_key"), c("mail_zip5"), c("state")),
            "is_naics23": F.coalesce(c("naics_code").startswith("23"), lit(False)),
            "is_sic": F.coalesce(F.left(F.lpad(F.trim("sic_code"), 4, "0"), lit(2)).isin("15", "16", "17"), lit(False)),
            "in_window": F.coalesce(c("opened") >= c("since"), lit(False)),
        }
    )


def coded_entities(keys: DataFrame) -> DataFrame:
    """Entities with a record of construction, in any year."""
    coded = (c("is_naics23") | c("is_sic")) & ~c("is_placeholder")
    return keys.where(coded).groupBy("establishment_key").agg(F.bool_or("in_window").alias("coded_in_window"))


def related_cores(keys: DataFrame, entities: DataFrame, s: Settings) -> DataFrame:
    """Distinctive cores of company names most of whose records are of construction."""
    named = keys.where(~c("is_placeholder") & (c("name_core") != ""))
    variety = named.groupBy("name_core").agg(F.countDistinct("clean_name").alias("variety"), (_n(c("is_naics23") | c("is_sic")) / F.count("*")).alias("share"))
    cores = named.join(entities, "establishment_key", "left_semi").select("name_core").distinct().join(variety, "name_core")
    long = F.when(F.contains("name_core", lit(" ")), F.length("name_core") >= 5).otherwise(F.length("name_core") >= 6)
    return cores.where((c("variety") <= s.distinctive_most) & (c("share") >= s.related_least_share) & long & ~N.is_person(c("name_core"), s.given_names, s.surnames)).select("name_core")


def scoped(keys: DataFrame, s: Settings) -> DataFrame:
    """Records in the window that are coded as construction, or whose entity or company is so elsewhere."""
    entities = coded_entities(keys)
    related = related_cores(keys, entities, s).withColumn("related", lit(True))
    df = keys.where("in_window").join(entities, "establishment_key", "left").join(related, "name_core", "left")
    reason = F.when(c("is_naics23"), "naics23").when(c("is_sic"), "sic15_17").when(c("coded_in_window"), "same_establishment").when(c("coded_in_window").isNotNull(), "construction_history").when(~c("is_placeholder") & c("related"), "related_name")
    return df.withColumn("scope_reason", reason).where("scope_reason is not null")


def staged_inspections(scope: DataFrame) -> DataFrame:
    scope = O.once_per_value(scope, "site_address", site_key=A.address_key("site_address"))
    closed, site = day_or_null(c("close_case_date")), c("site_key")
    group = F.when(site.isNotNull() & A.zip5("site_zip").isNotNull(), F.md5(F.concat_ws("|", site, A.zip5("site_zip"), F.left("open_date", lit(10)))))
    employees = c("nr_in_estab").try_cast("int")
    flags = R.flags(
        closed_before_opened=closed < c("opened"), employees_implausible=employees >= 10_000, id_prefix_stripped=F.upper("estab_name").rlike(r"^(?:[A-Z]{0,3}[0-9]{3,}|[A-Z]+[0-9][A-Z0-9]{8,})\s*-\s*"),
        name_encoding_damage=F.contains("estab_name", lit("�")), placeholder_name=c("is_placeholder"), opened_before_osha_existed=c("opened") < lit("1971-04-28").cast("date"), no_inspection_conducted=c("insp_scope") == "D",
    )
    return scope.select(
        c("activity_nr").try_cast("bigint").alias("activity_nr"), "establishment_key", "scope_reason", c("estab_name").alias("estab_name_raw"), "clean_name", "name_core", "site_address", "site_city",
        null_if_empty(F.upper(F.trim("site_state"))).alias("site_state"), A.zip5("site_zip").alias("site_zip"), "mail_street", "mail_city", c("state").alias("mail_state"), c("mail_zip5").alias("mail_zip"), "addr_key", "addr_clean",
        F.when(F.substring("reporting_id", 3, 1) == "5", "state_plan").otherwise("federal").alias("jurisdiction"), "owner_type", "insp_type", "insp_scope", F.coalesce(c("insp_scope") == "D", lit(False)).alias("no_inspection"),
        F.when(~c("naics_code").isin("000000", "0"), c("naics_code")).alias("naics_code"), F.nullif(F.lpad(null_if_empty(F.trim("sic_code")), 4, "0"), lit("0000")).alias("sic_code"), employees.alias("nr_in_estab"),
        c("opened").alias("open_date"), closed.alias("close_date"), (text("close_case_date") == "").alias("is_open"), group.alias("site_group_id"), flags.alias("dq_flags"),
    )


def staged_violations(raw: DataFrame, inspections: DataFrame) -> DataFrame:
    own = inspections.select("activity_nr", "site_state", "open_date")
    v = raw.withColumn("activity_nr", c("activity_nr").try_cast("bigint")).join(own, "activity_nr")
    before, now, issued, kind = c("initial_penalty").try_cast("decimal(14,2)"), c("current_penalty").try_cast("decimal(14,2)"), day_or_null(c("issuance_date")), null_if_empty(F.trim("viol_type"))
    flags = R.flags(issued_before_open=issued < c("open_date"), penalty_increased=now > before, penalty_not_recorded=text("initial_penalty") == "", viol_type_undocumented=kind.isNull() | (c("viol_type") == "P"), standard_encoding_damage=F.contains("standard", lit("�")))
    return v.select(
        "activity_nr", "citation_id", (text("delete_flag") == "X").alias("is_deleted"), c("standard").alias("standard_raw"), "site_state", kind.alias("viol_type"), issued.alias("issued_on"), day_or_null(c("contest_date")).alias("contest_on"),
        day_or_null(c("final_order_date")).alias("final_order_on"), before.alias("penalty_initial"), now.alias("penalty_current"), ((text("fta_insp_nr") != "") | (text("fta_issuance_date") != "")).alias("is_fta"),
        number_or_null(c("nr_instances")).alias("nr_instances"), number_or_null(c("nr_exposed")).alias("nr_exposed"), "gravity", flags.alias("dq_flags"),
    )


def violations(staged: DataFrame, rules: DataFrame, as_of: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: df) -> DataFrame:
    """Codes parsed and matched once per distinct (code, state), then joined back.

    Parsed codes are kept: Spark would push what rules ask of them below the ``distinct``, and parse every citation's code for each kind of rule.
    So are matched ones: of a written table Spark knows the size, and needn't shuffle all citations to meet a few codes.
    """
    distinct = keep("code", staged.select("standard_raw", "site_state").distinct().withColumn("p", codes.parse("standard_raw", "site_state")).select("standard_raw", "site_state", "p.*"))
    matched = keep("code_hazard", rulematch.match_rules(distinct.withColumnRenamed("std_family", "family"), rules).withColumnRenamed("family", "std_family"))
    v = staged.alias("v").join(matched.alias("h"), c("v.standard_raw").eqNullSafe(c("h.standard_raw")) & c("v.site_state").eqNullSafe(c("h.site_state")), "left")
    v = v.select("v.*", "std_family", "section_key", "standard_cite", F.coalesce("hazard_code", lit(rulematch.DEFAULT)).alias("hazard_code")).join(F.broadcast(as_of))  # one row
    return v.withColumns({"contested": c("contest_on").isNotNull(), "is_final": F.coalesce(c("final_order_on") <= c("as_of"), lit(False)), "is_serious_plus": F.coalesce(c("viol_type").isin(*SERIOUS), lit(False))}).drop("as_of", "site_state")


def injuries(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed injury rows, and one row a person: copies of a line are one person until sex or age jumps."""
    late = F.left("load_dt", lit(4)) >= "2026"
    age = number_or_null(c("age"))
    shifted = c("const_op").isNull() & (late | (c("nature_of_inj").isNull() & c("part_of_body").isNull()))
    rows = raw.select(
        c("summary_nr").try_cast("bigint").alias("summary_nr"), c("rel_insp_nr").try_cast("bigint").alias("activity_nr"), c("injury_line_nr").try_cast("int").alias("line_nr"), F.when(~age.isin(0, 1, 99), age).alias("age"), null_if_empty(F.trim("sex")).alias("sex"),
        number_or_null(c("nature_of_inj")).alias("nature_code"), number_or_null(c("part_of_body")).alias("body_code"), number_or_null(c("degree_of_inj")).alias("degree_code"), number_or_null(c("fat_cause")).alias("fat_cause_code"),
        F.when(F.coalesce(shifted, lit(False)), number_or_null(c("const_op_cause"))).otherwise(number_or_null(c("const_op"))).alias("const_op_code"), c("fall_distance").try_cast("double").alias("fall_distance_ft"),
    )
    seen = rows.where("age is not null and sex is not null").select("summary_nr", "line_nr", "age", "sex").distinct()
    keys, order = ["summary_nr", "line_nr"], [c("sex"), c("age")]
    w = R.ordered(keys, order)
    seen = seen.withColumns({"before_sex": F.lag("sex").over(w), "before_age": F.lag("age").over(w)})
    starts = c("before_sex").isNull() | (c("before_sex") != c("sex")) | (c("age") - c("before_age") > 2)
    person = R.runs(seen, keys, order, starts, "person_n").select(*keys, "age", "sex", "person_n")
    known = rows.join(person, [*keys, "age", "sex"], "left").withColumn("person_n", _or("person_n", 1))
    least = lambda x: F.min(F.when(c(x) > 0, c(x))).alias(x)
    two = (F.min("sex") != F.max("sex")) | (F.max("age") - F.min("age") > 2)
    people = known.groupBy(*keys, "person_n").agg(
        F.max("age").alias("age"), F.min("sex").alias("sex"), *(least(x) for x in ("degree_code", "nature_code", "body_code", "fat_cause_code", "const_op_code")), F.max("fall_distance_ft").alias("fall_distance_ft"), two.alias("person_conflict")
    )
    return rows, people


def narratives(raw: DataFrame) -> DataFrame:
    """Lines in order; one that follows a full line without a blank at the seam goes on in its word."""
    line = F.struct(c("line_nr").try_cast("int").alias("n"), c("abstract_text").alias("t"))
    lines = raw.groupBy(c("summary_nr").try_cast("bigint").alias("summary_nr")).agg(F.array_sort(F.collect_list(line)).alias("l"))

    def add(a: Column, x: Column) -> Column:
        t, last = F.coalesce(x["t"], lit("")), a["last"]
        wrapped = (F.length(last) >= 80) & (F.right(last, lit(1)) != " ") & (F.left(t, lit(1)) != " ")
        return F.struct(F.when(last.isNull(), F.trim(t)).when(wrapped, F.concat(a["all"], F.rtrim(t))).otherwise(F.concat(a["all"], lit(" "), F.trim(t))).alias("all"), t.alias("last"))

    joined = F.aggregate("l", F.struct(lit("").alias("all"), lit(None).cast("string").alias("last")), add, lambda a: a["all"])
    return lines.select("summary_nr", F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("narrative"))


def accidents(raw: Raw, rows: DataFrame, people: DataFrame, inspections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accidents of inspections in scope, also those whose own record is missing, and the links."""
    links = rows.select("summary_nr", "activity_nr").distinct().join(inspections.select("activity_nr"), "activity_nr", "left_semi")
    injured = people.groupBy("summary_nr").agg(F.count("*").alias("injured_n"), _n(c("degree_code") == 1).alias("fatal_n"))
    employers = rows.groupBy("summary_nr").agg(F.countDistinct("activity_nr").alias("employers_on_site"))
    own = raw.accident.select(c("summary_nr").try_cast("bigint").alias("summary_nr"), day_or_null(c("event_date")).alias("event_date"), c("event_desc").alias("description"), "project_type", "const_end_use", (text("fatality") == "X").alias("fatality_flag"), lit(False).alias("found"))
    label = lambda family: raw.lookup.where(c("accident_code") == family).select(c("accident_letter").alias("letter"), c("accident_value").alias("label"))
    df = links.select("summary_nr").distinct().join(own, "summary_nr", "left").join(narratives(raw.abstract), "summary_nr", "left").join(injured, "summary_nr", "left").join(employers, "summary_nr", "left")
    for column, family in (("project_type", "PTYP"), ("const_end_use", "ENDU")):
        known = label(family)
        df = df.join(known, c(column) == c("letter"), "left").withColumn(column, c("label")).drop("letter", "label")
    missing, dead = c("found").isNull(), narrative.reports_death("narrative")
    df = df.withColumns({"fatality_flag": _or("fatality_flag", False), "injured_n": _or("injured_n", 0), "fatal_n": _or("fatal_n", 0), "employers_on_site": _or("employers_on_site", 1), "record_missing": missing, "death_in_narrative": dead})
    flags = R.flags(accident_record_missing=c("record_missing"), no_narrative=c("narrative").isNull(), death_only_in_narrative=c("death_in_narrative") & ~c("fatality_flag") & (c("fatal_n") == 0))
    return df.drop("found").withColumn("dq_flags", flags), links


def final_inspections(staged: DataFrame, viol: DataFrame, acc: DataFrame, links: DataFrame, as_of: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: df) -> DataFrame:
    """Records with their citations, accidents, visit and an ordered status of fatalities.

    What is counted for a record is kept: records, visits and sites read it, and citations are grouped once.
    """
    live = ~c("is_deleted")
    cited = viol.groupBy("activity_nr").agg(_n(live).alias("citation_n"), _n(live & c("is_serious_plus")).alias("serious_plus_n"), _n(live & ~c("is_final")).alias("not_final_n"), F.sum(F.when(live, c("penalty_initial"))).alias("penalty_initial"), F.sum(F.when(live, c("penalty_current"))).alias("penalty_current"))
    fatal = c("fatality_flag") | (c("fatal_n") > 0) | c("death_in_narrative")
    hit = links.join(acc.select("summary_nr", "fatality_flag", "fatal_n", "death_in_narrative"), "summary_nr").groupBy("activity_nr").agg(F.count("*").alias("accident_n"), F.bool_or(fatal).alias("fatal"))
    groups = staged.where("site_group_id is not null").groupBy("site_group_id").agg(F.countDistinct("establishment_key").alias("site_group_n"))
    counted = keep("record_counts", cited.join(hit, "activity_nr", "full"))
    df = staged.join(counted, "activity_nr", "left").join(groups, "site_group_id", "left").join(F.broadcast(as_of))  # one row
    df = df.withColumns({"visit_id": F.coalesce("site_group_id", c("activity_nr").cast("string")), "citation_n": _or("citation_n", 0), "serious_plus_n": _or("serious_plus_n", 0), "site_group_n": _or("site_group_n", 1), "has_accident": c("accident_n").isNotNull(), "accident_n": _or("accident_n", 0), "fatal": _or("fatal", False)})
    visits = df.groupBy("establishment_key", "visit_id").agg(F.sum("serious_plus_n").alias("visit_serious"), F.bool_or(F.coalesce(c("insp_type") == "M", lit(False))).alias("visit_m"))
    sites = df.where("insp_type = 'M' and not has_accident and site_group_id is not null").select("site_group_id").distinct().withColumn("site_m", lit(True))
    df = df.join(visits, ["establishment_key", "visit_id"]).join(sites, "site_group_id", "left")
    open_late = c("is_open") & (c("open_date") >= F.add_months("as_of", -7))
    m, none, serious, f = F.coalesce(c("insp_type") == "M", lit(False)), ~c("has_accident"), c("visit_serious") > 0, c("fatal")
    status = (
        F.when(f & serious, "fatality_cited").when((f | m) & c("no_inspection") & ~serious, "fatcat_no_inspection").when(f & (c("citation_n") == 0) & open_late, "fatality_pending").when(f, "fatality_inspected_not_cited")
        .when(m & none & serious, "fatcat_cited").when(m & ~none & serious, "catastrophe_cited").when(m & none & open_late, "fatality_pending").when(m & none, "fatcat_not_cited")
        .when(~m & none & (c("serious_plus_n") > 0) & c("site_m") & ~c("visit_m"), "fatcat_site_cited").when((c("insp_type") == "A") & none, "accident_outcome_unknown").otherwise("none")
    )
    provisional = c("is_open") & ((F.coalesce("not_final_n", lit(0)) > 0) | ((c("citation_n") == 0) & F.coalesce(c("open_date") >= F.add_months("as_of", -7), lit(False))))
    return df.withColumns({"fatality_status": status, "is_provisional": provisional}).drop("not_final_n", "fatal", "has_accident", "visit_serious", "visit_m", "site_m", "as_of")


def establishments(inspections: DataFrame) -> DataFrame:
    """One row an entity; every chosen value is the most frequent, ties to the smallest."""
    i = inspections.withColumns({"display_name": c("estab_name_raw"), "address": c("addr_clean"), "city": c("mail_city"), "primary_naics4": F.left("naics_code", lit(4)), "primary_sic4": c("sic_code")})
    first = lambda x, name: F.min(x).alias(name)  # noqa: E731  a key has one value of each
    base = i.groupBy("establishment_key").agg(
        first("clean_name", "clean_name"), first("name_core", "name_core"), first("addr_key", "addr_key"), first("mail_zip", "zip5"), first("mail_state", "state"), R.variants("estab_name_raw").alias("name_variants"), F.min("open_date").alias("first_seen"), F.max("open_date").alias("last_seen"),
        F.count("*").alias("insp_n"), _n(~c("no_inspection")).alias("insp_conducted_n"), _n(c("scope_reason").isin("naics23", "sic15_17")).alias("construction_insp_n"), F.bool_and(c("scope_reason") == "related_name").alias("related_only"), R.variants("site_state", 60).alias("site_states"),
    )
    chosen = R.modes(i, ["establishment_key"], ["display_name", "address", "city", "primary_naics4", "primary_sic4"])
    n = c("clean_name")
    return base.join(chosen, "establishment_key").withColumns({"legal_name": N.legal_part(n), "dba_name": N.trade_part(n), "is_placeholder": N.is_placeholder(n), "is_jv": N.is_joint_venture(n), "sibling_suffix": N.place_suffix(n)})


def aliases(est: DataFrame) -> DataFrame:
    kind = lambda col, k: est.select("establishment_key", c(col).alias("alias"), lit(k).alias("kind"), "dba_name")
    both = kind("legal_name", "legal").unionByName(kind("dba_name", "dba")).where("dba_name is not null")
    return kind("clean_name", "clean").unionByName(both).drop("dba_name")


def rated() -> Column:
    return ~F.coalesce(c("insp_type"), lit("")).isin(*UNRATED_TYPES) & ~c("no_inspection")


def establishment_year(insp: DataFrame, viol: DataFrame) -> DataFrame:
    dated = insp.where("open_date is not null").withColumn("year", F.year("open_date"))
    kind = lambda *t: _n(c("insp_type").isin(*t))
    own = dated.groupBy("establishment_key", "year").agg(
        F.count("*").alias("insp_n"), _n(rated()).alias("insp_rated_n"), _n(~c("no_inspection")).alias("insp_conducted_n"), _n(c("citation_n") > 0).alias("insp_with_cit_n"), kind("H", "I", "K").alias("insp_programmed_n"), kind("B").alias("insp_complaint_n"), kind("C").alias("insp_referral_n"),
        kind("A", "M").alias("insp_accident_n"), kind("F").alias("insp_followup_n"), _n(c("is_open")).alias("open_insp_n"), _n(c("is_provisional")).alias("provisional_insp_n"), _n(c("jurisdiction") == "state_plan").alias("state_plan_insp_n"), _n(c("fatality_status") == "fatality_cited").alias("fatality_cited_n"),
    )
    facts = viol.where(~c("is_deleted")).join(dated.select("activity_nr", "establishment_key", "year", "is_open"), "activity_nr")
    cited = facts.groupBy("establishment_key", "year").agg(
        F.count("*").alias("viol_n"), *(_n(c("viol_type") == t).alias(f"viol_{t.lower()}_n") for t in "SWROU"), _n(c("is_serious_plus")).alias("viol_serious_plus_n"), _n(c("is_fta")).alias("viol_fta_n"), _n(c("is_open")).alias("viol_open_n"),
        F.sum("penalty_initial").alias("penalty_initial_sum"), F.sum("penalty_current").alias("penalty_current_sum"), F.count("penalty_current").alias("penalty_known_n"),
    )
    return own.join(cited, ["establishment_key", "year"], "left").fillna(0, [x for x in cited.columns if x.endswith("_n")])


def hazard_year(insp: DataFrame, viol: DataFrame) -> DataFrame:
    dated = insp.where("open_date is not null").select("activity_nr", "establishment_key", "visit_id", F.year("open_date").alias("year"))
    return viol.where(~c("is_deleted")).join(dated, "activity_nr").groupBy("establishment_key", "year", "hazard_code").agg(F.count("*").alias("viol_n"), F.countDistinct("activity_nr").alias("insp_n"), _n(c("is_serious_plus")).alias("viol_serious_plus_n"), F.sum("penalty_current").alias("penalty_current_sum"))


def red_flags(insp: DataFrame, viol: DataFrame) -> DataFrame:
    """Events with lineage: fatalities of records, willful, repeat and failure-to-abate citations."""
    head = ["establishment_key", "activity_nr", "citation_id", "kind", "event_date", "hazard_code", "standard_cite", "penalty_initial", "penalty_current", "case_open", "case_provisional", "shared_site_n", "visit_id", "dq_flags"]
    renamed = {"is_open": "case_open", "is_provisional": "case_provisional", "site_group_n": "shared_site_n"}
    none = {x: lit(None).cast("string") for x in ("citation_id", "hazard_code", "standard_cite")}
    deaths = insp.where(c("fatality_status").isin(*FLAGGED)).withColumnsRenamed(renamed).withColumns(none | {"kind": c("fatality_status"), "event_date": c("open_date")}).select(*head)
    own = insp.withColumnsRenamed(renamed).select("activity_nr", "establishment_key", "open_date", *renamed.values(), "visit_id")
    facts = viol.where(~c("is_deleted")).join(own, "activity_nr").withColumn("event_date", F.coalesce("issued_on", "open_date"))
    severe = facts.where("viol_type in ('W', 'R')").withColumn("kind", F.when(c("viol_type") == "W", "willful").otherwise("repeat")).select(*head)
    unabated = facts.where("is_fta").withColumn("kind", lit("fta")).select(*head)
    all_ = deaths.unionByName(severe).unionByName(unabated)
    return all_.select(F.md5(F.concat_ws("|", "kind", c("activity_nr").cast("string"), F.coalesce("citation_id", lit("")))).alias("flag_id"), *head)


def trade_benchmark(insp: DataFrame, est: DataFrame, trades: DataFrame | None, as_of: DataFrame, s: Settings) -> DataFrame:
    recent = F.filter(F.array(*map(lit, s.windows)), lambda w: c("open_date") >= F.add_months("as_of", -12 * w))
    i = insp.join(F.broadcast(as_of)).withColumn("window_years", F.explode(recent))  # one row
    by = i.groupBy("establishment_key", "window_years").agg(_n(rated()).alias("rated_n"), _n(c("citation_n") > 0).alias("with_cit_n"), F.sum("serious_plus_n").alias("serious_plus_n"), F.sum("citation_n").alias("viol_n"))
    peers = by.where(c("rated_n") >= s.least_rated).join(est.where("not is_placeholder and construction_insp_n > 0").select("establishment_key", "primary_naics4", "primary_sic4"), "establishment_key")
    if trades is not None:
        sic = trades.where("code_type = 'sic4'").select(c("code").alias("primary_sic4"), c("naics4").alias("by_sic"))
        peers = peers.join(sic, "primary_sic4", "left").withColumn("primary_naics4", F.coalesce("primary_naics4", "by_sic"))
    leveled = L.over_levels(peers, naics4=c("primary_naics4"), naics3=F.left("primary_naics4", lit(3)), all=lit("23"))
    share = lambda x, p: F.percentile(c(x) / c("rated_n"), lit(p))
    return leveled.groupBy("level", c("code").alias("trade_code"), "window_years").agg(
        F.count("*").alias("peer_n"), *(share("serious_plus_n", p).alias(f"serious_plus_rate_p{round(100 * p)}") for p in (0.5, 0.75, 0.9)), *(share("viol_n", p).alias(f"citation_rate_p{round(100 * p)}") for p in (0.5, 0.75)), share("with_cit_n", 0.5).alias("pct_with_citations_p50")
    )


def quarantine(raw: Raw, rows: DataFrame, people: DataFrame, links: DataFrame) -> DataFrame:
    """What points at records that don't exist; set aside with a reason, not dropped."""
    lost = R.orphans(raw.violation, raw.inspection, ["activity_nr"], "violation", F.concat_ws("/", "activity_nr", "citation_id"), "citation references an inspection that does not exist")
    known = raw.accident.select(c("summary_nr").try_cast("bigint").alias("summary_nr"))
    stubs = R.orphans(people.join(links.select("summary_nr").distinct(), "summary_nr", "left_semi"), known, ["summary_nr"], "accident_injury", F.concat_ws("/", *(c(x).cast("string") for x in ("summary_nr", "line_nr", "person_n"))), "injury references an accident record that does not exist (kept with a stub accident row)")
    there = raw.inspection.select(c("activity_nr").try_cast("bigint").alias("activity_nr"))
    away = R.orphans(rows.where("activity_nr is not null"), there, ["activity_nr"], "accident_injury", F.concat_ws("/", *(c(x).cast("string") for x in ("summary_nr", "line_nr", "activity_nr"))), "injury references an inspection that does not exist")
    return lost.unionByName(stubs).unionByName(away)


def decoded_injuries(people: DataFrame, lookup: DataFrame, acc: DataFrame) -> DataFrame:
    out = people.join(acc.select("summary_nr"), "summary_nr", "left_semi")
    for name, code, family in (("nature", "nature_code", "IN"), ("body_part", "body_code", "BD"), ("fatality_cause", "fat_cause_code", "CAUS"), ("construction_operation", "const_op_code", "OPER")):
        labels = lookup.where(c("accident_code") == family).select(number_or_null(c("accident_number")).alias(code), c("accident_value").alias(name))
        out = out.join(labels, code, "left")
    degree = lit(None).cast("string")
    for code, label in DEGREES.items():
        degree = F.when(c("degree_code") == code, label).otherwise(degree)
    return out.select("summary_nr", "line_nr", "person_n", "age", "sex", degree.alias("degree"), "nature", "body_part", "fatality_cause", "construction_operation", "fall_distance_ft")


class Build:
    """The served tables by name. Each, and what it is made from, is worked out when it is first asked for."""

    def __init__(self, raw: Raw, settings: Settings = Settings(), keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: df) -> None:
        self.raw, self.settings, self.keep = raw, settings, keep
        self._made: dict[str, DataFrame] = {}

    @property
    def names(self) -> list[str]:
        own = ["inspection", "violation", "accident", "accident_inspection", "injury", "quarantine", "establishment", "establishment_member", "establishment_alias", "core_stats", "address_stats", "name_token", "token_df", "establishment_year", "establishment_hazard_year", "red_flag", "trade_benchmark", "dq_check"]
        filed, licensed = self.raw.filings is not None, bool(self.raw.licences)
        return own + ["ref_link"] * (filed or licensed) + ["licence"] * licensed + ["ita_establishment_year", "ita_benchmark"] * filed

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    @cached_property
    def keys(self) -> DataFrame:
        newest = self.raw.inspection.agg(F.max(day_or_null(c("open_date"))).alias("m"))
        since = newest.select(F.add_months("m", -12 * self.settings.history_years).alias("since")) if self.settings.history_years else newest.select(lit("1900-01-01").cast("date").alias("since"))
        return self.keep("keys", keyed(self.raw.inspection, since))

    @cached_property
    def staged(self) -> DataFrame:
        return self.keep("stg_inspection", staged_inspections(scoped(self.keys, self.settings)))

    @cached_property
    def named(self) -> DataFrame:
        """Entities with their name and place alone: known from their records, before citations are."""
        # a record with neither number nor visit is in no served table
        known = self.staged.where(F.coalesce("site_group_id", c("activity_nr").cast("string")).isNotNull())
        first = {"clean_name": "clean_name", "addr_key": "addr_key", "zip5": "mail_zip", "state": "mail_state"}
        return self.keep("entity_named", known.groupBy("establishment_key").agg(*(F.min(x).alias(name) for name, x in first.items())).withColumn("is_placeholder", N.is_placeholder(c("clean_name"))))

    @cached_property
    def as_of(self) -> DataFrame:
        return self.staged.agg(F.max("open_date").alias("as_of"))

    @cached_property
    def injury_rows(self) -> tuple[DataFrame, DataFrame]:
        rows, people = injuries(self.raw.injury)
        return self.keep("injury_rows", rows), self.keep("injury_people", people)

    @cached_property
    def accident_links(self) -> tuple[DataFrame, DataFrame]:
        acc, links = accidents(self.raw, *self.injury_rows, self.staged)
        return self.keep("accident", acc), links

    @cached_property
    def rated_filings(self) -> DataFrame:
        return self.keep("filing_rates", O.rates(O.last_filings(self.raw.filings, self.keep)))

    @cached_property
    def filed(self) -> DataFrame | None:
        return self.keep("filing", O.named_filings(self.rated_filings)) if self.raw.filings is not None else None

    @cached_property
    def licensed(self) -> DataFrame | None:
        return self.keep("licence", O.licences(self.raw.licences, keep=self.keep)) if self.raw.licences else None

    def _make(self, name: str) -> DataFrame:
        raw, s, keep = self.raw, self.settings, self.keep
        match name:
            case "inspection":
                return keep(name, final_inspections(self.staged, self["violation"], *self.accident_links, self.as_of, keep))
            case "violation":
                return keep(name, violations(staged_violations(raw.violation, self.staged), raw.rules, self.as_of, keep))
            case "accident":
                return self.accident_links[0]
            case "accident_inspection":
                return self.accident_links[1]
            case "injury":
                return decoded_injuries(self.injury_rows[1], raw.lookup, self["accident"])
            case "establishment":
                return keep(name, establishments(self["inspection"]))
            case "establishment_member":
                return self["inspection"].select("establishment_key", "activity_nr")
            case "establishment_alias":
                return aliases(self["establishment"])
            case "address_stats":
                return I.shared_addresses(self["establishment"])
            case "name_token":
                return I.token_index(self["establishment"], key="establishment_key")
            case "token_df":
                return I.token_frequency(self["name_token"])
            case "trade_benchmark":
                return trade_benchmark(self["inspection"], self["establishment"], raw.trades, self.as_of, s)
            # served, and read by the checks
            case "establishment_year":
                return keep(name, establishment_year(self["inspection"], self["violation"]))
            case "establishment_hazard_year":
                return keep(name, hazard_year(self["inspection"], self["violation"]))
            case "red_flag":
                return keep(name, red_flags(self["inspection"], self["violation"]))
            case "core_stats":
                return keep(name, I.core_tiers(self["establishment"].withColumn("is_person", N.is_person(c("name_core"), s.given_names, s.surnames))))
            case "quarantine":
                return keep(name, quarantine(raw, *self.injury_rows, self["accident_inspection"]))
            case "dq_check":
                from siltworks import quality  # it uses parts of this module

                return quality.checks(raw, self.keys, self.injury_rows[1], self, s)
            case "ref_link":
                # as many as there are near names at a place: given as they are found, not written first
                return O.links(self.named, keep("reference", O.references(self.filed, self.licensed)))
            case "licence":
                return self.licensed
            case "ita_establishment_year":
                return O.relevant(self.filed, self.named)
            case "ita_benchmark":
                return O.benchmark(self.rated_filings)


def build(raw: Raw, settings: Settings = Settings(), keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: df) -> dict[str, DataFrame]:
    """All served tables by name."""
    made = Build(raw, settings, keep)
    return {name: made[name] for name in made.names}
