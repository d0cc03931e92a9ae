"""What outside lists say of entities: yearly injury filings, contractors' licences, links to entities and peer rates.

Raw tables are all text. Names and streets are cleaned once per distinct value. A link is evidence, never a merge; only equal names
(``M1`` with the zip, ``M2`` with the address) are good enough to be counted, near names at one address (``M3``) are shown as possible.

Nulls: a filing without an establishment or a year keeps null there and counts as one of that key; a licence without a number is left out, it can't
be looked up. Numbers and days that can't be read are null. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from siltworks.functions import addresses as A, names as N
from siltworks.functions.text import null_if_empty, number_or_null, text
from siltworks.operators import rows as R
from siltworks.resolve.candidates import near_names

__all__ = ["LAYOUTS", "benchmark", "filings", "last_filings", "licences", "links", "named_filings", "rates", "references", "relevant"]

c, lit = F.col, F.lit
Keep = Callable[[str, DataFrame], DataFrame]
PER_HOURS = 200_000.0
#: An employer number that this many first words of company names share is nobody's.
SHARED_FROM = 26
#: Filings of fewer hours have no rate worth comparing; more cases than this for each ``PER_HOURS`` are mistakes.
LEAST_HOURS, MOST_RATE = 20_000, 50
HOURS_A_PERSON = (500, 4_000)
# Employer numbers that stand for none.
NO_EMPLOYER = ("000000000", "111111111", "999999999", "123456789", "987654321")
# Columns of the public licence lists; ``=`` marks a constant.
LAYOUTS = {
    "WA L&I": dict(number="ContractorLicenseNumber", entity_id="UBI", name="BusinessName", dba=None, address="Address1", city="City", state="State", zip="Zip", status="ContractorLicenseStatus", expires="LicenseExpirationDate", specialty="SpecialtyCode1Desc"),
    "OR CCB": dict(number="license_number", entity_id="license_number", name="full_name", dba=None, address="address", city="city", state="state", zip="zip_code", status="=ACTIVE", expires="lic_exp_date", specialty="endorsement_text"),
    "CA CSLB": dict(number="LicenseNo", entity_id="LicenseNo", name="BusinessName", dba="BUS-NAME-2", address="MailingAddress", city="City", state="State", zip="ZIPCode", status="PrimaryStatus", expires="ExpirationDate", specialty="Classifications(s)"),
}


def once_per_value(df: DataFrame, column: str, **made: Column) -> DataFrame:
    """``df`` with columns worked out once for each distinct value of ``column``."""
    values = df.select(column).distinct().select(c(column).alias("_v"), *(m.alias(name) for name, m in made.items()))
    return df.join(values, c(column).eqNullSafe(c("_v")), "left").drop("_v")


def _digits(column: str) -> Column:
    return F.regexp_replace(text(column), "[^0-9]", "")


def _as_it_is(_: str, df: DataFrame) -> DataFrame:
    return df


def filings(raw: DataFrame, keep: Keep = _as_it_is) -> DataFrame:
    """The last filing of each establishment and year, with cleaned names, rates and what is odd about it."""
    return named_filings(keep("filing_rates", rates(last_filings(raw, keep))))


def last_filings(raw: DataFrame, keep: Keep = _as_it_is) -> DataFrame:
    """The last filing of each establishment and year, typed, with ``ein_digits``.

    Of several the highest id counts, then the latest time, then a hash of the row: a total order but for equal rows. It is kept: what
    follows reads it several times, and each time all filings would be typed and ranked again.
    """
    amount = lambda x: c(x).try_cast("double")
    typed = raw.select(
        c("id").try_cast("bigint").alias("filing_id"), number_or_null(c("year_filing_for")).alias("year"), F.regexp_replace(F.trim("establishment_id"), r"\.0+$", "").alias("establishment_id"), "company_name", "establishment_name", _digits("ein").alias("ein_digits"),
        "street_address", "city", null_if_empty(F.upper(F.trim("state"))).alias("state"), A.zip5("zip_code").alias("zip5"), F.left(_digits("naics_code"), lit(6)).alias("naics"), amount("annual_average_employees").alias("employees"), amount("total_hours_worked").alias("hours"),
        number_or_null(c("total_deaths")).alias("deaths"), *(F.coalesce(number_or_null(c(f"total_{x}_cases")), lit(0)).alias(name) for x, name in (("dafw", "dafw"), ("djtr", "djtr"), ("other", "other_cases"))), "created_timestamp", F.xxhash64(*(c(f"`{x}`") for x in raw.columns)).alias("_row"),
    )
    last = R.latest(typed, ["establishment_id", "year"], c("filing_id").desc_nulls_last(), c("created_timestamp").desc_nulls_last(), c("_row")).drop("_row")
    return keep("filing_last", last)


def rates(last: DataFrame) -> DataFrame:
    """``last_filings`` with the employer's number, if it is one firm's, rates for each 200,000 hours and what is odd."""
    owned = last.where(F.length("ein_digits") == 9)
    shared = owned.groupBy("ein_digits").agg(F.countDistinct(F.split_part(F.upper(F.trim("company_name")), lit(" "), lit(1))).alias("_names")).where(c("_names") >= SHARED_FROM).select("ein_digits", lit(True).alias("_shared"))
    df = last.join(shared, "ein_digits", "left")
    good = (F.length("ein_digits") == 9) & ~c("ein_digits").isin(*NO_EMPLOYER) & c("_shared").isNull()
    worked, away = c("hours") > 0, c("dafw") + c("djtr")
    # never a division by 0, whichever of the conditions Spark works out first
    rate = lambda n: n * PER_HOURS / F.nullif("hours", lit(0.0))
    cases, each = away + c("other_cases"), c("hours") / F.nullif("employees", lit(0.0))
    flags = R.flags(
        hours_missing=F.coalesce(c("hours"), lit(0.0)) <= 0, hours_per_employee_implausible=(c("employees") > 0) & worked & ((each < HOURS_A_PERSON[0]) | (each > HOURS_A_PERSON[1])),
        too_small_to_rate=worked & (c("hours") < LEAST_HOURS), rate_implausible=worked & (rate(cases) > MOST_RATE),
    )
    made = {"ein": F.when(good, c("ein_digits")), "trir": F.when(worked, rate(cases)), "dart": F.when(worked, rate(away)), "dq_flags": flags}
    return df.withColumns(made).drop("ein_digits", "_shared")


def named_filings(df: DataFrame) -> DataFrame:
    """Filings with names and streets cleaned, once for each distinct value."""
    df = once_per_value(df, "company_name", company_clean=N.clean_name("company_name"))
    df = once_per_value(df, "establishment_name", establishment_clean=N.clean_name("establishment_name"))
    return once_per_value(df, "street_address", addr_key=A.address_key("street_address"))


def licences(lists: Mapping[str, DataFrame], layouts: Mapping[str, Mapping[str, str | None]] = LAYOUTS, keep: Keep = _as_it_is) -> DataFrame:
    """Lists of any layouts as one table, one row for each licence: the one that expires last.

    A list whose name has no layout is an error, a column that a list lacks is null.
    """

    def field(df: DataFrame, where: str | None) -> Column:
        if where is not None and where.startswith("="):
            return lit(where[1:])
        return (c(f"`{where}`") if where in df.columns else lit(None)).cast("string")

    parts = []
    for source, df in sorted(lists.items()):
        at = {name: field(df, where) for name, where in layouts[source].items()}
        parts.append(df.select(
            lit(source).alias("source"), at["number"].alias("number"), at["entity_id"].alias("entity_id"), at["name"].alias("name"), null_if_empty(at["dba"]).alias("dba"), at["address"].alias("address"), at["city"].alias("city"),
            F.upper(at["state"]).alias("state"), A.zip5(at["zip"]).alias("zip5"), at["status"].alias("status"), F.try_to_date(at["expires"], "M/d/yyyy").alias("expires"), at["specialty"].alias("specialty"),
        ))
    rest = [c(x).asc_nulls_last() for x in ("status", "name", "entity_id", "address", "dba", "city", "state", "zip5", "specialty")]
    last = keep("licence_last", R.latest(R.union_all(parts).where("number is not null"), ["source", "number"], c("expires").desc_nulls_last(), *rest))
    last = once_per_value(last, "name", clean_name=N.clean_name("name"))
    last = once_per_value(last, "dba", dba_clean=F.when(c("dba").isNotNull(), N.clean_name("dba")))
    return once_per_value(last, "address", addr_key=A.address_key("address"))


def references(filed: DataFrame | None, licensed: DataFrame | None) -> DataFrame:
    """``source, ref_id, name, state, zip5, addr_key``: every name that an outside record goes by, once."""
    where = ["state", "zip5", "addr_key"]
    parts = []
    if filed is not None:
        parts += [filed.select(lit("ita").alias("source"), c("establishment_id").alias("ref_id"), c(x).alias("name"), *where) for x in ("company_clean", "establishment_clean")]
    if licensed is not None:
        source = F.concat(lit("licence:"), "source").alias("source")
        parts += [licensed.where(c(x).isNotNull()).select(source, c("number").alias("ref_id"), c(x).alias("name"), *where) for x in ("clean_name", "dba_clean")]
    return R.union_all(parts).distinct()


PLACE = ["addr_key", "zip5", "state"]


def _named(est: DataFrame) -> DataFrame:
    return est.where("not is_placeholder").select(c("establishment_key").alias("key"), c("clean_name").alias("name"), *PLACE)


def links(est: DataFrame, refs: DataFrame) -> DataFrame:
    """``establishment_key, source, ref_id, method``: the best way in which an entity and an outside record are the same.

    ``est`` has a row an entity. Near names are compared place by place, and what is found of them is told from equal ones there.
    """
    own = _named(est)
    equal = [own.join(refs, ["name", "state", x]).select("key", "source", "ref_id", lit(method).alias("method")) for method, x in (("M1", "zip5"), ("M2", "addr_key"))]
    exact = R.union_all(equal).groupBy("key", "source", "ref_id").agg(F.min("method").alias("method"))
    near = near_names(own, refs, PLACE, but=exact.drop("method"))
    return exact.unionByName(near.withColumn("method", lit("M3"))).withColumnRenamed("key", "establishment_key")


def relevant(filed: DataFrame, est: DataFrame, trade: str = "23") -> DataFrame:
    """Filings of a trade, and those of other trades that an entity is linked to.

    Whether there is a link is looked up only for establishments with a filing of another trade; for near names only where none is equal.
    """
    own, of_trade = _named(est), F.coalesce(c("naics").startswith(trade), lit(False))
    asked = filed.where(~of_trade & c("establishment_id").isNotNull()).select("establishment_id").distinct()
    refs = references(filed.join(asked, "establishment_id", "left_semi"), None)
    equal = [refs.join(own.select("name", "state", x).distinct(), ["name", "state", x], "left_semi").select("ref_id") for x in ("zip5", "addr_key")]
    known = R.union_all(equal).distinct()
    near = near_names(own, refs.join(known, "ref_id", "left_anti"), PLACE).select("ref_id")
    linked = R.union_all([known, near]).distinct().select(c("ref_id").alias("establishment_id"), lit(True).alias("_linked"))
    return filed.join(linked, "establishment_id", "left").where(of_trade | c("_linked")).drop("_linked")


def benchmark(filed: DataFrame, trade: str = "23") -> DataFrame:
    """Rates of a trade's peers by industry group and year, over filings without any oddity.

    The pooled rate is all cases by all hours: most small peers have no case, so medians are often 0.
    """
    peers = filed.where(c("naics").startswith(trade) & (F.size("dq_flags") == 0) & (c("hours") >= LEAST_HOURS))
    pooled = lambda cases: (F.sum(cases) * PER_HOURS / F.sum("hours"))
    away = c("dafw") + c("djtr")
    points = [F.percentile(x, lit(p)).alias(f"{x}_p{round(100 * p)}") for x in ("trir", "dart") for p in (0.5, 0.75)]
    return peers.groupBy(F.left("naics", lit(4)).alias("naics4"), "year").agg(F.count("*").alias("peer_n"), pooled(away + c("other_cases")).alias("trir_pooled"), pooled(away).alias("dart_pooled"), *points)
