"""Facts about sets of entities: evidence, details, links and coverage, all entities at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siltworks.operators import rows as R
from siltworks.session import table

from .marts import cited, fact_parts, money, query, year


@query("""
WITH v AS (SELECT DISTINCT o_custkey AS entity, p_type AS hazard, o_orderkey AS visit, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT entity, hazard, visit FROM v QUALIFY row_number() OVER (PARTITION BY entity, hazard ORDER BY o_orderdate DESC, visit DESC) <= 3
""")
def hazard_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The latest distinct visits behind each hazard of each entity."""
    v = cited(spark, d).select(F.col("o_custkey").alias("entity"), F.col("p_type").alias("hazard"), F.col("o_orderkey").alias("visit"), "o_orderdate").repartition(fact_parts(spark, d), "entity", "hazard").distinct()
    return R.top_k(v, ["entity", "hazard"], [F.desc("o_orderdate"), F.desc("visit")], 3).select("entity", "hazard", "visit")


@query("""
WITH h AS (SELECT o_custkey AS entity, p_type AS hazard, count(DISTINCT o_orderkey) AS visits_all, count(DISTINCT o_orderkey) FILTER (o_orderdate >= TIMESTAMP '1999-01-01') AS visits_window,
  min(year(o_orderdate))::BIGINT AS first_year, max(year(o_orderdate))::BIGINT AS last_year FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT *, visits_all >= 3 OR visits_window >= 2 AS recurring FROM h
""")
def hazard_visits(spark: SparkSession, d: str) -> DataFrame:
    """Distinct visits of each hazard, ever and within the window; a first grouping leaves one row a visit."""
    rows = cited(spark, d).select(F.col("o_custkey").alias("entity"), F.col("p_type").alias("hazard"), "o_orderkey", "o_orderdate").repartition(fact_parts(spark, d), "entity", "hazard")
    v = rows.groupBy("entity", "hazard", "o_orderkey").agg(F.first("o_orderdate").alias("day"))
    recent = F.count(F.when(F.col("day") >= F.lit("1999-01-01").cast("timestamp"), 1))
    h = v.groupBy("entity", "hazard").agg(F.count("*").alias("visits_all"), recent.alias("visits_window"), F.min(year("day")).alias("first_year"), F.max(year("day")).alias("last_year"))
    return h.withColumn("recurring", (F.col("visits_all") >= 3) | (F.col("visits_window") >= 2))


@query("""
WITH i AS (SELECT l_orderkey, string_agg(p_type || ':' || l_returnflag, ',' ORDER BY p_type, l_returnflag) AS citations, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS penalty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT o_orderkey, c_name, coalesce(citations, '') AS citations, penalty FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN i ON o_orderkey = l_orderkey
""")
def record_detail(spark: SparkSession, d: str) -> DataFrame:
    """Header and citations of every record."""
    i = cited(spark, d).repartition(fact_parts(spark, d), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p_type", "l_returnflag"))), ",").alias("citations"), F.sum(money("l_extendedprice")).cast("double").alias("penalty"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(i, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "c_name", F.coalesce("citations", F.lit("")).alias("citations"), "penalty")


@query("""
WITH r AS (SELECT l_suppkey, year(l_shipdate)::BIGINT AS year, 200000 * (sum(l_quantity::DECIMAL(18,2)) FILTER (l_returnflag = 'R'))::DOUBLE / sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS dart, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS hours FROM lineitem GROUP BY 1, 2),
b AS (SELECT year, round(quantile_cont(dart, 0.75), 6) AS p75, count(dart) AS peers FROM r GROUP BY 1),
t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY year DESC) AS n FROM r WHERE dart IS NOT NULL)
SELECT l_suppkey, count(*) FILTER (round(dart, 6) >= p75 AND hours >= 50000 AND peers >= 5) AS years_above FROM t JOIN b USING (year) WHERE n <= 3 GROUP BY 1
""")
def rates_above_peers(spark: SparkSession, d: str) -> DataFrame:
    """In how many of its last three rated years an entity was at or above its peers' third quartile."""
    hours = F.sum(money("l_extendedprice")).cast("double")
    dart = 200000 * F.sum(F.when(F.col("l_returnflag") == "R", money("l_quantity"))).cast("double") / hours
    r = table(spark, d, "lineitem").groupBy("l_suppkey", year("l_shipdate").alias("year")).agg(dart.alias("dart"), hours.alias("hours"))
    b = r.groupBy("year").agg(F.round(F.percentile("dart", F.lit(0.75)), 6).alias("p75"), F.count("dart").alias("peers"))
    last = R.top_k(r.where("dart is not null"), ["l_suppkey"], [F.desc("year")], 3)
    above = (F.round("dart", 6) >= F.col("p75")) & (F.col("hours") >= 50000) & (F.col("peers") >= 5)
    return last.join(b, "year").groupBy("l_suppkey").agg(F.count(F.when(above, 1)).alias("years_above"))


@query("""
WITH l AS (SELECT o_custkey AS entity, 'a' AS source, o_orderkey % 50 AS number, CASE WHEN o_orderstatus = 'F' THEN 'EXPIRED' ELSE 'ACTIVE' END AS status, CAST(o_orderdate AS DATE) AS expiry FROM orders WHERE o_orderpriority LIKE '1%'
  UNION ALL SELECT o_custkey, 'b', o_orderkey % 50, 'ACTIVE', CAST(o_orderdate + INTERVAL 1 YEAR AS DATE) FROM orders WHERE o_orderpriority LIKE '2%'),
d AS (SELECT DISTINCT ON (source, number) * FROM l ORDER BY source, number, expiry DESC NULLS LAST, entity, status)
SELECT source, number, entity, status, expiry, status = 'EXPIRED' OR expiry < DATE '2000-01-01' AS lapsed FROM d
""")
def licence_union_latest(spark: SparkSession, d: str) -> DataFrame:
    """Lists of several layouts in one table, the latest row of each licence, and whether it has lapsed."""
    o = table(spark, d, "orders").withColumn("number", F.col("o_orderkey") % 50)
    status = F.when(F.col("o_orderstatus") == "F", "EXPIRED").otherwise("ACTIVE")
    a = o.where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("entity"), F.lit("a").alias("source"), "number", status.alias("status"), F.to_date("o_orderdate").alias("expiry"))
    b = o.where("o_orderpriority LIKE '2%'").select(F.col("o_custkey").alias("entity"), F.lit("b").alias("source"), "number", F.lit("ACTIVE").alias("status"), F.to_date(F.expr("o_orderdate + INTERVAL '1' YEAR")).alias("expiry"))
    u = R.top_k(a.unionByName(b), ["source", "number"], [F.col("expiry").desc_nulls_last(), F.col("entity"), F.col("status")])
    return u.withColumn("lapsed", (F.col("status") == "EXPIRED") | (F.col("expiry") < F.lit("2000-01-01").cast("date")))


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, year(o_orderdate)::BIGINT AS year, o_totalprice, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders),
j AS (SELECT o_custkey % 40 AS ein FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 5)
SELECT o_custkey, year, o_orderkey, o_custkey % 40 IN (SELECT ein FROM j) AS junk_id, array_to_string(list_filter(['zero', 'huge'], lambda f: CASE f WHEN 'zero' THEN o_totalprice < 1000 ELSE o_totalprice > 400000 END), ',') AS dq_flags FROM r WHERE n = 1
""")
def filings_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest filing of an entity and year; ids that many entities share are marked as no ids."""
    o = table(spark, d, "orders").withColumn("year", year("o_orderdate"))
    last = R.latest(o, ["o_custkey", "year"], F.desc("o_orderdate"), F.desc("o_orderkey")).withColumn("ein", F.col("o_custkey") % 40)
    junk = o.groupBy((F.col("o_custkey") % 40).alias("ein")).agg(F.countDistinct("o_custkey").alias("n")).where("n > 5").select("ein", F.lit(True).alias("junk_id"))
    flags = R.flags(zero=F.col("o_totalprice") < 1000, huge=F.col("o_totalprice") > 400000)
    return last.join(junk, "ein", "left").select("o_custkey", "year", "o_orderkey", F.coalesce("junk_id", F.lit(False)).alias("junk_id"), F.array_join(flags, ",").alias("dq_flags"))


@query("""
WITH d AS (SELECT o_orderkey AS sub, o_custkey AS entity, CASE WHEN o_orderpriority LIKE '1%' THEN 'matched' WHEN o_orderpriority LIKE '2%' THEN 'possible' ELSE 'excluded' END AS bucket FROM orders),
m AS (SELECT entity, count(DISTINCT sub) AS subs FROM d WHERE bucket = 'matched' GROUP BY 1)
SELECT sub % 100 AS project, count(*) FILTER (bucket = 'matched') AS matched, count(*) FILTER (bucket = 'possible') AS possible, count(*) FILTER (bucket = 'excluded') AS excluded, count(DISTINCT entity) AS entities,
  count(*) FILTER (bucket = 'matched' AND subs > 1) AS shared FROM d LEFT JOIN m USING (entity) GROUP BY 1
""")
def scope_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by bucket for each project, and matches that others have matched too."""
    p = F.col("o_orderpriority")
    bucket = F.when(p.startswith("1"), "matched").when(p.startswith("2"), "possible").otherwise("excluded")
    dec = table(spark, d, "orders").select(F.col("o_orderkey").alias("sub"), F.col("o_custkey").alias("entity"), bucket.alias("bucket"))
    shared = dec.where("bucket = 'matched'").groupBy("entity").agg(F.countDistinct("sub").alias("subs"))
    n = lambda c: F.count(F.when(c, 1))
    is_ = lambda b: F.col("bucket") == b
    return dec.join(shared, "entity", "left").groupBy((F.col("sub") % 100).alias("project")).agg(
        n(is_("matched")).alias("matched"), n(is_("possible")).alias("possible"), n(is_("excluded")).alias("excluded"), F.countDistinct("entity").alias("entities"), n(is_("matched") & (F.col("subs") > 1)).alias("shared")
    )


@query("""
WITH g AS (SELECT o_orderkey, md5(CAST(o_custkey % 50 AS VARCHAR) || '|' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS site_group FROM orders)
SELECT o_orderkey, site_group, count(*) OVER (PARTITION BY site_group) AS group_size FROM g
""")
def site_groups(spark: SparkSession, d: str) -> DataFrame:
    """Records at one place on one day by a hashed id, with the size of each group."""
    o = table(spark, d, "orders").select("o_orderkey", F.md5(F.concat_ws("|", (F.col("o_custkey") % 50).cast("string"), F.to_date("o_orderdate").cast("string"))).alias("site_group"))
    return o.withColumn("group_size", F.count("*").over(Window.partitionBy("site_group")))


@query("""
SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 3 END AS severity FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY left(o_orderpriority, 1), o_orderkey) = 1
""")
def one_event_a_visit(spark: SparkSession, d: str) -> DataFrame:
    """Of several events of a visit the most serious one."""
    from siltworks.operators.verdict import one_event_per_visit

    kind = F.left("o_orderpriority", F.lit(1))
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("visit"), kind.alias("kind"), F.col("o_orderkey").alias("event_id"))
    severity = F.when(F.col("kind") == "1", 1).when(F.col("kind") == "2", 2).otherwise(3)
    return one_event_per_visit(e, ("1", "2", "3", "4", "5")).select(F.col("entity").alias("o_custkey"), F.col("event_id").alias("o_orderkey"), severity.alias("severity"))
