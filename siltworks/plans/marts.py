"""Staging, marts and benchmarks over the driver's tables, each with its SQL counterpart.

Orders stand for inspections, lineitems for citations, customers for entities, nations and regions for
levels of trade, parts for what a citation is about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siltworks.functions.text import day_or_null, number_or_null
from siltworks.operators import checks as C, levels as L, rows as R, rulematch
from siltworks.session import parts, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def money(c):
    return F.col(c).cast("decimal(18,2)")


def year(c):
    return F.year(c).cast("long")


def total(c):
    return F.sum(c).cast("double")


def fact_parts(spark: SparkSession, d: str) -> int:
    return parts(spark, table(spark, d, "lineitem"))


def cited(spark: SparkSession, d: str) -> DataFrame:
    """Citations with their record and subject, no more columns than the queries read.

    Joins are over partitions whose number grows with the citations, so that a task's share doesn't.
    """
    n = fact_parts(spark, d)
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_extendedprice", "l_linestatus")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    p = table(spark, d, "part").select("p_partkey", "p_type")
    known = li.repartition(n, "l_orderkey").join(o.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return known.repartition(n, "l_partkey").join(p.repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_linenumber AS INTEGER) AS coded,
  CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(14,2))::DOUBLE END AS penalty, CAST(l_shipdate AS DATE) AS issued FROM lineitem
""")
def typed_staging(spark: SparkSession, d: str) -> DataFrame:
    """Raw strings to types: coded floats, blank money, the date part of timestamps."""
    li = table(spark, d, "lineitem")
    raw = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(F.col("l_linenumber").cast("string"), F.lit(".0")).alias("code_raw"),
        F.when(F.col("l_discount") == 0, "").otherwise(money("l_extendedprice").cast("string")).alias("penalty_raw"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("issued_raw"),
    )
    return raw.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", number_or_null(F.col("code_raw")).alias("coded"), F.col("penalty_raw").try_cast("decimal(14,2)").cast("double").alias("penalty"), day_or_null(F.col("issued_raw")).alias("issued"))


@query("""
SELECT o_orderkey, array_to_string(list_filter(['open' , 'large', 'urgent', 'weekend'], lambda f: CASE f WHEN 'open' THEN o_orderstatus = 'O' WHEN 'large' THEN o_totalprice > 200000
  WHEN 'urgent' THEN o_orderpriority LIKE '1%' ELSE isodow(o_orderdate) >= 6 END), ',') AS dq_flags FROM orders
""")
def dq_flags_array(spark: SparkSession, d: str) -> DataFrame:
    """Flags are named, never acted on by dropping rows."""
    found = R.flags(open=F.col("o_orderstatus") == "O", large=F.col("o_totalprice") > 200000, urgent=F.col("o_orderpriority").startswith("1"), weekend=F.weekday("o_orderdate") >= 5)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(found, ",").alias("dq_flags"))


@query("""
WITH span AS (SELECT max(o_orderdate) - INTERVAL 3 YEAR AS since FROM orders),
keys AS (SELECT o_custkey, bool_or(o_orderdate >= since) AS recent FROM orders, span WHERE o_orderpriority LIKE '1%' GROUP BY 1),
wide AS (SELECT c_nationkey FROM customer JOIN keys ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) >= 3)
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'own' WHEN recent THEN 'same_entity' WHEN keys.o_custkey IS NOT NULL THEN 'history' ELSE 'related' END AS reason
FROM orders CROSS JOIN span LEFT JOIN keys USING (o_custkey) JOIN customer ON c_custkey = orders.o_custkey
WHERE o_orderdate >= since AND (o_orderpriority LIKE '1%' OR keys.o_custkey IS NOT NULL OR c_nationkey IN (SELECT c_nationkey FROM wide))
""")
def scope_two_pass(spark: SparkSession, d: str) -> DataFrame:
    """Entities with a qualifying record in any year bring their other recent records into scope."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    since = orders.select(F.max("o_orderdate").alias("m")).select(F.expr("m - INTERVAL 3 YEAR").alias("since"))
    dated = orders.join(F.broadcast(since))  # one row
    own = F.col("o_orderpriority").startswith("1")
    keys = dated.where(own).groupBy("o_custkey").agg(F.bool_or(F.col("o_orderdate") >= F.col("since")).alias("recent"))
    wide = customer.join(keys, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n")).where("n >= 3").select("c_nationkey", F.lit(True).alias("wide"))
    all_ = dated.where("o_orderdate >= since").join(keys, "o_custkey", "left").join(customer, F.col("c_custkey") == F.col("o_custkey")).join(wide, "c_nationkey", "left")
    known = F.col("recent").isNotNull()
    reason = F.when(own, "own").when(F.col("recent"), "same_entity").when(known, "history").otherwise("related")
    return all_.where(own | known | F.col("wide")).select("o_orderkey", reason.alias("reason"))


@query("""
WITH codes AS (SELECT * FROM (VALUES ('1', 'urgent'), ('2', 'high'), (NULL, 'missing')) v(code, label)),
o AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE left(o_orderpriority, 1) END AS code FROM orders)
SELECT o_orderkey, coalesce(label, 'other') AS label FROM o LEFT JOIN codes ON o.code IS NOT DISTINCT FROM codes.code
""")
def null_safe_decode(spark: SparkSession, d: str) -> DataFrame:
    codes = F.broadcast(spark.createDataFrame([("1", "urgent"), ("2", "high"), (None, "missing")], "known string, label string"))
    o = table(spark, d, "orders").select("o_orderkey", F.when(~F.col("o_orderpriority").startswith("5"), F.left("o_orderpriority", F.lit(1))).alias("code"))
    return o.join(codes, F.col("code").eqNullSafe(F.col("known")), "left").select("o_orderkey", F.coalesce("label", F.lit("other")).alias("label"))


@query("""
SELECT 'lineitem' AS source_table, concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS source_key, 'no order of status F' AS reason
FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'no orders' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def orphans_quarantine(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    n, m = fact_parts(spark, d), parts(spark, orders)
    closed = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")).repartition(n, "l_orderkey")
    items = R.orphans(table(spark, d, "lineitem").repartition(n, "l_orderkey"), closed, ["l_orderkey"], "lineitem", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "no order of status F")
    placed = orders.select(F.col("o_custkey").alias("c_custkey")).repartition(m, "c_custkey")
    customers = R.orphans(table(spark, d, "customer").repartition(m, "c_custkey"), placed, ["c_custkey"], "customer", F.col("c_custkey"), "no orders")
    return items.unionByName(customers)


@query("""
SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def dedupe_latest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return R.latest(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("""
SELECT DISTINCT ON (p_brand, p_type) p_brand, p_type, p_partkey, p_retailprice FROM part ORDER BY p_brand, p_type, p_retailprice DESC NULLS LAST, p_partkey
""")
def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice")
    return R.top_k(p, ["p_brand", "p_type"], [F.col("p_retailprice").desc_nulls_last(), F.col("p_partkey")])


@query("""
WITH a AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, x.priority AS o_orderpriority, y.status AS o_orderstatus
FROM (SELECT o_custkey, first(v ORDER BY n DESC, v) AS priority FROM a GROUP BY 1) x JOIN (SELECT o_custkey, first(v ORDER BY n DESC, v) AS status FROM b GROUP BY 1) y USING (o_custkey)
""")
def deterministic_mode(spark: SparkSession, d: str) -> DataFrame:
    return R.modes(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus"), ["o_custkey"], ["o_orderpriority", "o_orderstatus"])


@query("""
SELECT p_brand, array_to_string(list(DISTINCT p_name ORDER BY p_name)[1:25], '|') AS variants, count(DISTINCT p_name) AS n FROM part GROUP BY 1
""")
def name_variants_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(R.variants("p_name"), "|").alias("variants"), F.countDistinct("p_name").alias("n"))


@query("""
SELECT conv_id, string_agg(role || ':' || length(text), ';' ORDER BY turn, role, text) AS said FROM conversations GROUP BY 1
""")
def ordered_string_agg(spark: SparkSession, d: str) -> DataFrame:
    part = F.struct("turn", "role", "text", F.concat_ws(":", "role", F.length("text").cast("string")).alias("s"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), ";")
    return table(spark, d, "conversations").groupBy("conv_id").agg(said.alias("said"))


@query("""
WITH m AS (SELECT *, lag(ts) OVER w AS before, lag(event_type) OVER w AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR OR (kind <> event_type AND ts - before > INTERVAL 1 HOUR) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, CAST(run AS INTEGER) AS run, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY 1, 2
""")
def sessionize_runs(spark: SparkSession, d: str) -> DataFrame:
    keys, order = ["user_id"], [F.col("ts"), F.col("event_id")]
    w = R.ordered(keys, order)
    before, kind = F.lag("ts").over(w), F.lag("event_type").over(w)
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", before.alias("before"), kind.alias("kind"))
    gap = F.col("ts") - F.col("before")
    starts = F.col("before").isNull() | (gap > F.expr("INTERVAL '6' HOUR")) | ((F.col("kind") != F.col("event_type")) & (gap > F.expr("INTERVAL '1' HOUR")))
    return R.runs(e, keys, order, starts).groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def entity_year(orders: DataFrame, items: DataFrame) -> DataFrame:
    """The additive mart: items are counted by record first, so one join and one grouping of records do the rest."""
    per_order = items.groupBy("l_orderkey").agg(F.count("*").alias("c"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("s"), F.sum(money("l_extendedprice")).alias("p"))
    priority = lambda k: F.count(F.when(F.col("o_orderpriority").startswith(k), 1))
    both = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.groupBy(F.col("o_custkey").alias("entity"), year("o_orderdate").alias("year")).agg(
        F.count("*").alias("inspections"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("open"), priority("1").alias("accidents"), priority("5").alias("complaints"), total(money("o_totalprice")).alias("amount"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("citations"), F.coalesce(F.sum("s"), F.lit(0)).alias("serious"), total("p").alias("penalty"),
    )


@query("""
WITH own AS (SELECT o_custkey AS entity, year(o_orderdate)::BIGINT AS year, count(*) AS inspections, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderpriority LIKE '1%') AS accidents,
  count(*) FILTER (o_orderpriority LIKE '5%') AS complaints, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS amount FROM orders GROUP BY 1, 2),
cited AS (SELECT o_custkey AS entity, year(o_orderdate)::BIGINT AS year, count(*) AS citations, count(*) FILTER (l_returnflag = 'R') AS serious, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS penalty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT entity, year, inspections, open, accidents, complaints, amount, coalesce(citations, 0) AS citations, coalesce(serious, 0) AS serious, penalty FROM own LEFT JOIN cited USING (entity, year)
""")
def filtered_counts_year(spark: SparkSession, d: str) -> DataFrame:
    return entity_year(table(spark, d, "orders"), table(spark, d, "lineitem"))


@query("""
SELECT o_custkey AS entity, year(o_orderdate)::BIGINT AS year, p_type AS hazard, count(*) AS citations, count(DISTINCT o_orderkey) AS visits, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS penalty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3
""")
def hazard_year(spark: SparkSession, d: str) -> DataFrame:
    rows = cited(spark, d).select(F.col("o_custkey").alias("entity"), year("o_orderdate").alias("year"), F.col("p_type").alias("hazard"), "o_orderkey", "l_extendedprice").repartition(fact_parts(spark, d), "entity", "year", "hazard")
    return rows.groupBy("entity", "year", "hazard").agg(F.count("*").alias("citations"), F.countDistinct("o_orderkey").alias("visits"), total(money("l_extendedprice")).alias("penalty"))


@query("""
WITH big AS (SELECT o_custkey AS entity, 'large' AS kind, o_orderkey AS ref, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 300000),
urgent AS (SELECT o_custkey, 'urgent', o_orderkey, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'O'),
returned AS (SELECT o_custkey, 'returned', o_orderkey, CAST(max(l_shipdate) AS DATE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2, 3 HAVING count(*) >= 3),
u AS (SELECT * FROM big UNION ALL SELECT * FROM urgent UNION ALL SELECT * FROM returned)
SELECT md5(kind || '|' || ref) AS flag_id, entity, kind, ref, day FROM u
""")
def event_union_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Events of several kinds in one table, each with a stable id and the record it comes from."""
    o = table(spark, d, "orders")
    event = lambda df, kind, day: df.select(F.col("o_custkey").alias("entity"), F.lit(kind).alias("kind"), F.col("o_orderkey").alias("ref"), F.to_date(day).alias("day"))
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last")).where("n >= 3")
    all_ = event(o.where("o_totalprice > 300000"), "large", "o_orderdate").unionByName(event(o.where("o_orderpriority LIKE '1%' AND o_orderstatus = 'O'"), "urgent", "o_orderdate"))
    all_ = all_.unionByName(event(o.join(returned, F.col("o_orderkey") == F.col("l_orderkey")), "returned", "last"))
    return all_.select(F.md5(F.concat_ws("|", "kind", F.col("ref").cast("string"))).alias("flag_id"), "entity", "kind", "ref", "day")


RULES = [
    ("Brand#11", "exact", "7", None, "fall"), ("Brand#11", "range", "5", "20", "machine"), ("Brand#11", "range", "10", "15", "electric"), ("Brand#12", "prefix", "1", None, "trench"),
    ("Brand#12", "prefix", "12", None, "ladder"), ("Brand#12", "exact", "12", None, "scaffold"), ("Brand#13", "range", "2", "9", "noise"), ("Brand#13", "prefix", "3", None, "dust"),
    ("Brand#21", "range", "1", "50", "general"), ("Brand#21", "range", "40", "50", "crane"),
]
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in RULES)


@query(f"""
WITH rules AS (SELECT * FROM (VALUES {_VALUES}) v(family, match_type, pattern, range_to, hazard)),
f AS (SELECT p_partkey, p_brand AS family, CAST(p_size AS VARCHAR) AS k FROM part),
m AS (SELECT p_partkey, hazard, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE match_type WHEN 'exact' THEN 1 WHEN 'range' THEN 2 ELSE 3 END,
    CASE WHEN match_type = 'range' THEN pattern::INT END DESC, CASE WHEN match_type = 'range' THEN range_to::INT END, length(pattern) DESC, hazard) AS n
  FROM f JOIN rules USING (family) WHERE (match_type = 'exact' AND k = pattern) OR (match_type = 'range' AND k::INT BETWEEN pattern::INT AND range_to::INT) OR (match_type = 'prefix' AND starts_with(k, pattern)))
SELECT p_partkey, family, k AS section_key, coalesce(hazard, 'other') AS hazard_code FROM f LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (p_partkey)
""")
def rule_match_exact_range_prefix(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "family string, match_type string, pattern string, range_to string, hazard_code string")
    facts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("family"), F.col("p_size").cast("string").alias("section_key"))
    return rulematch.match_rules(facts, rules).select("p_partkey", "family", "section_key", "hazard_code")


def _rates(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey"))
    by = li.groupBy("l_suppkey", year("l_shipdate").alias("year")).agg(F.count("*").alias("rated"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("serious"))
    return by.join(s, F.col("l_suppkey") == F.col("s_suppkey"))


_BENCH = """
WITH y AS (SELECT l_suppkey, year(l_shipdate)::BIGINT AS year, count(*) AS rated, count(*) FILTER (l_returnflag = 'R') AS serious FROM lineitem GROUP BY 1, 2),
s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
w AS (SELECT unnest([1, 3, 5]) AS window_years),
e AS (SELECT l_suppkey, s_nationkey, n_regionkey, window_years, sum(rated) AS rated, sum(serious) AS serious FROM y JOIN s ON l_suppkey = s_suppkey, w WHERE year > 2000 - window_years AND year <= 2000 GROUP BY 1, 2, 3, 4 HAVING sum(rated) >= 3),
l AS (SELECT 'nation' AS level, CAST(s_nationkey AS VARCHAR) AS code, * FROM e UNION ALL SELECT 'region', CAST(n_regionkey AS VARCHAR), * FROM e UNION ALL SELECT 'all', '', * FROM e),
b AS (SELECT level, code, window_years, count(*) AS peers, round(quantile_cont(serious / rated, 0.5), 4) AS p50, round(quantile_cont(serious / rated, 0.75), 4) AS p75, round(quantile_cont(serious / rated, 0.9), 4) AS p90 FROM l GROUP BY 1, 2, 3)
"""


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    windowed = L.over_windows(_rates(spark, d), "year", 2000, (1, 3, 5))
    e = windowed.groupBy("l_suppkey", "s_nationkey", "n_regionkey", "window_years").agg(F.sum("rated").alias("rated"), F.sum("serious").alias("serious")).where("rated >= 3")
    leveled = L.over_levels(e.withColumn("rate", F.col("serious") / F.col("rated")), nation=F.col("s_nationkey"), region=F.col("n_regionkey"), all=F.lit(""))
    return leveled.groupBy("level", "code", "window_years").agg(F.count("*").alias("peers"), *L.percentiles("rate", 0.5, 0.75, 0.9))


@query(_BENCH + "SELECT * FROM b")
def percentile_benchmark_levels(spark: SparkSession, d: str) -> DataFrame:
    return benchmark(spark, d)


@query(_BENCH + """
SELECT s_suppkey, level, code, peers, p75 FROM s JOIN b ON window_years = 3 AND peers >= 5 AND code = CASE level WHEN 'nation' THEN CAST(s_nationkey AS VARCHAR) WHEN 'region' THEN CAST(n_regionkey AS VARCHAR) ELSE '' END
QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY CASE level WHEN 'nation' THEN 1 WHEN 'region' THEN 2 ELSE 3 END) = 1
""")
def benchmark_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The most specific level with enough peers."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_regionkey")), F.col("s_nationkey") == F.col("n_nationkey"))
    own = L.over_levels(s, nation=F.col("s_nationkey"), region=F.col("n_regionkey"), all=F.lit("")).select("s_suppkey", "level", "code")
    joined = own.join(benchmark(spark, d).where("window_years = 3"), ["level", "code"])
    return L.most_specific(joined, ["s_suppkey"], ("nation", "region", "all"), 5).select("s_suppkey", "level", "code", "peers", "p75")


@query("""
SELECT o_custkey AS entity, w AS window_years, count(*) AS inspections, count(*) FILTER (o_orderstatus = 'F') AS closed FROM orders, (SELECT unnest([1, 3, 5]) AS w)
WHERE year(o_orderdate) > 2000 - w AND year(o_orderdate) <= 2000 GROUP BY 1, 2
""")
def rolling_windows_replicated(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), "o_orderstatus")
    return L.over_windows(o, "year", 2000, (1, 3, 5)).groupBy("entity", "window_years").agg(F.count("*").alias("inspections"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("closed"))


@query("""
SELECT l_suppkey, year(l_shipdate)::BIGINT AS year, round(200000 * sum(l_quantity::DECIMAL(18,2))::DOUBLE / nullif(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 0), 4) AS trir,
  round(200000 * sum(l_quantity::DECIMAL(18,2)) FILTER (l_returnflag = 'R')::DOUBLE / nullif(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 0), 4) AS dart, count(*) AS filings FROM lineitem GROUP BY 1, 2
""")
def pooled_rates(spark: SparkSession, d: str) -> DataFrame:
    q, h = money("l_quantity"), money("l_extendedprice")
    rate = lambda c: F.round(200000 * F.sum(c).cast("double") / F.nullif(F.sum(h).cast("double"), F.lit(0.0)), 4)
    return table(spark, d, "lineitem").groupBy("l_suppkey", year("l_shipdate").alias("year")).agg(rate(q).alias("trir"), rate(F.when(F.col("l_returnflag") == "R", q)).alias("dart"), F.count("*").alias("filings"))


@query("""
WITH i AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, bool_and(l_linestatus = 'F') AS final FROM lineitem GROUP BY 1),
lim AS (SELECT max(o_orderdate) - INTERVAL 7 MONTH AS deadline FROM orders)
SELECT o_orderkey, CASE WHEN n IS NULL AND o_orderdate > deadline THEN 'pending' WHEN n IS NULL THEN 'not_cited' WHEN r >= 2 AND final THEN 'cited_final' WHEN r >= 2 THEN 'cited' WHEN r = 1 THEN 'minor' ELSE 'clear' END AS status,
  o_orderdate > deadline AS is_provisional FROM orders LEFT JOIN i ON o_orderkey = l_orderkey, lim
""")
def visit_status_cascade(spark: SparkSession, d: str) -> DataFrame:
    """An ordered status, with a deadline counted from the data's own last day."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    i = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r"), F.bool_and(F.col("l_linestatus") == "F").alias("final"))
    limit = o.select(F.max("o_orderdate").alias("m")).select(F.expr("m - INTERVAL 7 MONTH").alias("deadline"))
    df = o.join(F.broadcast(limit)).join(i, F.col("o_orderkey") == F.col("l_orderkey"), "left")  # one row
    late = F.col("o_orderdate") > F.col("deadline")
    status = F.when(F.col("n").isNull() & late, "pending").when(F.col("n").isNull(), "not_cited").when((F.col("r") >= 2) & F.col("final"), "cited_final").when(F.col("r") >= 2, "cited").when(F.col("r") == 1, "minor").otherwise("clear")
    return df.select("o_orderkey", status.alias("status"), late.alias("is_provisional"))


@query("""
WITH c AS (SELECT p_type AS hazard, p_brand AS section, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT hazard, section, n, CAST(row_number() OVER (PARTITION BY hazard ORDER BY n DESC, section) AS INTEGER) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY hazard ORDER BY n DESC, section) <= 3
""")
def top3_per_group(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select("l_partkey").join(table(spark, d, "part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("hazard"), F.col("p_brand").alias("section")).agg(F.count("*").alias("n"))
    return R.top_k(c, ["hazard"], [F.desc("n"), F.col("section")], 3, rank="rank")


@query("""
WITH c AS (SELECT o_custkey, p_type, sum(l_quantity::DECIMAL(18,2)) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT c_custkey, coalesce(first(p_type ORDER BY w DESC, p_type), 'typed:' || c_mktsegment) AS trade FROM customer LEFT JOIN c ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment
""")
def weighted_mode_trade(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    c = w.groupBy("o_custkey", "p_type").agg(F.sum(money("l_quantity")).alias("w")).groupBy("o_custkey").agg(F.min_by("p_type", F.struct(-F.col("w"), F.col("p_type"))).alias("t"))
    return table(spark, d, "customer").join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("t", F.concat(F.lit("typed:"), "c_mktsegment")).alias("trade"))


@query("""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS has_open, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AS never_large FROM customer
""")
def semi_anti_exists(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("a"), F.bool_or(F.col("o_totalprice") > 250000).alias("b"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("a", F.lit(False)).alias("has_open"), (~F.coalesce("b", F.lit(False))).alias("never_large"))


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '7'), o_orderkey LIMIT 100
""")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.hash_sample(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), F.col("o_orderkey"), 100)


@query("""
SELECT * FROM (
  SELECT 'orders_total' AS check_name, 'error' AS severity, (SELECT count(*) FROM orders)::DOUBLE AS found, (SELECT sum(n) FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1))::DOUBLE AS expected
  UNION ALL SELECT 'orders_key_unique', 'error', (SELECT count(*) FROM orders)::DOUBLE, (SELECT count(DISTINCT o_orderkey) FROM orders)::DOUBLE
  UNION ALL SELECT 'items_have_orders', 'error', (SELECT count(*) FROM lineitem)::DOUBLE, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))::DOUBLE
  UNION ALL SELECT 'items_unique', 'warn', (SELECT count(*) FROM lineitem)::DOUBLE, (SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)::DOUBLE
  UNION ALL SELECT 'hazards_add_up', 'error', (SELECT sum(c) FROM (SELECT p_type, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1))::DOUBLE, (SELECT count(*) FROM lineitem)::DOUBLE
), LATERAL (SELECT abs(found - expected) <= abs(expected) * CASE check_name WHEN 'items_unique' THEN 0.1 ELSE 0 END AS passed)
""")
def dq_checks(spark: SparkSession, d: str) -> DataFrame:
    """Totals counted twice, in independent ways."""
    o, li, p = (table(spark, d, t) for t in ("orders", "lineitem", "part"))
    n = lambda df: df.agg(F.count("*"))
    by_type = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.count("*").alias("c")).agg(F.sum("c"))
    return C.all_checks(
        C.check("orders_total", n(o), o.groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.sum("n"))),
        C.check("orders_key_unique", n(o), o.agg(F.countDistinct("o_orderkey"))),
        C.check("items_have_orders", n(li), n(li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi"))),
        C.check("items_unique", n(li), li.agg(F.countDistinct(F.struct("l_orderkey", "l_linenumber"))), "warn", 0.1),
        C.check("hazards_add_up", by_type, n(li)),
    )


@query()
def table_checksum(spark: SparkSession, d: str) -> DataFrame:
    """The hash is Spark's own, so there is no SQL counterpart."""
    return C.checksum(table(spark, d, "orders"))


@query("""
SELECT n_name AS name, s_suppkey, NULL::DOUBLE AS c_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, NULL, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Drops with different columns in one table; what one lacks is null."""
    n = F.broadcast(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name")))
    a = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("name", "s_suppkey")
    b = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("name", "c_acctbal")
    return a.unionByName(b, allowMissingColumns=True)


@query("""
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) >= 1996 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50
""")
def paged_list(spark: SparkSession, d: str) -> DataFrame:
    """A page of a filtered list in a total order."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F' AND year(o_orderdate) >= 1996")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("""
WITH y AS (SELECT year(o_orderdate)::BIGINT AS year, count(*) AS inspections, count(*) FILTER (o_orderstatus = 'O') AS open, sum(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice::DECIMAL(18,2) END)::DOUBLE AS penalty FROM orders GROUP BY 1)
SELECT year, inspections, open, penalty, inspections - lag(inspections) OVER (ORDER BY year) AS change FROM y
""")
def trend_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Yearly sums; a sum of unknown amounts stays null."""
    y = table(spark, d, "orders").groupBy(year("o_orderdate").alias("year")).agg(F.count("*").alias("inspections"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("open"), total(F.when(F.col("o_orderpriority").startswith("1"), money("o_totalprice"))).alias("penalty"))
    return y.withColumn("change", F.col("inspections") - F.lag("inspections").over(Window.orderBy("year")))  # a row a year
