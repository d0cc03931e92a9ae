"""Questions, answers and decisions made from orders and their lines, each query beside its SQL.

A customer stands for a subject, an order for a question about the parts of its lines, a part for a record; records go by words made
from part numbers, so that a name has several records in several states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.resolve import questions as Q
from siltworks.session import parts, table
from siltworks.sources.scratch import keeper

from .marts import query

#: lines of orders, a question's records, that a task takes
LINES_A_TASK = 250_000
_MADE = "translate(left(md5(CAST(k AS STRING)), 8), '0123456789abcdef', 'ABCDEFGHIKLMNOPR')"
_RECORDS = f"""SELECT 'r' || CAST(p_partkey AS STRING) AS entity_key, {_MADE} AS name, CASE p_partkey % 3 WHEN 0 THEN 'TX' WHEN 1 THEN 'OK' ELSE 'LA' END AS state, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'CITY' || CAST(p_partkey % 4 AS STRING) END AS city,
 CAST(p_size AS BIGINT) AS n, 1990 + p_partkey % 9 AS first_year, 2000 + p_partkey % 5 AS last_year, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END AS red_flags, k FROM (SELECT *, CAST(floor(p_partkey / 6) AS BIGINT) AS k FROM part)"""
_TIERS = "SELECT DISTINCT name, CASE k % 7 WHEN 0 THEN 'person' WHEN 1 THEN 'generic' WHEN 2 THEN 'medium' ELSE 'distinctive' END AS tier FROM records"
_OWN = "SELECT DISTINCT o_custkey AS sub_id, name FROM orders JOIN records ON k % 5 = o_custkey % 5 AND k % 8 = o_custkey % 8"
# A subject's own names are only ever left out of the names that its questions are about: those among them are all that is read.
_OWN_ASKED = """SELECT DISTINCT sub_id, name FROM (SELECT DISTINCT o_custkey AS sub_id, 'r' || CAST(l_partkey AS STRING) AS entity_key FROM orders JOIN lineitem ON l_orderkey = o_orderkey) JOIN records USING (entity_key)
 WHERE k % 5 = sub_id % 5 AND k % 8 = sub_id % 8"""
_ASKED = """SELECT o_orderkey AS question_id, o_custkey AS sub_id, CASE o_orderkey % 13 WHEN 0 THEN 'remap' WHEN 1 THEN 'profile' WHEN 2 THEN 'web' ELSE 'red_flag' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS suggestion,
 o_orderdate AS created, CASE WHEN o_orderstatus = 'F' THEN 'yes' END AS answer FROM orders"""
_LINES = "SELECT DISTINCT l_orderkey AS question_id, 'r' || CAST(l_partkey AS STRING) AS entity_key FROM lineitem"
_DECIDED = "SELECT DISTINCT o_custkey AS sub_id, 'r' || CAST(l_partkey AS STRING) AS entity_key, CASE WHEN l_partkey % 4 = 0 THEN 'matched' ELSE 'possible' END AS bucket, CASE WHEN l_partkey % 6 = 5 THEN 'user' ELSE 'rule' END AS method FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
_SQL = "WITH RECURSIVE " + f"records AS ({_RECORDS}), tiers AS ({_TIERS}), own AS ({_OWN}), asked AS ({_ASKED}), lines AS ({_LINES}), decided AS ({_DECIDED})".replace("STRING", "VARCHAR")


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    t = {n: table(spark, d, n) for n in ("part", "orders", "lineitem")}
    n = parts(spark, t["lineitem"], LINES_A_TASK)
    t["lineitem"] = t["lineitem"].repartition(n, "l_orderkey")  # by question, so that a task's share stays as it is
    for name, sql in (("records", _RECORDS), ("tiers", _TIERS), ("own", _OWN_ASKED), ("asked", _ASKED), ("lines", _LINES), ("decided", _DECIDED)):
        used = {n: df for n, df in t.items() if f"FROM {n}" in sql or f"JOIN {n}" in sql}
        for n in used:
            sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}} {n}")
        t[name] = spark.sql(sql, **used)
    keys = t["lines"].groupBy("question_id").agg(F.array_sort(F.collect_list("entity_key")).alias("entity_keys"))
    t["questions"] = t["asked"].join(keys, "question_id")
    return t


_UNITED = """, opened AS (SELECT asked.* FROM asked WHERE answer IS NULL AND kind <> 'remap' AND question_id IN (SELECT question_id FROM lines)), named AS (SELECT o.question_id, sub_id, entity_key, name, tier FROM opened o JOIN lines USING (question_id) JOIN records USING (entity_key) JOIN tiers USING (name)),
persons AS (SELECT DISTINCT question_id FROM named WHERE tier = 'person'), free AS (SELECT * FROM named WHERE question_id NOT IN (SELECT question_id FROM persons)),
edges AS (SELECT DISTINCT question_id AS q, sub_id || '|r|' || entity_key AS key FROM free UNION SELECT question_id, sub_id || '|n|' || name FROM free WHERE tier = 'distinctive' AND (sub_id, name) NOT IN (SELECT (sub_id, name) FROM own)
 UNION SELECT question_id, sub_id || '|e|' || kind || coalesce(suggestion, '') FROM opened WHERE kind IN ('profile', 'web') AND question_id NOT IN (SELECT question_id FROM persons)),
beside AS (SELECT DISTINCT a.q AS a, b.q AS b FROM edges a JOIN edges b USING (key)),
reach(a, b) AS (SELECT question_id, question_id FROM opened UNION SELECT r.a, n.b FROM reach r JOIN beside n ON n.a = r.b),
labels AS (SELECT a AS question_id, min(b) AS label FROM reach GROUP BY 1)"""


@query(_SQL + _UNITED + """, one AS (SELECT label, min_by(question_id, (created, question_id)) AS question_id, min_by(kind, (created, question_id)) AS kind, CASE WHEN count(suggestion) = count(*) AND min(suggestion) = max(suggestion) THEN min(suggestion) END AS suggestion FROM opened JOIN labels USING (question_id) GROUP BY 1),
keys AS (SELECT label, string_agg(DISTINCT entity_key, ',' ORDER BY entity_key) AS entity_keys FROM labels JOIN lines USING (question_id) GROUP BY 1)
SELECT question_id, kind, suggestion, entity_keys FROM one JOIN keys USING (label)
UNION ALL SELECT question_id, kind, suggestion, (SELECT string_agg(entity_key, ',' ORDER BY entity_key) FROM lines l WHERE l.question_id = asked.question_id) FROM asked WHERE question_id NOT IN (SELECT question_id FROM opened) AND question_id IN (SELECT question_id FROM lines)""")
def merged_questions(spark: SparkSession, d: str) -> DataFrame:
    """Every question after those of a subject that are one have been united."""
    t = _tables(spark, d)
    keep = keeper(spark)
    asked = keep("questions", t["questions"])
    labels = Q.united(asked, t["records"], t["tiers"], t["own"], keep)
    return Q.merge_open(asked, labels).select("question_id", "kind", "suggestion", F.array_join("entity_keys", ",").alias("entity_keys"))


@query(_SQL + """, opened AS (SELECT * FROM asked WHERE answer IS NULL AND kind <> 'remap'), about AS (SELECT DISTINCT question_id, sub_id, name FROM opened JOIN lines USING (question_id) JOIN records USING (entity_key) JOIN tiers USING (name) WHERE tier = 'distinctive' AND (sub_id, name) NOT IN (SELECT (sub_id, name) FROM own)),
f AS (SELECT sub_id, name, min(question_id) AS question_id FROM about GROUP BY 1, 2), busy AS (SELECT sub_id, entity_key FROM asked JOIN lines USING (question_id) WHERE answer IS NULL UNION SELECT sub_id, entity_key FROM decided WHERE method IN ('user', 'remap') OR bucket = 'matched')
SELECT question_id, f.sub_id, entity_key, name FROM f JOIN records USING (name) WHERE (f.sub_id, entity_key) NOT IN (SELECT (sub_id, entity_key) FROM busy) QUALIFY row_number() OVER (PARTITION BY f.sub_id, name ORDER BY n DESC, entity_key) <= 3""")
def covered_records(spark: SparkSession, d: str) -> DataFrame:
    """What open questions cover besides: other records of the companies they ask about."""
    t = _tables(spark, d)
    return Q.covered(t["questions"], t["records"], t["tiers"], t["own"], t["decided"], 3)


@query(_SQL + """, said AS (SELECT DISTINCT sub_id, entity_key, CASE WHEN suggestion = 'yes' THEN 'matched' WHEN suggestion = 'no' THEN 'excluded' ELSE 'possible' END AS bucket FROM asked JOIN lines USING (question_id) WHERE answer IS NOT NULL),
about AS (SELECT DISTINCT sub_id, name, bucket, state FROM said JOIN records USING (entity_key) JOIN tiers USING (name) WHERE tier = 'distinctive' AND bucket <> 'possible' AND (sub_id, name) NOT IN (SELECT (sub_id, name) FROM own)),
one AS (SELECT sub_id, name, min(bucket) AS bucket, list(state) AS states FROM about GROUP BY 1, 2 HAVING count(DISTINCT bucket) = 1), held AS (SELECT sub_id, entity_key FROM decided WHERE method IN ('user', 'remap') OR bucket = 'matched' UNION SELECT sub_id, entity_key FROM said)
SELECT one.sub_id, entity_key, bucket FROM one JOIN records USING (name) WHERE red_flags = 0 AND (bucket = 'excluded' OR list_contains(states, state)) AND (one.sub_id, entity_key) NOT IN (SELECT (sub_id, entity_key) FROM held) QUALIFY row_number() OVER (PARTITION BY one.sub_id, name ORDER BY n DESC, entity_key) <= 20""")
def carried_answers(spark: SparkSession, d: str) -> DataFrame:
    """Records that people's answers about a company settle without their being asked."""
    t = _tables(spark, d)
    bucket = F.when(F.col("suggestion") == "yes", "matched").when(F.col("suggestion") == "no", "excluded").otherwise("possible")
    answers = t["questions"].where("answer is not null").select("sub_id", F.explode("entity_keys").alias("entity_key"), bucket.alias("bucket")).distinct()
    return Q.carry(answers, t["decided"], t["records"], t["tiers"], t["own"])


@query(_SQL + """, rows_ AS (SELECT question_id, sub_id, name, coalesce(nullif(concat_ws(', ', city, state), ''), 'no place on file') AS place, n, first_year, last_year FROM asked JOIN lines USING (question_id) JOIN records USING (entity_key) WHERE answer IS NULL AND kind <> 'remap'),
t AS (SELECT question_id, sub_id, sum(n)::BIGINT AS n, min(first_year) AS a, max(last_year) AS b FROM rows_ GROUP BY 1, 2),
nm AS (SELECT question_id, list(name ORDER BY k DESC, name) AS x FROM (SELECT question_id, name, count(*) AS k FROM rows_ GROUP BY 1, 2) GROUP BY 1), pl AS (SELECT question_id, list(place ORDER BY k DESC, place) AS y FROM (SELECT question_id, place, count(*) AS k FROM rows_ GROUP BY 1, 2) GROUP BY 1)
SELECT question_id, n || CASE WHEN n = 1 THEN ' inspection' ELSE ' inspections' END || ', ' || CASE WHEN a = b THEN a::VARCHAR ELSE a || ' to ' || b END || ', under ' || array_to_string(x[1:5], '; ') || CASE WHEN len(x) > 5 THEN ' and ' || (len(x) - 5) || ' more' ELSE '' END
 || ' (' || array_to_string(y[1:5], '; ') || CASE WHEN len(y) > 5 THEN ' and ' || (len(y) - 5) || ' more' ELSE '' END || '). The same company as customer ' || sub_id || '?' AS text FROM t JOIN nm USING (question_id) JOIN pl USING (question_id)""")
def question_wording(spark: SparkSession, d: str) -> DataFrame:
    """What open questions say."""
    t = _tables(spark, d)
    subjects = t["asked"].select("sub_id", F.concat(F.lit("customer "), F.col("sub_id").cast("string")).alias("entered_name")).distinct()
    return Q.wording(t["questions"], t["records"], subjects, parts=parts(spark, table(spark, d, "lineitem"), LINES_A_TASK))


@query(_SQL + """, g AS (SELECT sub_id, name, state, tier, list(DISTINCT entity_key ORDER BY entity_key) AS keys, CASE WHEN min(suggestion) = max(suggestion) THEN min(suggestion) END AS lean, sum(red_flags)::BIGINT AS red_flags FROM asked JOIN lines USING (question_id) JOIN records USING (entity_key) JOIN tiers USING (name) WHERE red_flags > 0 AND sub_id % 3 = 0 GROUP BY 1, 2, 3, 4),
b AS (SELECT *, count(*) OVER (PARTITION BY sub_id) > 4 AND NOT bool_or(tier = 'person') OVER (PARTITION BY sub_id) AS by_name FROM g),
a AS (SELECT sub_id, name, CASE WHEN NOT by_name THEN state END AS st, list_sort(list_distinct(flatten(list(keys)))) AS keys, CASE WHEN count(lean) = count(*) AND min(lean) = max(lean) THEN min(lean) END AS suggestion, sum(red_flags)::BIGINT AS red_flags FROM b GROUP BY 1, 2, 3)
SELECT sub_id, row_number() OVER (PARTITION BY sub_id ORDER BY red_flags DESC, name NULLS FIRST, st NULLS FIRST)::INTEGER AS asked, array_to_string(keys, ',') AS entity_keys, suggestion, red_flags FROM a""")
def questions_to_ask(spark: SparkSession, d: str) -> DataFrame:
    """Questions about red-flagged groups: one a group, or one a name where there are many."""
    t = _tables(spark, d)
    rows = t["questions"].where("sub_id % 3 = 0").select("sub_id", "suggestion", F.explode("entity_keys").alias("entity_key")).join(t["records"].where("red_flags > 0"), "entity_key").join(t["tiers"], "name")
    lean = F.when(F.min("suggestion") == F.max("suggestion"), F.min("suggestion"))
    groups = rows.groupBy("sub_id", "name", "state", "tier").agg(F.array_sort(F.collect_set("entity_key")).alias("entity_keys"), lean.alias("lean"), F.sum("red_flags").alias("red_flags"))
    return Q.questions_for(groups, 4).withColumn("entity_keys", F.array_join("entity_keys", ","))
