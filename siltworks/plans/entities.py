"""Entity resolution, evaluation and verdicts over the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.functions.names import name_core
from siltworks.functions.similarity import jaro_winkler
from siltworks.operators import evaluate as E, pools as PL, rows as R
from siltworks.resolve import addresses as AD, candidates as C, index as I, neighbours as NB, remap as M, rules as D
from siltworks.session import parts, table

from .marts import query
from .text import _CORE as _CORE_SQL

# Words made from a number: as many as there are customers. Of three customers with one word, the second leaves a letter out and
# the third swaps two or has another letter in a place.
_NUMBER = "CAST(floor(c_custkey / 3) AS BIGINT)"
_WORD = f"translate(left(md5(CAST({_NUMBER} AS STRING)), 8), '0123456789abcdef', 'ABCDEFGHIKLMNOPR')"
MADE = f"""CASE WHEN c_custkey % 3 = 0 THEN {_WORD} WHEN c_custkey % 3 = 1 THEN left({_WORD}, CAST(2 + {_NUMBER} % 6 AS INT)) || substr({_WORD}, CAST(4 + {_NUMBER} % 6 AS INT))
 WHEN {_NUMBER} % 2 = 0 THEN left({_WORD}, 4) || substr({_WORD}, 6, 1) || substr({_WORD}, 5, 1) || substr({_WORD}, 7) ELSE left({_WORD}, 5) || 'Z' || substr({_WORD}, 7) END"""
ENTITY = f"""SELECT md5(CAST(c_custkey AS STRING)) AS entity_key, c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(p_name) ELSE {MADE} END || CASE c_custkey % 5 WHEN 0 THEN ' ROOFING' WHEN 1 THEN ' ' || upper(p_type) WHEN 2 THEN ' GROUP' WHEN 3 THEN ' ' || substr(upper(p_name), 2, 4) || 'ING' ELSE '' END AS clean_name,
 CAST(c_nationkey % 7 AS STRING) AS state, CAST(c_nationkey AS STRING) AS city, CAST(10000 + CAST(floor(c_custkey / 40) AS BIGINT) AS STRING) AS zip5, CAST(c_custkey % 5 AS STRING) || ' MAIN' AS addr_key, c_custkey % 40 AS n
 FROM customer JOIN part ON p_partkey = c_custkey - c_custkey % 3 + 1"""
_ENTITY_SQL = "entity_ AS (" + ENTITY.replace("STRING", "VARCHAR") + f"), entity AS (SELECT *, {_CORE_SQL.replace('clean', 'clean_name')} AS name_core FROM entity_)"


#: entities that a task takes: each has several rows of words, keys or strata
ENTITIES_A_TASK = 100_000


def entity_parts(spark: SparkSession, d: str) -> int:
    return parts(spark, table(spark, d, "customer"), ENTITIES_A_TASK)


def entities(spark: SparkSession, d: str) -> DataFrame:
    df = spark.sql(ENTITY.replace("FROM customer JOIN part", "FROM {customer} customer JOIN {part} part"), customer=table(spark, d, "customer"), part=table(spark, d, "part"))
    return df.withColumn("name_core", name_core(F.col("clean_name")))


@query(f"WITH {_ENTITY_SQL}, t AS (SELECT DISTINCT entity_key, unnest(string_split(clean_name, ' ')) AS token FROM entity) SELECT token, count(*) AS df FROM t WHERE token <> '' GROUP BY 1")
def token_index_df(spark: SparkSession, d: str) -> DataFrame:
    return I.token_frequency(I.token_index(entities(spark, d)))


@query(f"""WITH {_ENTITY_SQL}, v AS (SELECT name_core, count(DISTINCT clean_name) AS varieties, count(DISTINCT state) AS states FROM entity GROUP BY 1)
SELECT *, CASE WHEN name_core = '' THEN 'generic' WHEN varieties <= 5 THEN 'distinctive' WHEN varieties >= 25 THEN 'generic' ELSE 'medium' END AS tier FROM v""")
def core_tiers(spark: SparkSession, d: str) -> DataFrame:
    return I.core_tiers(entities(spark, d).withColumn("is_person", F.lit(False)))


@query(f"WITH {_ENTITY_SQL} SELECT addr_key, zip5, count(DISTINCT name_core) AS cores, count(DISTINCT name_core) >= 6 AS is_shared FROM entity WHERE addr_key IS NOT NULL GROUP BY 1, 2")
def shared_address(spark: SparkSession, d: str) -> DataFrame:
    return I.shared_addresses(entities(spark, d))


@query(f"""WITH {_ENTITY_SQL}, t AS (SELECT DISTINCT unnest(string_split(clean_name, ' ')) AS token FROM entity)
SELECT a.token AS wanted_token, b.token FROM t a JOIN t b ON left(a.token, 1) = left(b.token, 1) AND abs(length(a.token) - length(b.token)) <= 3 WHERE a.token <> '' AND b.token <> '' AND (a.token = b.token OR jaro_winkler_similarity(a.token, b.token) >= 0.92)""")
def fuzzy_block_join(spark: SparkSession, d: str) -> DataFrame:
    """Alike tokens: blocked on the first letter, compared once for each distinct pair."""
    tokens = I.token_index(entities(spark, d)).select("token").distinct()
    return C.similar_tokens(tokens, tokens)


# filings of the same companies: some leave a letter out, some give another zip or address
_FILED = "CASE WHEN c_custkey % 4 = 1 THEN left(clean_name, 5) || substr(clean_name, 7) ELSE clean_name END AS name, state, CASE WHEN c_custkey % 6 = 2 THEN '99999' ELSE zip5 END AS zip5, CASE WHEN c_custkey % 7 = 3 THEN 'ELSEWHERE' ELSE addr_key END AS addr_key"


@query(f"""WITH {_ENTITY_SQL}, l AS (SELECT entity_key AS key, clean_name AS name, state, zip5, addr_key FROM entity), r AS (SELECT c_custkey AS ref_id, {_FILED} FROM entity),
u AS (SELECT key, ref_id, 'M1' AS method FROM l JOIN r USING (name, state, zip5) UNION SELECT key, ref_id, 'M2' FROM l JOIN r USING (name, state, addr_key)
 UNION SELECT key, ref_id, 'M3' FROM l JOIN r USING (addr_key, zip5, state) WHERE l.name <> r.name AND length(l.name) >= 5 AND length(r.name) >= 5 AND jaro_winkler_similarity(l.name, r.name) >= 0.93)
SELECT key, ref_id, min(method) AS method FROM u GROUP BY 1, 2""")
def fuzzy_ref_link(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    left = e.select(F.col("entity_key").alias("key"), F.col("clean_name").alias("name"), "state", "zip5", "addr_key")
    return C.exact_links(left, spark.sql(f"SELECT c_custkey AS ref_id, {_FILED} FROM {{e}}", e=e), parts=entity_parts(spark, d))


_SEARCH = f"""WITH {_ENTITY_SQL}, q AS (SELECT s_suppkey AS query_id, upper(p_name) || CASE s_suppkey % 3 WHEN 0 THEN ' ROOFING' WHEN 1 THEN '' ELSE ' BUILDERS' END AS q_name, CAST(s_nationkey % 7 AS VARCHAR) AS q_state FROM supplier JOIN part ON p_partkey = s_suppkey * 3 + 1),
q2 AS (SELECT *, {_CORE_SQL.replace('clean', 'q_name')} AS q_core FROM q),
w AS (SELECT DISTINCT query_id, unnest(string_split(q_name, ' ')) AS wanted FROM q), ix AS (SELECT DISTINCT entity_key, unnest(string_split(clean_name, ' ')) AS token FROM entity), fr AS (SELECT token, count(*) AS df FROM ix GROUP BY 1),
cl AS (SELECT DISTINCT wanted, token FROM (SELECT DISTINCT wanted FROM w) JOIN fr ON left(wanted, 1) = left(token, 1) AND abs(length(wanted) - length(token)) <= 3 WHERE wanted = token OR jaro_winkler_similarity(wanted, token) >= 0.92),
rare AS (SELECT query_id, wanted FROM w JOIN cl USING (wanted) JOIN fr USING (token) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sum(df), wanted) <= 2),
f AS (SELECT query_id, entity_key, 0 AS how FROM q2 JOIN entity ON q_name = clean_name UNION ALL SELECT query_id, entity_key, 1 FROM q2 JOIN entity ON q_core = name_core WHERE q_core <> '' UNION ALL SELECT query_id, entity_key, 2 FROM rare JOIN cl USING (wanted) JOIN ix USING (token)),
g AS (SELECT query_id, entity_key, min(how) AS how FROM f GROUP BY 1, 2),
s AS (SELECT g.query_id, g.entity_key, how, jaro_winkler_similarity(q_name, clean_name) AS sim, coalesce(q_state = state, false) AS home, n FROM g JOIN q2 USING (query_id) JOIN entity USING (entity_key))
SELECT query_id, entity_key, round(sim, 6) AS similarity, ['name', 'core', 'token'][how + 1] AS by FROM s WHERE how < 2 OR sim >= 0.8 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY home DESC, sim DESC, n DESC, entity_key) <= 20"""


@query(_SEARCH)
def candidate_search_topk(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    q = table(spark, d, "supplier").join(table(spark, d, "part"), F.col("p_partkey") == F.col("s_suppkey") * 3 + 1)
    name = F.concat(F.upper("p_name"), F.expr("CASE s_suppkey % 3 WHEN 0 THEN ' ROOFING' WHEN 1 THEN '' ELSE ' BUILDERS' END"))
    q = q.select(F.col("s_suppkey").alias("query_id"), name.alias("clean_name"), (F.col("s_nationkey") % 7).cast("string").alias("state")).withColumn("name_core", name_core(F.col("clean_name")))
    ix = I.token_index(e)
    return C.search(q, e, ix, I.token_frequency(ix), 20).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_ENTITY_SQL}, old AS (SELECT DISTINCT clean_name, state FROM entity WHERE c_custkey % 10 = 0)
SELECT c_custkey, row_number() OVER (PARTITION BY clean_name, state ORDER BY c_custkey) > 1 OR EXISTS (SELECT 1 FROM old o WHERE o.clean_name = e.clean_name AND o.state = e.state) AS is_duplicate FROM entity e WHERE c_custkey % 10 <> 0""")
def duplicate_entries(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    return R.duplicates(e.where("c_custkey % 10 != 0"), e.where("c_custkey % 10 = 0"), ["clean_name", "state"], [F.col("c_custkey")]).select("c_custkey", "is_duplicate")


_OLD_NEW = """dec AS (SELECT o_custkey AS decision_id, 'k' || o_custkey AS entity_key, list(o_orderkey) AS nrs FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
mem AS (SELECT CASE WHEN o_custkey % 4 = 0 THEN 'n' || o_custkey || '_' || (o_orderkey % 2) WHEN o_custkey % 4 = 1 THEN 'n' || (o_custkey - 1) ELSE 'k' || o_custkey END AS new_key, o_orderkey AS activity_nr FROM orders WHERE o_custkey % 11 <> 0)"""


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    dec = o.where("o_orderkey % 3 != 0").groupBy(F.col("o_custkey").alias("decision_id")).agg(F.collect_list("o_orderkey").alias("activity_nrs")).withColumn("entity_key", F.concat(F.lit("k"), F.col("decision_id").cast("string")))
    key = F.expr("CASE WHEN o_custkey % 4 = 0 THEN 'n' || o_custkey || '_' || (o_orderkey % 2) WHEN o_custkey % 4 = 1 THEN 'n' || (o_custkey - 1) ELSE 'k' || o_custkey END")
    return dec, o.where("o_custkey % 11 != 0").select(key.alias("new_key"), F.col("o_orderkey").alias("activity_nr"))


@query(f"""WITH {_OLD_NEW}, s AS (SELECT decision_id, new_key, count(*) AS shared FROM (SELECT decision_id, unnest(nrs) AS nr FROM dec) JOIN mem ON nr = activity_nr GROUP BY 1, 2),
b AS (SELECT decision_id, first(new_key ORDER BY shared DESC, new_key DESC) AS best, first(shared ORDER BY shared DESC, new_key DESC) AS shared, count(*) AS targets, list(new_key) AS keys FROM s GROUP BY 1),
a AS (SELECT dec.decision_id, entity_key AS old_key, CASE WHEN best IS NULL THEN 'release' WHEN list_contains(keys, entity_key) THEN 'keep' WHEN targets = 1 THEN 'carry' ELSE 'ask' END AS action, best, shared, targets FROM dec LEFT JOIN b USING (decision_id))
SELECT decision_id, old_key, action, CASE action WHEN 'keep' THEN old_key ELSE best END AS new_key, coalesce(shared, 0) AS shared, coalesce(targets, 0) AS targets FROM a""")
def remap_shared_members(spark: SparkSession, d: str) -> DataFrame:
    return M.follow(*_old_new(spark, d))


@query(f"WITH {_OLD_NEW}, s AS (SELECT DISTINCT decision_id FROM (SELECT decision_id, entity_key, unnest(nrs) AS nr FROM dec) JOIN mem ON nr = activity_nr WHERE new_key <> entity_key) SELECT decision_id, decision_id IN (SELECT decision_id FROM s) AS stale FROM dec")
def stale_by_members(spark: SparkSession, d: str) -> DataFrame:
    dec, mem = _old_new(spark, d)
    moved = M.shared_members(dec, mem).join(dec.select("decision_id", "entity_key"), "decision_id").where("new_key != entity_key").select("decision_id").distinct().withColumn("stale", F.lit(True))
    return dec.select("decision_id").join(moved, "decision_id", "left").select("decision_id", F.coalesce("stale", F.lit(False)).alias("stale"))


@query(f"""WITH {_ENTITY_SQL} SELECT a.c_custkey AS a, b.c_custkey AS b, CAST(a.name_core = b.name_core AS INTEGER) AS label FROM entity a JOIN entity b ON a.zip5 = b.zip5 AND a.addr_key = b.addr_key AND a.entity_key < b.entity_key""")
def silver_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).select("zip5", "addr_key", "entity_key", "c_custkey", "name_core")
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, ["zip5", "addr_key"]).where("a.entity_key < b.entity_key")
    return pairs.select(F.col("a.c_custkey").alias("a"), F.col("b.c_custkey").alias("b"), (F.col("a.name_core") == F.col("b.name_core")).cast("int").alias("label"))


# scores in thousandths, so that squares, and the halves that AUC counts, are whole numbers
_SCORED = "s AS (SELECT o_orderkey, o_orderkey * 7919 % 1000 AS score, CAST(o_orderkey * 31 % 1000 < o_orderkey * 7919 % 1000 AS INTEGER) AS label FROM orders)"


@query(f"""WITH {_SCORED}, g AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM s GROUP BY 1), w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
h AS (SELECT sum(pos * (2 * below + neg))::HUGEINT AS won, (2 * sum(pos) * sum(neg))::HUGEINT AS pairs FROM w),
a AS (SELECT ((2000000 * won + pairs) // (2 * pairs))::DOUBLE / 1000000 AS auc FROM h),
m AS (SELECT sum((score - 1000 * label) * (score - 1000 * label))::HUGEINT AS squares, count(*) AS n, sum(label)::BIGINT AS k FROM s)
SELECT auc, ((2 * squares + n) // (2 * n))::DOUBLE / 1000000 AS brier, n, k, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low FROM a, m""")
def auc_brier_wilson(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    s = o.select((F.col("o_orderkey") * 7919 % 1000 / 1000.0).alias("score"), (F.col("o_orderkey") * 31 % 1000 < F.col("o_orderkey") * 7919 % 1000).cast("int").alias("label"))
    m = s.agg(E.brier().alias("brier"), F.count("*").alias("n"), F.sum("label").alias("k"))
    low, _ = E.wilson(F.col("k"), F.col("n"))
    return E.auc(s).crossJoin(F.broadcast(m)).select("auc", "brier", "n", "k", F.round(low, 6).alias("low"))  # one row each


@query(f"""WITH {_ENTITY_SQL}, k AS (SELECT split_part(clean_name, ' ', 1) || split_part(clean_name, ' ', 2) AS name, count(*) AS n FROM entity GROUP BY 1), u AS (SELECT DISTINCT left(name, 3) || substr(name, 5) AS name FROM k WHERE length(name) >= 7),
p AS (SELECT u.name, k.name AS corrected, k.n FROM u JOIN k ON left(u.name, 2) = left(k.name, 2) AND u.name <> k.name AND k.n >= 3 AND abs(length(u.name) - length(k.name)) <= 1 AND jaro_winkler_similarity(u.name, k.name) >= 0.9)
SELECT name, first(corrected ORDER BY n DESC, corrected) AS corrected FROM p GROUP BY 1""")
def spelling_correction(spark: SparkSession, d: str) -> DataFrame:
    known = entities(spark, d).groupBy(F.expr("split_part(clean_name, ' ', 1) || split_part(clean_name, ' ', 2)").alias("name")).agg(F.count("*").alias("n"))
    unknown = known.where("length(name) >= 7").select(F.expr("left(name, 3) || substr(name, 5)").alias("name")).distinct().withColumn("n", F.lit(0))
    return C.correct_spelling(unknown, known, least_n=3)


@query(f"""WITH {_ENTITY_SQL} SELECT a.c_custkey AS a, b.c_custkey AS b, round(jaro_winkler_similarity(a.clean_name, b.clean_name), 6) AS similarity FROM entity a JOIN entity b ON a.addr_key = b.addr_key AND a.zip5 = b.zip5 AND a.c_custkey < b.c_custkey WHERE a.clean_name <> b.clean_name""")
def similarity_at_address(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).select("addr_key", "zip5", "c_custkey", "clean_name")
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, ["addr_key", "zip5"]).where("a.c_custkey < b.c_custkey and a.clean_name != b.clean_name")
    return pairs.select(F.col("a.c_custkey").alias("a"), F.col("b.c_custkey").alias("b"), F.round(jaro_winkler(F.col("a.clean_name"), F.col("b.clean_name")), 6).alias("similarity"))


@query(f"""WITH {_ENTITY_SQL}, t AS (SELECT DISTINCT unnest(string_split(clean_name, ' ')) AS token FROM entity)
SELECT a.token AS a, b.token AS b, CASE WHEN length(a.token) <> length(b.token) THEN 'gap' WHEN hamming(a.token, b.token) = 1 THEN 'letter' ELSE 'swap' END AS how
FROM t a JOIN t b ON a.token < b.token AND abs(length(a.token) - length(b.token)) <= 1 WHERE damerau_levenshtein(a.token, b.token) = 1""")
def one_edit_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Words one edit or swap apart, over all words of all names."""
    return NB.one_edit(I.token_index(entities(spark, d)).select(F.col("token").alias("name")), entity_parts(spark, d))


# what users type: a customer's word with a letter twice, or two swapped, in its own city
_TYPED = "CASE WHEN c_custkey % 6 = 1 THEN left(w, 5) || substr(w, 5) WHEN c_custkey % 6 = 3 THEN left(w, 4) || substr(w, 6, 1) || substr(w, 5, 1) || substr(w, 7) ELSE w END"


@query(f"""WITH {_ENTITY_SQL}, r AS (SELECT split_part(clean_name, ' ', 1) AS name, state, city FROM entity WHERE c_custkey % 2 = 1),
q AS (SELECT query_id, {_TYPED} AS name, state, city FROM (SELECT c_custkey AS query_id, c_custkey, split_part(clean_name, ' ', 1) AS w, state, CAST((CAST(city AS BIGINT) + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) % 25 AS VARCHAR) AS city FROM entity)),
t AS (SELECT name, count(*) <= 3 AS rare FROM r GROUP BY 1),
p AS (SELECT DISTINCT query_id, r.name AS found FROM q JOIN r USING (state, city) WHERE q.name NOT IN (SELECT name FROM r) AND damerau_levenshtein(q.name, r.name) = 1 AND left(q.name, 3) = left(r.name, 3)
  AND (length(q.name) <> length(r.name) OR hamming(q.name, r.name) = 2) AND least(length(q.name), length(r.name)) >= 7 AND NOT regexp_matches(q.name || r.name, '[0-9 ]'))
SELECT query_id, min(found) AS corrected FROM p GROUP BY 1 HAVING count(*) = 1 AND (SELECT rare FROM t WHERE name = min(found))""")
def city_spelling(spark: SparkSession, d: str) -> DataFrame:
    """A typed name that stands nowhere, and the one rare name a slip away in its city."""
    e = entities(spark, d).withColumn("w", F.split_part("clean_name", F.lit(" "), F.lit(1)))
    records = e.where("c_custkey % 2 = 1").select(F.col("w").alias("name"), "state", "city")
    moved = F.expr("CAST((CAST(city AS BIGINT) + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) % 25 AS STRING)")
    queries = e.select(F.col("c_custkey").alias("query_id"), F.expr(_TYPED).alias("name"), "state", moved.alias("city"))
    tiers = records.groupBy("name").agg(F.when(F.count("*") <= 3, "distinctive").otherwise("medium").alias("tier"))
    return NB.spelling_in_city(queries, records, tiers)


@query(f"""WITH {_ENTITY_SQL} SELECT clean_name, c_custkey, n FROM entity QUALIFY row_number() OVER (PARTITION BY clean_name ORDER BY n DESC, c_custkey) <= 2""")
def named_topk(spark: SparkSession, d: str) -> DataFrame:
    """The largest entities of each name."""
    e = entities(spark, d).select("clean_name", "c_custkey", "n")
    return R.top_k(e, ["clean_name"], [F.desc("n"), F.col("c_custkey")], 2)


@query(f"""WITH {_ENTITY_SQL}, q AS (SELECT s_suppkey AS query_id, CAST(s_suppkey % 5 AS VARCHAR) || ' MAIN' AS addr_key, CAST(10000 + s_suppkey % 7 AS VARCHAR) AS zip5, CASE s_suppkey % 3 WHEN 0 THEN NULL ELSE 'STE ' || (s_suppkey % 3) END AS unit FROM supplier),
u AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'STE 1' WHEN 1 THEN 'STE 2' END AS c_unit FROM entity)
SELECT query_id, c_custkey FROM q JOIN u ON q.addr_key = u.addr_key AND left(q.zip5, 3) = left(u.zip5, 3) WHERE unit IS NULL OR c_unit IS NULL OR unit = c_unit""")
def pooled_address_join(spark: SparkSession, d: str) -> DataFrame:
    """All entities at a query's address; a unit that one side lacks doesn't part them."""
    unit = F.expr("CASE s_suppkey % 3 WHEN 0 THEN NULL ELSE 'STE ' || (s_suppkey % 3) END")
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat((F.col("s_suppkey") % 5).cast("string"), F.lit(" MAIN")).alias("addr_key"), F.left((10000 + F.col("s_suppkey") % 7).cast("string"), F.lit(3)).alias("z3"), unit.alias("unit"))
    e = entities(spark, d).select("c_custkey", "addr_key", F.left("zip5", F.lit(3)).alias("z3"), F.expr("CASE c_custkey % 4 WHEN 0 THEN 'STE 1' WHEN 1 THEN 'STE 2' END").alias("own_unit"))
    return AD.all_at(q, e, ["addr_key", "z3"]).select("query_id", "c_custkey")


# every other entity has a small building of its own, beside offices that many share
_SPREAD = "CASE WHEN c_custkey % 2 = 0 THEN addr_key || ' ' || CAST(c_custkey % 3 AS STRING) ELSE addr_key END AS addr_key"
_BUILDING_SQL = f"""WITH {_ENTITY_SQL}, e AS (SELECT entity_key, c_custkey, clean_name, name_core, {_SPREAD.replace('STRING', 'VARCHAR')}, zip5, left(zip5, 3) AS zip3, CASE c_custkey % 4 WHEN 0 THEN 'STE 1' WHEN 1 THEN 'STE 2' END AS unit, n FROM entity),
sh AS (SELECT addr_key, zip5, count(DISTINCT name_core) >= 6 AS is_shared FROM e GROUP BY 1, 2), w AS (SELECT c_custkey AS query_id, addr_key, zip3, unit, clean_name, name_core FROM e WHERE c_custkey < 200),
f AS (SELECT w.query_id, e.entity_key, e.clean_name, e.name_core, w.clean_name AS q_name, w.name_core AS q_core, e.n, coalesce(is_shared, false) AS is_shared FROM w JOIN e ON w.addr_key = e.addr_key AND w.zip3 = e.zip3 LEFT JOIN sh ON sh.addr_key = e.addr_key AND sh.zip5 = e.zip5 WHERE w.unit IS NULL OR e.unit IS NULL OR w.unit = e.unit)"""


def _buildings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    e = entities(spark, d).select("entity_key", "c_custkey", "clean_name", "name_core", F.expr(_SPREAD), "zip5", F.expr("CASE c_custkey % 4 WHEN 0 THEN 'STE 1' WHEN 1 THEN 'STE 2' END").alias("unit"), "n")
    shared = e.groupBy("addr_key", "zip5").agg((F.countDistinct("name_core") >= 6).alias("is_shared"))
    w = e.where("c_custkey < 200")  # the stated queries
    names = w.select(F.col("c_custkey").alias("query_id"), F.explode(F.array("clean_name", "name_core")).alias("name"))
    return w.select(F.col("c_custkey").alias("query_id"), "addr_key", F.left("zip5", F.lit(3)).alias("zip3"), "unit"), e, shared, names


@query(_BUILDING_SQL + """ SELECT DISTINCT query_id, entity_key, 'building' AS mode FROM f WHERE NOT is_shared UNION SELECT DISTINCT query_id, entity_key, 'cores' FROM f WHERE is_shared AND name_core <> '' AND name_core IN (q_name, q_core)
 UNION SELECT DISTINCT query_id, entity_key, 'extending' FROM f WHERE is_shared AND ((q_name <> '' AND (starts_with(clean_name, q_name || ' ') OR starts_with(name_core, q_name || ' '))) OR (q_core <> '' AND (starts_with(clean_name, q_core || ' ') OR starts_with(name_core, q_core || ' '))))""")
def address_modes(spark: SparkSession, d: str) -> DataFrame:
    """Entities in a query's building: any, and at shared offices those of its core or with its name and more words."""
    wanted, e, shared, names = _buildings(spark, d)
    parts = {"building": AD.at_addresses(wanted, e, shared), "cores": AD.at_addresses(wanted, e, shared, names), "extending": AD.at_addresses(wanted, e, shared, names, extending=True)}
    return R.union_all([df.withColumn("mode", F.lit(mode)) for mode, df in parts.items()])


@query(_BUILDING_SQL + " SELECT query_id, entity_key, n FROM (SELECT DISTINCT query_id, entity_key, n FROM f WHERE NOT is_shared) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, entity_key) <= 3")
def listed_addresses(spark: SparkSession, d: str) -> DataFrame:
    wanted, e, shared, _ = _buildings(spark, d)
    return AD.at_listed(wanted, e, shared, 3)


@query(f"""WITH {_ENTITY_SQL}, p AS (SELECT a.c_custkey AS query_id, b.entity_key, CASE b.c_custkey % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'uncertain' ELSE 'excluded' END AS bucket, round(jaro_winkler_similarity(a.clean_name, b.clean_name), 6) AS similarity FROM entity a JOIN entity b ON a.addr_key = b.addr_key AND a.zip5 = b.zip5 AND a.c_custkey <> b.c_custkey)
SELECT * FROM p QUALIFY bucket = 'matched' OR row_number() OVER (PARTITION BY query_id, bucket ORDER BY similarity DESC, entity_key) <= CASE bucket WHEN 'excluded' THEN 1 ELSE 2 END""")
def closest_per_bucket(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d).select("addr_key", "zip5", "c_custkey", "clean_name", "entity_key")
    a, b = e.alias("a"), e.alias("b")
    bucket = F.expr("CASE b.c_custkey % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'uncertain' ELSE 'excluded' END")
    pairs = a.join(b, ["addr_key", "zip5"]).where("a.c_custkey != b.c_custkey").select(F.col("a.c_custkey").alias("query_id"), F.col("b.entity_key").alias("entity_key"), bucket.alias("bucket"), F.round(jaro_winkler(F.col("a.clean_name"), F.col("b.clean_name")), 6).alias("similarity"))
    return AD.keep_closest(pairs, {"excluded": 1, "uncertain": 2})


@query(f"WITH {_ENTITY_SQL}, k AS (SELECT DISTINCT entity_key FROM entity WHERE n > 30) SELECT clean_name, state, sum(n)::BIGINT AS n, count(*) AS entities FROM entity JOIN k USING (entity_key) GROUP BY 1, 2")
def facts_of_keys(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a given set of entities."""
    e = entities(spark, d)
    return AD.of_entities(e, e.where("n > 30")).groupBy("clean_name", "state").agg(F.sum("n").alias("n"), F.count("*").alias("entities"))


_STRATA = {"general": ("true", 30), "roofers": ("clean_name LIKE '%ROOFING'", 10), "groups": ("clean_name LIKE '% GROUP'", 10), "many": ("n > 30", 10), "no core": ("name_core = ''", 10), "one place": ("zip5 = '10001'", 10), "east": ("state = '1'", 10), "shared": ("addr_key = '1 MAIN' AND n < 10", 10)}
_DRAWN = " UNION ALL ".join(f"SELECT * FROM (SELECT entity_key, '{name}' AS pool, {k} AS k FROM entity WHERE {where} ORDER BY md5(entity_key || '|{name}|7') LIMIT {n})" for k, (name, (where, n)) in enumerate(_STRATA.items()))


@query(f"WITH {_ENTITY_SQL}, d AS ({_DRAWN}) SELECT entity_key, first(pool ORDER BY k) AS pool FROM d GROUP BY 1")
def evaluation_pools(spark: SparkSession, d: str) -> DataFrame:
    """Entities drawn for eight overlapping strata in one pass."""
    strata = {name: (F.expr(where), n) for name, (where, n) in _STRATA.items()}
    e = entities(spark, d).select("entity_key", "clean_name", "name_core", "n", "zip5", "state", "addr_key").repartition(entity_parts(spark, d), "entity_key")
    return PL.draw(e, "entity_key", strata, 7).select("entity_key", "pool")


@query(f"""WITH {_ENTITY_SQL}, w AS (SELECT *, list_reduce(list_prepend('', string_split(name_core, ' ')), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS w, md5(entity_key || '|typo|3') AS h FROM entity),
p AS (SELECT *, CAST(('0x' || h[1:8])::BIGINT % (length(w) - 4) + 4 AS INT) AS i, ('0x' || h[9:16])::BIGINT % 3 AS kind FROM w WHERE length(w) >= 5),
t AS (SELECT *, CASE kind WHEN 0 THEN left(w, i - 1) || substr(w, i + 1) WHEN 1 THEN left(w, i) || substr(w, i) ELSE left(w, i - 1) || substr(w, i + 1, 1) || substr(w, i, 1) || substr(w, i + 2) END AS slip FROM p)
SELECT entity_key, array_to_string(list_transform(list_filter(string_split(clean_name, ' '), lambda x: x <> ''), lambda x: CASE WHEN x = w THEN slip ELSE x END), ' ') AS typo FROM t WHERE slip <> w""")
def typo_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every entity's name with a slip in it, drawn by its key."""
    return PL.typos(entities(spark, d), "entity_key", "clean_name", "name_core", 3).select("entity_key", "typo")


_LISTED = "SELECT CASE WHEN c_custkey % 3 = 2 THEN left(w, 5) || 'Q' || substr(w, 7) ELSE left(w, 3) || substr(w, 5) END AS name, state, city, CASE WHEN c_custkey % 2 = 0 THEN addr_key ELSE 'ELSEWHERE' END AS addr_key FROM e WHERE c_custkey % 3 > 0"
_KNOWN = "SELECT w AS name, state, city, addr_key FROM e"


@query(f"""WITH {_ENTITY_SQL}, e AS (SELECT *, split_part(clean_name, ' ', 1) AS w FROM entity), l AS ({_LISTED}), r AS ({_KNOWN}), t AS (SELECT name FROM r GROUP BY 1 HAVING count(*) <= 5),
h AS (SELECT DISTINCT l.name, state, city, r.name AS found FROM l JOIN r USING (state, city) WHERE l.name <> '' AND r.name <> '' AND r.name IN (SELECT name FROM t) AND l.name NOT IN (SELECT name FROM r) AND damerau_levenshtein(l.name, r.name) = 1),
o AS (SELECT name, state, city, min(found) AS found FROM h GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT o.*, EXISTS (SELECT 1 FROM l JOIN r USING (state, city, addr_key) WHERE l.name = o.name AND r.name = o.found AND state = o.state AND city = o.city) AS same_address FROM o""")
def lookalike_names(spark: SparkSession, d: str) -> DataFrame:
    """Listed names that look like one record's in their city, and whether they are at its address."""
    e = entities(spark, d).withColumn("w", F.split_part("clean_name", F.lit(" "), F.lit(1)))
    listed, known = (spark.sql(sql.replace("FROM e", "FROM {e}"), e=e) for sql in (_LISTED, _KNOWN))
    tiers = known.groupBy("name").agg(F.when(F.count("*") <= 5, "distinctive").otherwise("medium").alias("tier"))
    return NB.lookalikes(listed, known, tiers)
