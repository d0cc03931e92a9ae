"""The rule cascade over pairs made from customers, and the same rules as SQL.

Thirty-four customers make a group with a query and as many candidates: each candidate's name changes the query's in another way, places,
trades and flags go by other remainders, so with the number of groups all ways out of the cascade come up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.functions import names as N
from siltworks.resolve import index as I, rivals as RV, rules as D
from siltworks.session import parts, table

from .marts import query

GIVEN = ("JOHN", "JAMES", "JON", "ANNA")


#: customers whose pairs a task judges
PAIRS_A_TASK = 20_000


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _made(number: str) -> str:
    return f"translate(left(md5(CAST({number} AS STRING)), 8), '0123456789abcdef', 'ABCDEFGHIKLMNOPR')"


_G, _V = "CAST(floor(c_custkey / 34) AS BIGINT)", "c_custkey % 34"
_BASE = f"SELECT c_custkey AS pair, {_G} AS g, {_V} AS v, {_made(_G)} AS w, {_made(f'-1 - {_G}')} AS w2 FROM customer"
_QUERY = """SELECT *, CASE g % 6 WHEN 0 THEN w WHEN 1 THEN w || ' CONSTRUCTION' WHEN 2 THEN 'JOHN ' || w WHEN 3 THEN w || ' ROOFING' WHEN 4 THEN 'BEST ROOFING' ELSE w || CASE g % 4 WHEN 1 THEN ' OF OHIO' ELSE ' BUILDERS' END END AS q_name,
 CASE g % 6 WHEN 2 THEN 'person' WHEN 3 THEN 'medium' WHEN 4 THEN 'generic' ELSE 'distinctive' END AS q_tier, CASE g % 5 WHEN 4 THEN NULL ELSE 'TX' END AS q_state, CASE g % 7 WHEN 0 THEN 'SAINT LOUIS' WHEN 1 THEN NULL ELSE 'DALLAS' END AS q_city,
 CASE g % 3 WHEN 0 THEN 'Roofing' WHEN 1 THEN 'electrical work' END AS q_trade, g % 13 = 5 AS q_initials, g % 4 < 2 AS q_incorporated FROM b"""
_PAIR = """SELECT *, CASE v WHEN 0 THEN q_name WHEN 1 THEN q_name || ' SERVICES' WHEN 2 THEN q_name || ' GROUP' WHEN 3 THEN left(q_name, 6) || substr(q_name, 8) WHEN 4 THEN left(q_name, 6) || substr(q_name, 8, 1) || substr(q_name, 7, 1) || substr(q_name, 9)
 WHEN 5 THEN q_name || ' BRANCH 2' WHEN 6 THEN q_name || ' OF TEXAS' WHEN 7 THEN q_name || ' TEXAS' WHEN 8 THEN q_name || ' ' || w2 WHEN 9 THEN q_name || ' JV' WHEN 10 THEN w2 || ' ROOFING' WHEN 11 THEN w || ' PLUMBING'
 WHEN 12 THEN w || ' FRAMING' WHEN 13 THEN 'JAMES ' || w WHEN 14 THEN 'JOHN ' || w || ' JR' WHEN 15 THEN 'JON ' || w WHEN 16 THEN q_name || ' PAINTING' WHEN 17 THEN 'QUALITY ROOFING' WHEN 18 THEN 'BEST ROOFING' WHEN 19 THEN w
 WHEN 20 THEN w || ' ' || w2 WHEN 21 THEN q_name WHEN 22 THEN 'ABC' WHEN 23 THEN q_name || ' AT DALLAS' WHEN 24 THEN left(q_name, 6) || substr(q_name, 8) || ' OF TEXAS' WHEN 25 THEN left(q_name, 5) || substr(q_name, 7) || ' WELDING'
 WHEN 26 THEN q_name || ' DALLAS' WHEN 27 THEN q_name WHEN 28 THEN q_name || ' CONTRACTORS' WHEN 29 THEN w || ' HOMES' WHEN 30 THEN q_name || ' OF OREGON' WHEN 31 THEN q_name || ' OF NEVADA' WHEN 32 THEN q_name || ' SERVICES OF IDAHO' ELSE q_name END AS c_name,
 CASE WHEN (v + g) % 11 = 0 THEN NULL WHEN (v * 7 + g) % 4 = 0 THEN 'OK' ELSE 'TX' END AS c_state, CASE (v * 5 + g) % 6 WHEN 0 THEN 'St. Louis' WHEN 1 THEN 'DALLAZ' WHEN 2 THEN NULL WHEN 3 THEN 'WACO' ELSE 'Dallas' END AS c_city,
 CASE (v + g) % 5 WHEN 0 THEN '2381' WHEN 1 THEN '2382' WHEN 2 THEN '2362' END AS c_industry, (v + 2 * g) % 9 = 0 AS c_other_kind, (v * 3 + g) % 4 = 1 AS c_at_address, g % 2 = 0 AND v % 2 = 0 AS c_incorporated, v = 22 AS c_initials,
 CASE WHEN v % 10 <> 9 THEN 'A' || CAST(CAST(floor(v / 6) AS INT) + g % 3 AS STRING) END AS c_address, CASE WHEN v % 9 <> 7 THEN '75' || CAST(g % 3 AS STRING) END AS c_zip3, (v * 3 + g) % 4 AS red_flags, (v * 5 + g) % 19 = 3 AS by_licence FROM q"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """One row a customer: a query's attributes (q_) and a candidate's (c_), described as :func:`siltworks.resolve.rules.decide` reads them."""
    customer = table(spark, d, "customer")
    # a small file is read by few tasks, and pairs cost far more than reading
    dealt = customer.repartition(parts(spark, customer, PAIRS_A_TASK), "c_custkey")
    b = spark.sql(_BASE.replace("FROM customer", "FROM {customer}"), customer=dealt)
    q = spark.sql(_QUERY.replace("FROM b", "FROM {b}"), b=b)
    p = spark.sql(_PAIR.replace("FROM q", "FROM {q}"), q=q)
    c, asked = F.col("c_name"), F.col("q_name")
    return p.withColumns({
        "q_core": N.name_core(asked), "c_core": N.name_core(c), "q_suffix": N.place_suffix(asked), "c_suffix": N.place_suffix(c),
        "c_jv": N.is_joint_venture(c), "c_person": F.split_part(c, F.lit(" "), F.lit(1)).isin(*GIVEN),
    })


# The rules' questions in SQL. Arguments are expressions; lists of words are lists of strings.
def _words(x: str) -> str:
    return f"list_filter(string_split(coalesce({x}, ''), ' '), lambda w: w <> '')"


def _core(x: str) -> str:
    return f"array_to_string(list_filter({_words(x)}, lambda w: w NOT IN ({_listed(N.GENERIC)})), ' ')"


def _suffix(x: str) -> str:
    return rf"nullif(regexp_extract({x}, '\s(OF|AT)\s+[A-Z0-9 ]+$', 0), '')"


def _less(a: str, b: str) -> str:
    return f"list_filter(list_distinct({a}), lambda w: NOT list_contains({b}, w))"


def _only(a: str, b: str, allowed) -> str:
    return f"len(list_filter(list_concat({_less(a, b)}, {_less(b, a)}), lambda w: w NOT IN ({_listed(allowed)}))) = 0"


def _near(x: str, y: str) -> str:
    return f"(jaro_winkler_similarity({x}, {y}) >= 0.9 AND abs(length({x}) - length({y})) <= 1)"


def _typo(a: str, b: str) -> str:
    x, y = _words(a), _words(b)
    by_word = f"(len({x}) = len({y}) AND list_bool_and(list_transform(list_zip({x}, {y}), lambda p: {_near('p[1]', 'p[2]')})))"
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR coalesce({by_word}, false) OR (abs(length({a}) - length({b})) <= 1 AND jaro_winkler_similarity({a}, {b}) >= 0.94)))"


def _lone(a: str, b: str) -> str:
    x, y = _words(a), _words(b)
    return f"len(list_filter({_less(x, y)}, lambda w: w NOT IN ({_listed(N.GENERIC)}) AND NOT coalesce(list_bool_or(list_transform({y}, lambda o: {_near('w', 'o')})), false))) > 0"


def _swap(a: str, b: str) -> str:
    trade = _listed(w for w in N.GENERIC if w not in N.DESCRIPTORS)
    own, other = (f"list_filter({_less(x, y)}, lambda w: w IN ({trade}))" for x, y in ((a, b), (b, a)))
    heads = lambda x: f"list_transform({x}, lambda w: left(w, 4))"
    return f"(len({own}) > 0 AND len({other}) > 0 AND NOT list_has_any({heads(own)}, {heads(other)}))"


def _city(x: str) -> str:
    out = f"' ' || trim(upper(coalesce({x}, ''))) || ' '"
    for long, short in D.CITY_ABBREVIATIONS:
        out = f"replace({out}, ' {long}', ' {short}')"
    return f"regexp_replace({out}, '[^A-Z0-9]', '', 'g')"


def _added(name: str, base: str) -> str:
    return f"CASE WHEN {base} <> '' AND starts_with({name}, {base} || ' ') THEN {_words(f'substr({name}, length({base}) + 1)')} ELSE [] END"


def _bare(core: str, suffix: str) -> str:
    place = f"array_to_string(list_filter({_words(suffix)}, lambda w: w NOT IN ({_listed(N.GENERIC)})), ' ')"
    return f"CASE WHEN {place} <> '' AND ends_with({core}, ' ' || {place}) THEN left({core}, length({core}) - length({place}) - 1) ELSE {core} END"


def _set(x: str, allowed) -> str:
    return f"list_sort(list_distinct(list_filter({_words(x)}, lambda w: w IN ({_listed(allowed)}))))"


def _industries(x: str) -> str:
    named = ", ".join(f"CASE WHEN regexp_matches(lower(trim({x})), '{words.replace(chr(39), chr(39) * 2)}') THEN [{_listed(codes)}] ELSE [] END" for words, codes in D.TRADES)
    return f"flatten([{named}])"


_SHORT = "CASE c_state " + " ".join(f"WHEN '{s}' THEN [{_listed(x)}]" for s, x in D.STATE_NAMES.items()) + " ELSE [] END"


def decided_sql(source: str, keep: str, tag: str = "") -> str:
    """CTEs that end in ``decided<tag>(keep, bucket, rule_id)``, from a CTE ``source`` with the columns of :func:`pairs` but the described ones."""
    given = _listed(GIVEN)
    extra = _listed(w for w in N.GENERIC if len(w) > 1 and w not in D.NAME_JOINS)
    company = lambda n, c: f"len(list_filter({_less(_words(n), _words(c))}, lambda w: w IN ({extra}))) > 0"
    rules = [
        ("S1", "uncertain", "q_suffix IS DISTINCT FROM c_suffix AND (core_equal OR same_full OR typo OR (typo_base AND (q_tier IN ('distinctive', 'medium') OR same_state)))"),
        ("S2", "uncertain", f"len(list_filter(rest, lambda w: w IN ({_listed(D.BRANCH_WORDS)}))) > 0"),
        ("M1", None, "m1"), ("M1b", None, "m1b"),
        ("J1", "uncertain", "(m2 OR s3) AND venture"),
        ("U3", "uncertain", "near_only AND swap"),
        ("P2", "uncertain", "near_only AND (person OR c_person) AND people"),
        ("M2", None, "m2"),
        ("S3", "uncertain", "s3"),
        ("P3", "uncertain", "a_person AND ((known_states AND NOT same_state) OR (known_cities AND NOT same_city)) AND (same_full OR descriptor) AND companies"),
        ("X5", "excluded", "a_person AND known_states AND NOT same_state"),
        ("P1", "uncertain", "a_person AND known_cities AND NOT same_city AND like_city"),
        ("X5", "excluded", "a_person AND known_cities AND NOT same_city"),
        ("P1", "uncertain", "a_person"),
        ("M3", None, "(same_full OR descriptor) AND NOT same_state AND distinctive"),
        ("U3", "uncertain", "generic AND NOT descriptor AND distinctive"),
        ("S4", "uncertain", "NOT person AND len(place) > 0 AND names_place"),
        ("X1", "excluded", "q_core <> '' AND c_core <> '' AND NOT core_equal AND NOT typo AND lone"),
        ("X2", "excluded", "q_core = '' AND c_core = '' AND NOT same_full"),
        ("U4", "uncertain", "q_core = '' AND same_full AND known_states AND NOT same_state AND NOT at_it"),
        ("U2", "uncertain", "NOT distinctive AND NOT same_full AND same_state AND (same_city OR at_it)"),
        ("X3", "excluded", "NOT distinctive AND NOT same_full"),
        ("G1", "uncertain", "q_initials OR c_initials"),
    ]
    cases = []
    for rule, bucket, holds in rules:
        if bucket:
            cases.append(f"WHEN {holds} THEN '{bucket} {rule}'")
        else:
            cases += [f"WHEN ({holds}) AND clash THEN 'uncertain {rule}_trade'", f"WHEN ({holds}) AND other_kind AND NOT at_it THEN 'uncertain N1'", f"WHEN {holds} THEN 'matched {rule}'"]
    said = "array_to_string(place, ' ')"
    return rf"""n0{tag}_ AS (SELECT *, {_core('q_name')} AS q_core, {_core('c_name')} AS c_core, {_suffix('q_name')} AS q_suffix, {_suffix('c_name')} AS c_suffix, split_part(c_name, ' ', 1) IN ({given}) AS c_person FROM {source}),
n1{tag}_ AS (SELECT *, {_words('q_name')} AS qw, {_words('c_name')} AS cw, {_bare('q_core', 'q_suffix')} AS q_base, {_bare('c_core', 'c_suffix')} AS c_base, {_city('q_city')} AS qk, {_city('c_city')} AS ck, {_added('c_name', 'q_name')} AS rest, {_added('c_core', 'q_core')} AS core_rest,
 c_name = q_name AS same_full, q_core <> '' AND c_core = q_core AS core_equal, coalesce(q_state <> '' AND c_state <> '', false) AS known_states, coalesce(q_state <> '' AND c_state = q_state, false) AS same_state, coalesce(q_city <> '' AND c_city <> '', false) AS known_cities,
 q_tier = 'distinctive' AS distinctive, q_tier = 'person' AS person, coalesce(c_at_address, false) AS at_it, coalesce(c_other_kind, false) AS other_kind, regexp_matches(q_name, '\b(JV|JOINT VENTURE)\b') <> regexp_matches(c_name, '\b(JV|JOINT VENTURE)\b') AS venture, {_industries('q_trade')} AS wanted FROM n0{tag}_),
n2{tag}_ AS (SELECT *, known_cities AND qk = ck AS same_city, {_typo('q_core', 'c_core')} AS typo, {_typo('q_base', 'c_base')} AS typo_base, core_equal AND {_only('qw', 'cw', N.GENERIC)} AS generic, core_equal AND {_only('qw', 'cw', N.DESCRIPTORS)} AS descriptor, {_only('qw', 'cw', N.GENERIC)} AS only_generic,
 {_swap('qw', 'cw')} AS swap, {_lone('q_core', 'c_core')} OR {_lone('c_core', 'q_core')} AS lone, jaro_winkler_similarity(q_name, c_name) >= {D.SPELLING} AS alike, coalesce(jaro_winkler_similarity(qk, ck) >= {D.CITY_SPELLING}, false) AND known_cities AS like_city,
 coalesce(len(wanted) > 0 AND list_bool_and(list_transform(wanted, lambda w: starts_with(w, '238'))) AND starts_with(c_industry, '238') AND NOT list_contains(wanted, c_industry), false) AS clash,
 CASE WHEN len(rest) > 0 THEN rest ELSE core_rest END AS extended, CASE WHEN len(rest) > 0 THEN rest WHEN distinctive THEN core_rest ELSE [] END AS place,
 ({company('q_name', 'q_core')} AND {company('c_name', 'c_core')}) OR coalesce(q_incorporated AND c_incorporated, false) AS companies,
 {_set('q_name', D.GENERATIONS)} <> {_set('c_name', D.GENERATIONS)} OR (len({_set('q_name', GIVEN)}) > 0 AND len({_set('c_name', GIVEN)}) > 0 AND len(list_filter({_set('q_name', GIVEN)}, lambda p: len(list_filter({_set('c_name', GIVEN)}, lambda o: starts_with(p, o) OR starts_with(o, p) OR {_near('p', 'o')})) > 0)) = 0) AS people FROM n1{tag}_),
n3{tag}_ AS (SELECT *, same_full AND same_state AND (distinctive OR same_city) AS m1, descriptor AND same_state AND distinctive AS m1b, at_it AND (same_full OR descriptor OR alike OR (typo AND NOT core_equal AND only_generic)) AS m2, at_it AND len(list_filter(extended, lambda w: w NOT IN ({_listed(N.GENERIC)}))) > 0 AS s3,
 person AND (same_full OR core_equal) AS a_person, {said} IN ({_listed(D.FULL_STATES)}) OR coalesce({said} = c_state, false) OR list_contains({_SHORT}, {said}) OR coalesce(c_city <> '' AND {_city(said)} = ck, false) AS names_place FROM n2{tag}_),
n4{tag}_ AS (SELECT *, m2 AND NOT (same_full OR descriptor) AS near_only FROM n3{tag}_),
decided{tag} AS (SELECT {keep}, split_part(_d, ' ', 1) AS bucket, split_part(_d, ' ', 2) AS rule_id FROM (SELECT *, CASE {' '.join(cases)} ELSE 'uncertain U' END AS _d FROM n4{tag}_))"""


_PAIRS_SQL = f"b AS ({_BASE}), q AS ({_QUERY}), p AS ({_PAIR})".replace("STRING", "VARCHAR")
_OWN = "pair, g, v, q_name, q_tier, q_state, q_city, q_trade, q_initials, q_incorporated, c_name, c_state, c_city, c_industry, c_other_kind, c_at_address, c_incorporated, c_initials, c_address, c_zip3, red_flags, by_licence"


def _expanded(k: int) -> str:
    """What another pass over addresses makes of ``decided<k>``: ends in ``decided<k + 1>``."""
    raised = "old_bucket <> 'matched' AND (bucket = 'matched' OR (old_bucket = 'excluded' AND bucket = 'uncertain'))"
    return f"""a{k} AS (SELECT d.* EXCLUDE (c_at_address, bucket, rule_id), coalesce(c_at_address, false) OR EXISTS (SELECT 1 FROM decided{k} o WHERE o.g = d.g AND o.c_address = d.c_address AND o.bucket = 'matched') AS c_at_address, d.bucket AS old_bucket, d.rule_id AS old_rule FROM decided{k} d),
{decided_sql(f"a{k}", f"{_OWN}, old_bucket, old_rule", f"x{k}")},
decided{k + 1} AS (SELECT * EXCLUDE (bucket, rule_id, old_bucket, old_rule), CASE WHEN {raised} THEN bucket ELSE old_bucket END AS bucket, CASE WHEN {raised} THEN rule_id ELSE old_rule END AS rule_id FROM decidedx{k})"""


@query(f"WITH {_PAIRS_SQL}, {decided_sql('p', 'pair')} SELECT * FROM decided")
def rule_cascade_decide(spark: SparkSession, d: str) -> DataFrame:
    """Every pair's bucket and the rule that decided it."""
    return D.decide(pairs(spark, d), GIVEN).select("pair", "bucket", "rule_id")


@query(f"WITH {_PAIRS_SQL}, {decided_sql('p', _OWN, '0')}, {_expanded(0)}, {_expanded(1)} SELECT pair, bucket, rule_id FROM decided2")
def address_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Matches bring their addresses along: what else stands there is judged again, twice."""
    return D.expand_addresses(pairs(spark, d).withColumn("query_id", F.col("g")), given=GIVEN).select("pair", "bucket", "rule_id")


_NEARLY = f"({_only('bw', 'qw', N.DESCRIPTORS)} AND (len({_less('bw', 'qw')}) = 0 OR len({_less('qw', 'bw')}) = 0))"


@query(f"""WITH {_PAIRS_SQL}, {decided_sql('p', _OWN + ", q_suffix, c_suffix, qk, ck, clash, qw, other_kind", '0')},
s1 AS (SELECT *, CASE WHEN starts_with(c_suffix, ' OF ') THEN left(c_name, length(c_name) - length(c_suffix)) END AS base FROM decided0),
s2 AS (SELECT *, {_words('base')} AS bw FROM s1),
s3 AS (SELECT *, CASE WHEN rule_id = 'S1' AND base IS NOT NULL AND c_address IS NOT NULL AND c_zip3 IS NOT NULL AND (base = q_name OR {_NEARLY}) THEN c_suffix END AS family FROM s2),
s4 AS (SELECT *, (SELECT count(DISTINCT family) FROM s3 o WHERE o.g = s3.g AND o.c_address = s3.c_address AND o.c_zip3 = s3.c_zip3) AS suffixes, coalesce((SELECT list(DISTINCT c_industry) FROM s3 o WHERE o.g = s3.g AND o.bucket = 'matched' AND o.rule_id <> 'M3' AND c_industry IS NOT NULL), []) AS trades,
 EXISTS (SELECT 1 FROM s3 o WHERE o.g = s3.g AND o.c_address = s3.c_address AND o.bucket = 'matched') AS at_matched FROM s3),
s5 AS (SELECT *, CASE WHEN by_licence THEN 'matched L1'
 WHEN family IS NOT NULL AND suffixes > 1 AND q_suffix IS NULL AND q_tier IN ('distinctive', 'medium') AND c_state = q_state AND qk = ck AND q_city <> '' AND NOT clash AND NOT other_kind THEN 'matched M1s'
 WHEN rule_id = 'M3' AND len(string_split(c_name, ' ')) = 2 AND string_split(c_name, ' ')[2] IN ({_listed(D.COLLIDING_TRADE_WORDS)}) AND len(trades) > 0 AND NOT list_contains(trades, c_industry) THEN 'uncertain M3u'
 WHEN bucket = 'excluded' AND red_flags > 0 AND at_matched THEN 'uncertain R1' ELSE bucket || ' ' || rule_id END AS last FROM s4)
SELECT pair, split_part(last, ' ', 1) AS bucket, split_part(last, ' ', 2) AS rule_id FROM s5""")
def second_pass_rules(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that need a query's other candidates."""
    return D.second_pass(D.decide(pairs(spark, d).withColumn("query_id", F.col("g")), GIVEN)).select("pair", "bucket", "rule_id")


# Six customers file in each building; every third building is the query's own in another state, with or without a rival beside it.
_H, _K = "CAST(floor(c_custkey / 6) AS BIGINT)", "c_custkey % 6"
_SITE = f"SELECT c_custkey, md5(CAST(c_custkey AS STRING)) AS entity_key, {_H} AS h, {_K} AS k, {_made(f'CAST(floor(c_custkey / 18) AS BIGINT)')} AS w, {_made(f'-1 - {_H}')} AS w2 FROM customer"
_ENTITY = """SELECT entity_key, h, k, CASE k WHEN 0 THEN w || ' CONSTRUCTION' WHEN 1 THEN CASE h % 4 WHEN 0 THEN left(w, 6) || substr(w, 6) WHEN 1 THEN w || ' CONSTRUCTION' ELSE left(w, 4) || 'Z' || substr(w, 6) END || CASE h % 4 WHEN 1 THEN ' ROOFING' WHEN 2 THEN ' CONSTRUCTION' ELSE ' ROOFING' END
 WHEN 2 THEN w || CASE h % 5 WHEN 0 THEN ' PAINTING' WHEN 1 THEN ' BUILDERS CONSTRUCTION' ELSE ' GROUP' END WHEN 3 THEN w2 || ' ROOFING' WHEN 4 THEN w2 WHEN 5 THEN CASE h % 3 WHEN 0 THEN w || ' CONTRACTORS' ELSE w2 || ' ' || w END END AS clean_name,
 CASE h % 3 WHEN 0 THEN 'TX' WHEN 1 THEN 'OK' ELSE 'LA' END AS state, 'CITY' || CAST(h AS STRING) AS city, CASE WHEN k = 3 AND h % 2 = 0 THEN NULL ELSE CAST(h AS STRING) || ' MAIN' END AS addr_key, CASE h % 7 WHEN 6 THEN NULL ELSE CAST(70000 + h % 900 AS STRING) END AS zip5,
 CASE WHEN k = 1 THEN 5 * ((h * 7) % 11) WHEN k = 0 THEN 1 + h % 9 ELSE (h + k) % 6 END AS n FROM s"""
_ASKED = "SELECT h AS query_id, clean_name AS q_name, state AS q_state, city AS q_city, CASE h % 12 WHEN 3 THEN 'medium' ELSE 'distinctive' END AS q_tier, CAST(NULL AS STRING) AS q_trade, false AS q_initials, false AS q_incorporated FROM e WHERE k = 0 AND h % 3 = 0"
_BLANKS = "CAST(NULL AS STRING) AS c_industry, false AS c_other_kind, false AS c_incorporated, false AS c_initials"


def _rival_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = spark.sql(_SITE.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer"))
    e = spark.sql(_ENTITY.replace("FROM s", "FROM {s}"), s=s).withColumn("name_core", N.name_core(F.col("clean_name")))
    q = spark.sql(_ASKED.replace("FROM e", "FROM {e}"), e=e)
    return e, q.withColumn("q_core", N.name_core(F.col("q_name")))


_RIVAL_SQL = f"s AS ({_SITE}), e_ AS ({_ENTITY}), e AS (SELECT *, {_core('clean_name')} AS name_core FROM e_), asked AS ({_ASKED})".replace("STRING", "VARCHAR")


@query(f"""WITH {_RIVAL_SQL}, sh AS (SELECT addr_key, zip5 FROM e WHERE addr_key IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT name_core) >= 6),
site AS (SELECT *, left(zip5, 3) AS zip3 FROM e WHERE addr_key IS NOT NULL AND zip5 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.addr_key = e.addr_key AND sh.zip5 = e.zip5)),
held AS (SELECT query_id, entity_key FROM asked JOIN e ON clean_name = q_name AND state <> q_state WHERE q_tier = 'distinctive'),
ours AS (SELECT query_id, addr_key, zip3, entity_key, clean_name AS own_name, name_core AS own_core, n FROM held JOIN site USING (entity_key)),
p AS (SELECT a.*, o.addr_key, o.zip3, site.entity_key, clean_name AS c_name, state AS c_state, city AS c_city, n, true AS c_at_address, {_BLANKS.replace('STRING', 'VARCHAR')} FROM (SELECT DISTINCT query_id, addr_key, zip3 FROM ours) o JOIN site USING (addr_key, zip3) JOIN asked a USING (query_id) WHERE (query_id, site.entity_key) NOT IN (SELECT (query_id, entity_key) FROM held)),
{decided_sql('p', 'query_id, addr_key, zip3, entity_key, c_name, c_core, n')},
f AS (SELECT DISTINCT d.query_id, d.addr_key, d.zip3, d.entity_key, c_name, d.n FROM decided d JOIN ours o USING (query_id, addr_key, zip3) WHERE bucket <> 'matched' AND c_core <> '' AND ((c_core <> own_core AND {_typo('c_core', 'own_core')})
 OR (c_core = own_core AND len({_less(_words('own_name'), _words('c_name'))}) = 0 AND len(list_filter({_less(_words('c_name'), _words('own_name'))}, lambda w: w IN ({_listed(w for w in N.GENERIC if w not in N.DESCRIPTORS)}))) > 0))),
b AS (SELECT query_id, addr_key, zip3, sum(n)::BIGINT AS rival_n, first(c_name ORDER BY n DESC, c_name) AS rival FROM f GROUP BY ALL),
own AS (SELECT query_id, addr_key, zip3, sum(n) AS own_n FROM (SELECT query_id, addr_key, zip3, n FROM ours UNION ALL SELECT query_id, addr_key, zip3, n FROM decided WHERE bucket = 'matched') GROUP BY ALL)
SELECT query_id, ours.entity_key, rival, rival_n FROM b JOIN own USING (query_id, addr_key, zip3) JOIN ours USING (query_id, addr_key, zip3) WHERE rival_n > own_n""".replace("'STRING'", "'VARCHAR'"))
def rival_at_address(spark: SparkSession, d: str) -> DataFrame:
    """Records of a query's name in another state that stand beside another company of nearly that name."""
    e, q = _rival_tables(spark, d)
    held = q.where("q_tier = 'distinctive'").join(e, (F.col("clean_name") == F.col("q_name")) & (F.col("state") != F.col("q_state"))).select("query_id", "entity_key")
    return RV.rivals(q, held, e.selectExpr("*", *_BLANKS.split(", ")).drop("h", "k"), I.shared_addresses(e), GIVEN)
