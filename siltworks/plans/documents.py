"""JSON columns, quotes and timers over events, documents and the benchmark, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.functions import jsons as J
from siltworks.operators import grounding as G, quotes as QT, written as W
from siltworks.session import table
from siltworks.sources.scratch import keeper
from siltworks.streaming import requeue as RQ, runs as RN

from .marts import query


@query("""WITH m AS (SELECT event_id, json_merge_patch(json_merge_patch(props::JSON, json_object('kind', event_type, 'who', json_object('id', user_id, 'first', event_id % 2 = 0))), json_object('k', event_id % 7, 'who', json_object('id', event_id))) AS deep,
 json_object('id', event_id) AS shallow_who FROM events)
SELECT event_id, (deep->>'$.k')::BIGINT AS k, deep->>'$.kind' AS kind, (deep->>'$.who.id')::BIGINT AS who, (deep->>'$.who.first')::BOOLEAN AS first, (shallow_who->>'$.first')::BOOLEAN AS shallow_first, (json_extract_string((SELECT props::JSON FROM events e WHERE e.event_id = m.event_id), '$.k'))::BIGINT AS own FROM m""")
def json_merge(spark: SparkSession, d: str) -> DataFrame:
    """Evidence merged by keys, all the way down and at the top level only."""
    e = table(spark, d, "events")
    more = F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("id"), (F.col("event_id") % 2 == 0).alias("first")).alias("who")))
    last = F.to_json(F.struct((F.col("event_id") % 7).alias("k"), F.struct(F.col("event_id").alias("id")).alias("who")))
    both = e.select("event_id", F.col("props"), J.merge(J.merge(F.col("props"), more), last, depth=3).alias("deep"), J.merge(J.merge(F.col("props"), more), last).alias("flat"))
    f = lambda c, path, kind: J.field(F.col(c), path, kind)
    return both.select("event_id", f("deep", "$.k", "bigint").alias("k"), f("deep", "$.kind", "string").alias("kind"), f("deep", "$.who.id", "bigint").alias("who"), f("deep", "$.who.first", "boolean").alias("first"), f("flat", "$.who.first", "boolean").alias("shallow_first"), f("props", "$.k", "bigint").alias("own"))


@query(r"""WITH q AS (SELECT item_id * 1000 + i AS quote_id, list_filter(regexp_extract_all(lower(parts[i]), '[\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM (SELECT item_id, string_split(text, '.') AS parts, unnest(range(1, len(string_split(text, '.')) + 1)) AS i FROM benchmark)),
s AS (SELECT doc_id AS source_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents)
SELECT quote_id, source_id FROM q JOIN s ON len(w) > 0 AND contains(t, ' ' || array_to_string(w, ' ') || ' ')""")
def quotes_standing(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the benchmark that stand in documents word for word."""
    b = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"\.")).alias("k", "text"))
    q = b.select((F.col("item_id") * 1000 + F.col("k") + 1).alias("quote_id"), "text")
    return QT.standing(q, table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text"), keeper(spark)).select("quote_id", "source_id")


@query("""WITH m AS (SELECT user_id, ts, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY user_id, run""")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    """What :func:`siltworks.streaming.runs.gap_sessions` comes to once every session is over."""
    return RN.gap_sessions(table(spark, d, "events"))


_DECISIONS = """SELECT event_id AS decision_id, user_id AS sub_id, 'e' || CAST(event_id % 3 AS STRING) AS entity_key, CASE WHEN event_type = 'click' THEN 'matched' ELSE 'possible' END AS bucket, 'rule' AS method,
 CASE WHEN event_type IN ('error', 'view') THEN 'unavailable' ELSE 'rules' END AS decided_by, event_id % 9 = 0 AS needs_adjudication, ts AS decided_at FROM events"""


@query(f"""WITH x AS ({_DECISIONS.replace('STRING', 'VARCHAR')}), w AS (SELECT *, lead(decided_at) OVER (PARTITION BY sub_id, entity_key ORDER BY decided_at, decision_id) AS next FROM x)
SELECT sub_id, entity_key, decided_at FROM w WHERE decided_by = 'unavailable' AND method = 'rule' AND bucket = 'possible' AND NOT needs_adjudication AND decided_at + INTERVAL 600 MINUTE < TIMESTAMP '2024-01-25' AND (next IS NULL OR next > decided_at + INTERVAL 600 MINUTE)""")
def requeue_due(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that could not be made and had no other within ten hours."""
    x = spark.sql(_DECISIONS.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    return RQ.requeued(x, F.lit("2024-01-25").cast("timestamp"), 600)


# numbers as words, by an expression that both engines read: SQL writes what has to be read back
_ONES, _TENS = " ".join(("zero", *W.ONES, *W.TEENS)), " ".join(("none", "none", *W.TENS))
_ORDINALS = " ".join(("none", *W.ORDINAL_ONES, *W.ORDINAL_TEENS, "twentieth"))
_whole = lambda x, by: f"CAST(floor(({x}) / {by}) AS INT)"


def _spelt(x: str) -> str:
    """Words of a number below two million."""
    one = lambda x: f"split_part('{_ONES}', ' ', CAST({x} + 1 AS INT))"
    two = lambda x: f"CASE WHEN {x} < 20 THEN {one(x)} WHEN {x} % 10 = 0 THEN split_part('{_TENS}', ' ', {_whole(x, 10)} + 1) ELSE split_part('{_TENS}', ' ', {_whole(x, 10)} + 1) || '-' || {one(f'{x} % 10')} END"
    three = lambda x: f"CASE WHEN {x} < 100 THEN {two(x)} WHEN {x} % 100 = 0 THEN {one(_whole(x, 100))} || ' hundred' ELSE {one(_whole(x, 100))} || ' hundred and ' || {two(f'({x} % 100)')} END"
    parts = [f"CASE WHEN {x} >= 1000000 THEN {one(_whole(x, 1000000))} || ' million' END", f"CASE WHEN {x} % 1000000 >= 1000 THEN {three(_whole(f'{x} % 1000000', 1000))} || ' thousand' END", f"CASE WHEN {x} % 1000 > 0 OR {x} = 0 THEN {three(f'({x} % 1000)')} END"]
    return f"concat_ws(' ', {', '.join(parts)})"


_MONTH = f"split_part('{' '.join(W.MONTHS)}', ' ', CAST(1 + turn % 12 AS INT))"
_N, _D, _Y = "((conv_id * 7919 + turn * 104729) % 2000000)", "(1 + (conv_id + turn) % 20)", "(1990 + (conv_id + turn) % 40)"
_DAY = f"CASE conv_id % 3 WHEN 0 THEN CAST({_D} AS STRING) || ' ' || {_MONTH} || ' ' || CAST({_Y} AS STRING) WHEN 1 THEN 'the ' || split_part('{_ORDINALS}', ' ', CAST({_D} + 1 AS INT)) || ' of ' || {_MONTH} || ', ' || CAST({_Y} AS STRING) ELSE upper({_MONTH}) || ' ' || CAST({_D} AS STRING) || 'th, ' || CAST({_Y} AS STRING) END"
_SAID = f"SELECT conv_id, turn, coalesce(text, '') || '. On ' || {_DAY} || ' they counted ' || {_spelt(_N)} || ' falls.' AS said FROM conversations"


@query(f"SELECT conv_id, turn, {_N} AS n, make_date({_Y}, 1 + turn % 12, {_D}) AS day FROM conversations")
def written_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The last number and date that texts write in words. The SQL never parses: it gives what was written."""
    said = spark.sql(_SAID.replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, d, "conversations"))
    found = said.withColumn("items", W.items(F.col("said")))
    return found.select("conv_id", "turn", F.element_at(W.numbers(F.col("items")), -1).alias("n"), F.element_at(W.dates(F.col("items")), -1).alias("day"))


_A, _B = "((conv_id * 31 + turn * 17) % 5000)", "(13 + (conv_id * 7 + turn) % 900)"
_KNOWN = (f"({_A} + CASE WHEN turn % 3 = 0 THEN 7 ELSE 0 END)", f"({_B} + CASE WHEN conv_id % 4 = 0 THEN 5 ELSE 0 END)")
_ANSWER = f"SELECT conv_id, turn, 'There were ' || {_spelt(_A)} || ' visits and ' || CAST({_B} AS STRING) || ' citations, ' || CAST(turn % 100 AS STRING) || '% of them open.' AS answer, 'visits: ' || CAST({_KNOWN[0]} AS STRING) || ' | cited: ' || CAST({_KNOWN[1]} AS STRING) || ' | share: ' || CAST(turn % 100 AS STRING) || '%' AS evidence FROM conversations"


@query(f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(list_filter([{_A}, {_B}], lambda x: NOT list_contains([{_KNOWN[0]}, {_KNOWN[1]}], x)), lambda x: x::VARCHAR))), ',') AS missing FROM conversations""")
def grounding_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Figures of an answer, in words and digits, that its evidence doesn't have."""
    said = spark.sql(_ANSWER.replace("FROM conversations", "FROM {conversations}"), conversations=table(spark, d, "conversations"))
    return said.select("conv_id", "turn", F.array_join(G.ungrounded(F.col("answer"), F.col("evidence")), ",").alias("missing"))
