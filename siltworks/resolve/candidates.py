"""Candidate search: all queries at once, blocked on rare tokens, tolerant of typing errors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltworks.functions.similarity import jaro_winkler, may_reach, winkler_grid
from siltworks.operators.rows import top_k
from siltworks.sources.scratch import keeper

TOKEN_SIMILARITY, NAME_SIMILARITY, MOST_CANDIDATES, RAREST, LENGTHS = 0.92, 0.80, 400, 2, 3
#: Parts that the wanted tokens of a head and length are dealt to.
PARTS = 4
#: Letters of a common prefix that count, and the length up to which tokens meet by shared letters.
HEAD, SHORT = 4, 12


def shared_letters(n: int, m: int, least: float, prefix: int = HEAD - 1) -> int:
    """Letters that two words of ``n`` and ``m`` must have in common to be ``least`` alike with a common prefix of at most ``prefix``."""
    plain = (least - 0.1 * prefix) / (1 - 0.1 * prefix)
    return math.ceil((3 * plain - 1) / (1 / n + 1 / m) - 1e-9)


def _letter_keys(tokens: DataFrame, least: float, wanted: bool) -> DataFrame:
    """``token, key``: a hash of the first letter, of both lengths and of each choice of letters, in order of the alphabet, that an alike word must share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            words = column.to_pylist()
            size = np.fromiter(map(len, words), np.int64, len(words))
            for n in np.unique(size[(size > 0) & (size <= SHORT)]).tolist():
                rows = np.flatnonzero(size == n)
                codes = np.frombuffer("".join(words[k] for k in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
                first, codes = codes[:, :1], np.sort(codes, axis=1)
                for m in range(max(1, n - LENGTHS), min(SHORT, n + LENGTHS) + 1):
                    c = shared_letters(n, m, least)
                    if c > min(n, m):
                        continue
                    a, b = (n, m) if wanted else (m, n)
                    choice = np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)
                    key = np.repeat(first * np.uint64(4099) + np.uint64(64 * a + b), len(choice), axis=1)
                    for k in range(c):
                        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[:, choice[:, k]]
                    yield pa.RecordBatch.from_arrays([column.take(pa.array(np.repeat(rows, len(choice)))), pa.array(key.ravel().view(np.int64))], names=["token", "key"])

    return tokens.select("token").mapInArrow(run, "token string, key long")


def similar_tokens(wanted: DataFrame, vocabulary: DataFrame, least: float = TOKEN_SIMILARITY) -> DataFrame:
    """``wanted_token, token`` of like spelling. Both hold distinct tokens, the first letters agree, lengths by ``LENGTHS``.

    Words with the same ``HEAD`` letters meet by these and length. Others must share so many letters that they meet by equality with one
    of the choices of these, so that the pairs don't grow with the square of the tokens of a letter; of these, only words over
    ``SHORT`` letters meet by first letter and length. Pairs whose letters don't allow the similarity don't leave the JVM. Tokens take few
    bytes but make many pairs, so the number of partitions is stated: by bytes Spark would leave all pairs to one task.
    """
    n = 4 * int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = F.explode(F.sequence(F.length("token") - LENGTHS, F.length("token") + LENGTHS))

    def blocks(head: int) -> DataFrame:
        keys = ["head", "size", "part"]
        a = wanted.select(F.col("token").alias("wanted_token"), F.left("token", F.lit(head)).alias("head"), near.alias("size"), F.pmod(F.xxhash64("token"), F.lit(PARTS)).cast("int").alias("part"))
        b = vocabulary.select("token", F.left("token", F.lit(head)).alias("head"), F.length("token").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        if head < HEAD:
            a, b = a.where((F.col("size") > SHORT) | (F.length("wanted_token") > SHORT)), b.where(F.col("size") > SHORT - LENGTHS)
        return a.repartition(n, *keys).join(b.repartition(n, *keys), keys).select("wanted_token", "token")

    reach = may_reach(F.col("wanted_token"), F.col("token"), least)
    apart = F.left("wanted_token", F.lit(HEAD)) != F.left("token", F.lit(HEAD))
    same_head = blocks(HEAD).where((F.col("wanted_token") != F.col("token")) & reach)
    long = blocks(1).where(apart & reach)
    a, b = _letter_keys(wanted, least, True).withColumnRenamed("token", "wanted_token"), _letter_keys(vocabulary, least, False)
    short = a.repartition(n, "key").join(b.repartition(n, "key"), "key").select("wanted_token", "token").where(apart & (F.left("wanted_token", F.lit(1)) == F.left("token", F.lit(1))) & reach).distinct()
    same = wanted.join(vocabulary.select("token"), "token", "left_semi").select(F.col("token").alias("wanted_token"), "token")
    other = same_head.union(long).union(short)
    return same.union(other.where(jaro_winkler("wanted_token", "token") >= least).select("wanted_token", "token"))


def _equal(pairs: dict[str, str]) -> Column:
    """Columns that are equal or both null."""
    same = F.lit(True)
    for a, b in pairs.items():
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def search(queries: DataFrame, entities: DataFrame, index: DataFrame, frequency: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """``query_id, entity_key, similarity, by`` of the best candidates of each query.

    ``queries`` has query_id, clean_name, name_core, state; ``entities`` entity_key, clean_name, name_core,
    state, n; ``index`` the words of their clean_name. Candidates share the whole name, the core, or a spelling of one of the query's rarest
    tokens; all but the first two must be similar as a whole.

    Names are compared once, however many queries and entities have them. Then the first entity of a name and state stands for all of these, and
    only the best groups are opened again: a group behind ``most`` others by its first entity has none among the best, so none is lost.
    """
    keep = keeper(queries.sparkSession)
    named = ["clean_name", "name_core"]
    wanted = {"q_name": "clean_name", "q_core": "name_core", "q_state": "state"}
    first = Window.partitionBy(*named, "state").orderBy(F.desc("n"), "entity_key")
    members = top_k(entities.select("entity_key", *named, "state", "n"), [*named, "state"], [F.desc("n"), F.col("entity_key")], most)
    # the groups and what is in them: worked out once
    members = keep("members", members.withColumn("group", F.first("entity_key").over(first)))
    e = members.where("entity_key = group").groupBy(*named).agg(F.min("entity_key").alias("firm"))
    asked = queries.select(*(F.col(x).alias(q) for q, x in wanted.items()), "query_id").groupBy(*wanted).agg(F.min("query_id").alias("asked"))
    q = asked.groupBy("q_name", "q_core").agg(F.min("asked").alias("ask"))
    alias = q.join(e, q.q_name == e.clean_name).select("ask", "firm", F.lit(0).alias("how"))
    core = q.where("q_core != ''").join(e, q.q_core == e.name_core).select("ask", "firm", F.lit(1).alias("how"))
    words = q.select("ask", F.explode(F.array_distinct(F.split("q_name", " "))).alias("token")).where("token != ''")
    # read by the choice of rare tokens and by the search for them: worked out once
    close = keep("close", similar_tokens(words.select("token").distinct(), frequency))
    reach = words.withColumnRenamed("token", "wanted_token").join(close, "wanted_token").join(frequency, "token").groupBy("ask", "wanted_token").agg(F.sum("df").alias("df"))
    rare = top_k(reach, ["ask"], [F.col("df"), F.col("wanted_token")], RAREST).select("ask", "wanted_token")
    of_names = index.withColumnRenamed("entity_key", "firm").join(e.select("firm"), "firm", "left_semi")
    token = rare.join(close, "wanted_token").join(of_names, "token").select("ask", "firm", F.lit(2).alias("how"))
    found = alias.union(core).union(token).groupBy("ask", "firm").agg(F.min("how").alias("how"))
    both = found.join(q, "ask").join(e, "firm")
    both = both.where((F.col("how") < 2) | may_reach(F.col("q_name"), F.col("clean_name"), NAME_SIMILARITY))
    full = both.withColumn("similarity", jaro_winkler("q_name", "clean_name"))
    kept = full.where((F.col("how") < 2) | (F.col("similarity") >= NAME_SIMILARITY))
    alike = [F.coalesce(F.col("q_state") == F.col("state"), F.lit(False)).desc(), F.col("similarity").desc(), F.col("n").desc()]
    by = F.element_at(F.array(F.lit("name"), F.lit("core"), F.lit("token")), F.col("how") + 1)
    pairs = kept.select(F.col("q_name").alias("_name"), F.col("q_core").alias("_core"), F.col("clean_name").alias("_e_name"), F.col("name_core").alias("_e_core"), "similarity", by.alias("by"))
    groups = pairs.join(asked, _equal({"_name": "q_name", "_core": "q_core"})).join(members.where("entity_key = group"), _equal({"_e_name": "clean_name", "_e_core": "name_core"}))
    groups = top_k(groups, ["asked"], [*alike, F.col("group")], most).select("asked", *wanted, "state", "group", "similarity", "by")
    opened = groups.join(members.select("group", "entity_key", "n"), "group")
    answers = top_k(opened, ["asked"], [*alike, F.col("entity_key")], most).select(*wanted, "entity_key", "similarity", "by")
    return queries.join(answers, _equal(wanted)).select("query_id", "entity_key", "similarity", "by")


def exact_links(left: DataFrame, right: DataFrame, least: float = 0.93, parts: int | None = None) -> DataFrame:
    """Best method by which ``left(key, name, state, zip5, addr_key)`` and ``right(ref_id, ...)`` are the same.

    M1: name, state and zip; M2: name, state and address; M3: address, zip and state with names of at
    least five letters that are nearly alike. Each join has ``parts`` partitions, if it is given.
    """
    dealt = lambda df, *keys: df.repartition(parts, *keys) if parts else df
    r = right.select("ref_id", F.col("name").alias("r_name"), F.col("state").alias("r_state"), F.col("zip5").alias("r_zip"), F.col("addr_key").alias("r_addr"))
    m1_left, m1_right = dealt(left, "name", "state", "zip5"), dealt(r, "r_name", "r_state", "r_zip")
    m1 = m1_left.join(m1_right, (F.col("name") == F.col("r_name")) & (F.col("state") == F.col("r_state")) & (F.col("zip5") == F.col("r_zip"))).select("key", "ref_id", F.lit("M1").alias("method"))
    m2_left, m2_right = dealt(left, "name", "state", "addr_key"), dealt(r, "r_name", "r_state", "r_addr")
    m2 = m2_left.join(m2_right, (F.col("name") == F.col("r_name")) & (F.col("state") == F.col("r_state")) & (F.col("addr_key") == F.col("r_addr"))).select("key", "ref_id", F.lit("M2").alias("method"))
    m3_left, m3_right = dealt(left, "addr_key", "zip5", "state"), dealt(r, "r_addr", "r_zip", "r_state")
    near = m3_left.join(m3_right, (F.col("addr_key") == F.col("r_addr")) & (F.col("zip5") == F.col("r_zip")) & (F.col("state") == F.col("r_state"))).where((F.col("name") != F.col("r_name")) & (F.length("name") >= 5) & (F.length("r_name") >= 5))
    m3 = near.where(may_reach(F.col("name"), F.col("r_name"), least)).where(jaro_winkler("name", "r_name") >= least).select("key", "ref_id", F.lit("M3").alias("method"))
    return dealt(m1.union(m2).union(m3), "key", "ref_id").groupBy("key", "ref_id").agg(F.min("method").alias("method"))


#: Pairs at a place up to which its names are compared pair by pair in one join; beyond, in blocks of about so many rows of a side.
FEW, BLOCK = 2_000, 1_000


def near_names(left: DataFrame, right: DataFrame, place: list[str], least: float = 0.93, but: DataFrame | None = None) -> DataFrame:
    """``key, source, ref_id``, each once, of different names of at least five letters at one place that are nearly alike.

    ``left(key, name, ...)`` has a row a key, ``right(source, ref_id, name, ...)`` one for each name of a record; both have the columns ``place``.
    ``but(key, source, ref_id)`` is left out. A place with few pairs is joined. The rows of others are dealt over blocks, all names of a record to
    one, and a task compares a block of each side at once; it gives every pair of a key and a record once, so what is found is not shuffled.
    """
    n = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (df.where(F.length("name") >= 5) for df in (left, right))
    count = lambda df, name: df.groupBy(*place).agg(F.count("*").alias(name))
    places = count(left, "_rows").join(count(right, "_columns"), place)
    crowded = F.col("_rows") * F.col("_columns") > FEW
    r = right.withColumnRenamed("name", "r_name")
    both = left.join(places.where(~crowded), place, "left_semi").join(r, place).where(F.col("name") != F.col("r_name"))
    few = both.where(may_reach(F.col("name"), F.col("r_name"), least)).where(jaro_winkler("name", "r_name") >= least).select("key", "source", "ref_id").distinct()
    blocks = places.where(crowded).select(*place, *(F.ceil(F.col(x) / BLOCK).cast("int").alias(x) for x in ("_rows", "_columns")))
    spread = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    by = [*place, "_r", "_c"]
    if but is None:
        left = left.withColumn("but", F.lit(None).cast("array<struct<source:string,ref_id:string>>"))
    else:
        of_few = but.select("key", F.col("source").alias("_s"), F.col("ref_id").alias("_i"))
        few = few.join(of_few, (few["key"] == of_few["key"]) & few["source"].eqNullSafe(F.col("_s")) & few["ref_id"].eqNullSafe(F.col("_i")), "left_anti")
        left = left.join(but.groupBy("key").agg(F.collect_list(F.struct("source", "ref_id")).alias("but")), "key", "left")
    a = left.join(blocks, place).withColumn("_r", F.pmod(F.xxhash64("key"), F.col("_rows")).cast("int")).withColumn("_c", spread("_columns")).select("key", "name", "but", *by)
    b = right.join(blocks, place).withColumn("_c", F.pmod(F.xxhash64("source", "ref_id"), F.col("_columns")).cast("int")).withColumn("_r", spread("_rows")).select("source", "ref_id", "name", *by)

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        kept = b.select(["source", "ref_id"])
        if not a.num_rows or not b.num_rows:
            return pa.table([a["key"].slice(0, 0), *kept.slice(0, 0).columns], names=["key", "source", "ref_id"])
        a_names, a_at = (x for x in np.unique(a["name"].to_pylist(), return_inverse=True))
        b_names, b_at = (x for x in np.unique(b["name"].to_pylist(), return_inverse=True))
        alike = winkler_grid(a_names.tolist(), b_names.tolist(), least)
        _, i, j = np.intersect1d(a_names, b_names, assume_unique=True, return_indices=True)
        alike[i, j] = False
        number: dict[tuple[str, str], int] = {}
        record = np.array([number.setdefault(x, len(number)) for x in zip(b["source"].to_pylist(), b["ref_id"].to_pylist(), strict=True)])
        order = np.argsort(record, kind="stable")
        starts = np.flatnonzero(np.diff(record[order], prepend=-1))
        found = np.logical_or.reduceat(alike[:, b_at[order]], starts, axis=1)[a_at]
        for row, others in enumerate(a["but"].to_pylist()):
            for x in others or ():
                if (k := number.get((x["source"], x["ref_id"]))) is not None:
                    found[row, k] = False
        rows, columns = np.nonzero(found)
        return pa.table([a["key"].take(pa.array(rows)), *kept.take(pa.array(order[starts])).take(pa.array(columns)).columns], names=["key", "source", "ref_id"])

    many = a.repartition(n, *by).groupBy(*by).cogroup(b.repartition(n, *by).groupBy(*by)).applyInArrow(compare, "key string, source string, ref_id string")
    return few.union(many)


def correct_spelling(unknown: DataFrame, known: DataFrame, least_n: int = 10, times: int = 10) -> DataFrame:
    """``name, corrected``: a distinctive known core of like spelling that is far more frequent.

    ``unknown`` and ``known`` have ``name`` and ``n``; where several qualify, the most frequent wins.
    """
    k = known.select(F.col("name").alias("corrected"), F.col("n").alias("known_n"), F.left("name", F.lit(2)).alias("head"), F.length("name").alias("size"))
    near = F.explode(F.sequence(F.length("name") - 1, F.length("name") + 1))
    pairs = unknown.select("name", "n", F.left("name", F.lit(2)).alias("head"), near.alias("size")).join(k, ["head", "size"]).where((F.col("name") != F.col("corrected")) & (F.col("known_n") >= least_n) & (F.col("known_n") >= times * F.col("n")))
    near = pairs.where(may_reach(F.col("name"), F.col("corrected"), 0.9)).where(jaro_winkler("name", "corrected") >= 0.9)
    pick = Window.partitionBy("name").orderBy(F.desc("known_n"), "corrected")
    return near.withColumn("_n", F.row_number().over(pick)).where("_n = 1").select("name", "corrected")
