"""Candidate search: names are compared once, however many queries and entities have them."""

import random

from pyspark.sql import functions as F

from siltworks.functions.similarity import winkler
from siltworks.resolve import candidates as C, index as I

from .plans import join_rows

ENTITY, QUERY = "entity_key string, clean_name string, name_core string, state string, n int", "query_id int, clean_name string, name_core string, state string"


def plain(queries, entities, most):
    """Each query against each entity."""
    df = {}
    for _, name, *_ in entities:
        for w in set(name.split(" ")):
            df[w] = df.get(w, 0) + 1
    out = set()
    for i, name, core, state in queries:
        close = {w: [t for t in df if w == t or w[0] == t[0] and abs(len(w) - len(t)) <= 3 and winkler(w, t) >= C.TOKEN_SIMILARITY] for w in set(name.split(" "))}
        rare = sorted((sum(df[t] for t in ts), w) for w, ts in close.items() if ts)[: C.RAREST]
        tokens = {t for _, w in rare for t in close[w]}
        best = []
        for key, e_name, e_core, e_state, n in entities:
            how = 0 if name == e_name else 1 if core and core == e_core else 2 if tokens & set(e_name.split(" ")) else 3
            s = winkler(name, e_name)
            if how < 2 or how == 2 and s >= C.NAME_SIMILARITY:
                best.append((not (state is not None and state == e_state), -s, -n, key, how))
        out |= {(i, key, round(-s, 9), ("name", "core", "token")[how]) for _, s, _, key, how in sorted(best)[:most]}
    return out


def test_search_against_each_pair(spark):
    r = random.Random(3)
    word = lambda: r.choice(["ACME", "ACNE", "ACMEE", "ZENITH", "ZENIHT", "OAK", "RIDGE", "RIDGES"])
    name = lambda: " ".join(word() for _ in range(r.randint(1, 3)))
    core = lambda x: r.choice(["", x.split(" ")[0]])
    state = lambda: r.choice(["TX", "OK", None])
    entities = [(f"k{k:03}", x, core(x), state(), r.randint(0, 3)) for k in range(150) for x in [name()]]
    queries = [(k, x, core(x), state()) for k in range(40) for x in [name()]]
    queries += [(100 + k, *queries[k][1:]) for k in range(5)]
    e, q = spark.createDataFrame(entities, ENTITY), spark.createDataFrame(queries, QUERY)
    ix = I.token_index(e)
    for most in (1, 4, 30):
        got = C.search(q, e, ix, I.token_frequency(ix), most).collect()
        assert {(x.query_id, x.entity_key, round(x.similarity, 9), x.by) for x in got} == plain(queries, entities, most) and len(got) == len({(x.query_id, x.entity_key) for x in got})


def test_many_queries_and_entities_of_one_name(spark):
    e = spark.range(1000).select(F.format_string("k%04d", "id").alias("entity_key"), F.lit("ACME OAK").alias("clean_name"), F.lit("ACME OAK").alias("name_core"), F.lit("TX").alias("state"), F.lit(1).alias("n"))
    q = spark.range(1000).select(F.col("id").cast("int").alias("query_id"), F.lit("ACME OAK").alias("clean_name"), F.lit("ACME OAK").alias("name_core"), F.lit("TX").alias("state"))
    ix = I.token_index(e)
    found = C.search(q, e, ix, I.token_frequency(ix), 3)
    assert join_rows(found) == 3000  # 1,000,000 pairs share the name
    assert {x.entity_key for x in found.collect()} == {"k0000", "k0001", "k0002"}
