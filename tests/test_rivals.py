from siltworks.functions.names import name_core
from siltworks.plans import cascade, marts
from siltworks.resolve import rivals as R

from pyspark.sql import functions as F

from .oracle import sql_rows

HELD = [
    # query's own record, then what stands beside it: name, inspections
    ("spelling", ("BRINKMAN CONSTRUCTORS", 2), [("BRINKMANN PLUMBING", 22)], "BRINKMANN PLUMBING", 22),
    ("fewer", ("BRINKMAN CONSTRUCTORS", 22), [("BRINKMANN PLUMBING", 22)], None, None),
    ("trade word", ("ABOVE BOARD CONSTRUCTION", 1), [("ABOVE BOARD CONSTRUCTION ROOFING PAVING", 9), ("ZENITH", 50)], "ABOVE BOARD CONSTRUCTION ROOFING PAVING", 9),
    ("other company", ("TOLMAR", 1), [("ZENITH", 50)], None, None),
    ("two rivals", ("BRINKMAN CONSTRUCTORS", 5), [("BRINKMANN PLUMBING", 3), ("BRINKMANN HEATING", 3)], "BRINKMANN HEATING", 6),
    ("descriptor", ("TOLMAR", 1), [("TOLMAR GROUP", 9)], None, None),
    ("shared", ("BRINKMAN CONSTRUCTORS", 2), [("BRINKMANN PLUMBING", 22), *((f"OFFICE{k}", 1) for k in range(6))], None, None),
]


def test_rivals(spark):
    queries, entities = [], []
    for i, (_, own, others, *_) in enumerate(HELD):
        queries.append((i, own[0].removesuffix(" CONSTRUCTION"), "NV", "RENO", "distinctive"))
        for k, (name, n) in enumerate([own, *others]):
            entities.append((f"{i}-{k}", name, "TX", "DALLAS", f"{i} MAIN", "75001", n))
    entities.append(("0-lost", "BRINKMANN PLUMBING", "TX", "DALLAS", None, "75001", 99))
    q = spark.createDataFrame(queries, "query_id int, q_name string, q_state string, q_city string, q_tier string").withColumn("q_core", name_core(F.col("q_name")))
    e = spark.createDataFrame(entities, "entity_key string, clean_name string, state string, city string, addr_key string, zip5 string, n long").withColumn("name_core", name_core(F.col("clean_name")))
    shared = e.groupBy("addr_key", "zip5").agg((F.countDistinct("name_core") >= 6).alias("is_shared"))
    held = e.where("entity_key like '%-0'").select(F.split_part("entity_key", F.lit("-"), F.lit(1)).cast("int").alias("query_id"), "entity_key")
    found = R.rivals(q, held, e, shared)
    got = {r.query_id: (r.entity_key, r.rival, r.rival_n) for r in found.collect()}
    assert got == {i: (f"{i}-0", name, n) for i, (*_, name, n) in enumerate(HELD) if name}
    decided = held.withColumns({"bucket": F.lit("matched"), "rule_id": F.when(F.col("query_id") == 2, "M1").otherwise("M3")})
    assert {r.query_id: (r.bucket, r.rule_id) for r in R.doubt(decided, found).collect()} == {i: ("uncertain", "M3a") if i in got and i != 2 else ("matched", "M1" if i == 2 else "M3") for i in range(len(HELD))}


def test_every_rule_comes_up(spark):
    seen = set()
    for name in ("rule_cascade_decide", "address_expansion", "second_pass_rules"):
        columns, rows = sql_rows(marts.SQL[name], "/root/testdata/sf0.01")
        seen |= {r[columns.index("rule_id")] for r in rows}
    assert {rule for rule, _, _ in cascade.D.rule_table()} | {"M1s", "M3u", "R1", "L1"} <= seen
