from pyspark.sql import functions as F

from siltworks.operators import pools as P
from siltworks.functions.similarity import damerau_batch


def test_draws_do_not_hang_on_the_partitioning(spark):
    df = spark.range(2000).select("id", (F.col("id") % 10).alias("v"))
    strata = {"all": (F.lit(True), 20), "even": (F.col("id") % 2 == 0, 15), "none": (F.lit(None).cast("boolean"), 5), "few": (F.col("id") < 3, 10)}
    got = [sorted(map(tuple, P.draw(x, "id", strata, 1).collect())) for x in (df, df.repartition(7), df.orderBy(F.desc("id")).coalesce(1))]
    assert got[0] == got[1] == got[2] and len({r[0] for r in got[0]}) == len(got[0])
    assert sum(r[2] == "all" for r in got[0]) == 20 and not any(r[2] == "none" for r in got[0]) and {0, 1, 2} <= {r[0] for r in got[0]}
    assert sorted(map(tuple, P.draw(df, "id", strata, 2).collect())) != got[0]
    assert P.draw(df.limit(0), "id", strata).collect() == []


def test_typos(spark):
    df = spark.createDataFrame([(k, f"THE ABCDEFGH{k} GROUP", f"ABCDEFGH{k}") for k in range(60)] + [(90, "ABC", "ABC"), (91, "", ""), (92, None, None), (93, "AAAAAAA", "AAAAAAA")], "k int, name string, core string")
    got = {r.k: (r.name, r.typo) for r in P.typos(df, "k", "name", "core").collect()}
    assert {90, 91, 92}.isdisjoint(got) and len(got) >= 55
    assert (damerau_batch([a for a, _ in got.values()], [b for _, b in got.values()]) == 1).all()
    assert all(b.startswith("THE ABC") and b.endswith(" GROUP") for k, (_, b) in got.items() if k < 60)
