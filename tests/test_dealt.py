"""Rows are dealt over partitions by a table's size, so that a task's share stays as it is."""

import pytest
from pyspark.sql import functions as F

from siltworks import session
from siltworks.plans import asked, cascade, entities
from siltworks.resolve import candidates as C, neighbours as N

from .test_parts import shuffles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "module, rows, source, query",
    [
        (entities, "ENTITIES_A_TASK", "customer", entities.evaluation_pools), (entities, "ENTITIES_A_TASK", "customer", entities.one_edit_pairs), (entities, "ENTITIES_A_TASK", "customer", entities.fuzzy_ref_link),
        (asked, "LINES_A_TASK", "lineitem", asked.question_wording), (cascade, "PAIRS_A_TASK", "customer", cascade.pairs),
    ],
)
def test_partitions_grow_with_the_table(spark, module, rows, source, query, monkeypatch):
    n = session.table(spark, SF, source).count()
    monkeypatch.setattr(module, rows, n // 10)
    assert max(shuffles(query(spark, SF))) == -(-n // (n // 10))


def test_dealt_joins_give_the_same_rows(spark):
    names = spark.createDataFrame([(x,) for x in ("ABCD", "ABDC", "ABC", "ABCE", "XBCD", "ABCD", None, "Z")], "name string")
    assert sorted(map(tuple, N.one_edit(names, 7).collect())) == sorted(map(tuple, N.one_edit(names).collect()))
    left = spark.createDataFrame([("a", "ACME ROOFING", "TX", "1", "1 MAIN"), ("b", "ACME ROOFNG", "TX", "1", "1 MAIN"), ("c", None, "TX", None, "1 MAIN")], "key string, name string, state string, zip5 string, addr_key string")
    right = left.withColumnRenamed("key", "ref_id").withColumn("zip5", F.when(F.col("ref_id") == "a", "2").otherwise(F.col("zip5")))
    assert sorted(map(tuple, C.exact_links(left, right, parts=7).collect())) == sorted(map(tuple, C.exact_links(left, right).collect())) != []
