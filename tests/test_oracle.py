import pytest

from siltworks.plans import catalogue

from .oracle import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, name):
    got = spark_rows(catalogue.queries()[name](spark, SF))
    if name in catalogue.oracle_sql():
        want = sql_rows(catalogue.oracle_sql()[name], SF)
        assert got[0] == want[0]
        assert got[1] == want[1]
    assert got[1]
