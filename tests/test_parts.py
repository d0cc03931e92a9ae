import re

import pytest

from siltworks import session
from siltworks.plans import facts, marts


def shuffles(df):
    """The numbers of partitions of all shuffles of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"hashpartitioning\([^\n]*, ([0-9]+)\), (?:REPARTITION_BY_NUM|ENSURE_REQUIREMENTS)", plan)]


@pytest.mark.parametrize("query", [marts.hazard_year, marts.orphans_quarantine, facts.hazard_visits, facts.hazard_evidence])
def test_a_tasks_share_does_not_grow_with_the_table(spark, query, monkeypatch):
    sf = "/root/testdata/sf0.001"
    citations = session.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(session.parts, "__defaults__", (500,))
    found = shuffles(query(spark, sf))
    assert found and max(found) == -(-citations // 500)
    if query is not marts.orphans_quarantine:  # its customers go by the orders' number
        assert set(found) == {-(-citations // 500)}
