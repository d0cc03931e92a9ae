"""Every named query of the library with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.session import table
from siltworks.streaming import marts as streaming

from . import asked, builds, cascade, documents, entities, facts, marts, text, verdicts  # noqa: F401  they register their queries


@marts.query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS value FROM events GROUP BY 1, 2")
def event_day_mart(spark: SparkSession, d: str) -> DataFrame:
    """What :func:`siltworks.streaming.marts.run_stream` comes to once every window is finished."""
    return streaming.additive(table(spark, d, "events"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard with every entity's reasons."""
    judged = verdicts.verdict_reasons(spark, sf_dir)
    return verdicts.scorecard_sorted(spark, sf_dir).join(judged.select("entity", "reasons"), "entity")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(marts.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(marts.SQL)
