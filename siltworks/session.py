"""Session factory and table access shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "siltworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on: UTC, AQE, ANSI off is never assumed."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be any URI that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: rows of a fact table for which a shuffle has a partition
PARTITION_ROWS = 1_000_000


def parts(spark: SparkSession, facts: DataFrame, rows: int = PARTITION_ROWS) -> int:
    """Partitions for a shuffle of ``facts``, a table as it was read: one for so many rows, but no fewer than the session's.

    With the session's number alone a task's share would grow with the table. Parquet files are counted by their footers.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-facts.count() // rows))
