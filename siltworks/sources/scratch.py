"""Tables that a build writes once and reads several times, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode a temporary one if it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="siltworks-")


def keeper(spark: SparkSession) -> Callable[[str, DataFrame], DataFrame]:
    """A ``keep(name, df)`` for :func:`siltworks.warehouse.build`: writes the table and reads it back.

    Shuffle files of a write are given back when it is done.
    """
    root = f"{shared_folder(spark)}/build-{uuid.uuid4().hex}"

    def keep(name: str, df: DataFrame) -> DataFrame:
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(f"{root}/{name}")
        finally:
            spark.conf.set(_CLEANUP, before)
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return keep
