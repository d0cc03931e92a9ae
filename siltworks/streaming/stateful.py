"""What the stateful streams share: the state store they need, and running until the input is used up."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """While it lasts, streams that start keep their state where timers are allowed."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def drain(out: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Write what a stream has now to ``sink`` and stop; a later call goes on from ``checkpoint``.

    For streams whose time is the rows' own: one that waits for the clock is never used up and has to be started with a
    trigger of its own, within :func:`timers`.
    """
    with timers(out.sparkSession):
        out.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
