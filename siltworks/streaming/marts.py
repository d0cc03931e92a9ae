"""The yearly mart as a stream: an extension of the batch marts, checked against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def additive(events: DataFrame, window: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts and sums of each window and kind; ``late`` is the watermark, by which state is bounded.

    Times without a zone are taken in the session's.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("value").cast("double").alias("value"))


def run_stream(spark: SparkSession, path: str, schema, sink: str, checkpoint: str, window: str = "1 day", late: str = "2 days") -> None:
    """Reads what is at ``path``, writes finished windows to ``sink`` and stops; restarts go on from ``checkpoint``."""
    stream = spark.readStream.schema(schema).parquet(path)
    q = additive(stream, window, late).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def merge_levels(done: DataFrame, new: DataFrame) -> DataFrame:
    """Adds new partial rows to finished ones; the measures are sums, so order does not matter."""
    return done.unionByName(new).groupBy("start", "event_type").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
