"""What the operators that remove spans of bytes share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def copies(docs: DataFrame) -> DataFrame:
    """``docs`` with ``copy``: 0, or the number of a text among those of rows that share an id."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = plain.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if ids.isEmpty():
        return plain.withColumn("copy", F.lit(0).cast("long"))
    again = plain.join(ids, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.xxhash64("text"))).alias("texts"))
    return plain.join(again, "doc_id", "left").select("doc_id", "text", F.coalesce(F.array_position("texts", F.xxhash64("text")) - 1, F.lit(0)).cast("long").alias("copy"))


def counted(found: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` from ``doc_id, text, removed, kept_bytes``."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
