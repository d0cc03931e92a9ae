"""Decisions as a versioned table: keyed merges that rewrite what they touch, and a test for writers who meet.

The table lies in a fixed number of buckets by subject. A version is a small file that names, for each bucket, the folder
that holds its rows; a merge writes new folders for the buckets that it touches and then puts its version's file in place. That
either succeeds or, if the number is taken, fails whole: a reader sees a version or the one before, never a half.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from siltworks.sources.raw import _fs, put_in_place

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has changed what this one read; its merge was not written. Read again and decide anew."""


class DecisionStore:
    """Rows keyed by ``keys``, the first of which says which bucket a row lies in.

    Opening a store writes nothing; an empty one has version 0. ``schema`` is that of all its rows, keys included.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType, keys: tuple[str, ...] = ("sub_id", "entity_key"), buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema

    def versions(self) -> list[int]:
        fs, pattern = _fs(self.spark, f"{self.root}/VERSION.*")
        return sorted(int(f.getPath().getName().rpartition(".")[2]) for f in fs.globStatus(pattern) or [])

    @property
    def version(self) -> int:
        """The newest version."""
        return max(self.versions(), default=0)

    def _folders(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/VERSION.{version:012d}", wholetext=True).first()[0])["buckets"]

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.keys[0]).cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default."""
        return self._read(sorted(self._folders(self.version if version is None else version).values()))

    def merge(self, changes: DataFrame, base: int, resolve: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Put ``changes`` in place of rows with the same keys, and write the version after the newest; its number is returned.

        ``changes`` has the store's columns and ``_delete`` if it takes rows out; of rows with equal keys it may hold one. ``base`` is the
        version that the changes were worked out from. If others have written since, this merge goes on top of theirs unless one touched
        a bucket of these changes: then :class:`Conflict` is raised and nothing is written. ``resolve`` may say what becomes of old and new
        rows of a key: it gets (keys..., old, new) as structs, and returns the store's columns.
        """
        gone = "_delete" in changes.columns
        new = changes.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema), (F.coalesce("_delete", F.lit(False)) if gone else F.lit(False)).alias("_delete"))
        new = new.withColumn("_bucket", self._bucket())
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most ``buckets`` rows
        if not touched:
            return base
        if again := new.groupBy(*self.keys).count().where("count > 1").first():
            raise ValueError(f"two changes of one key: {again}")
        newest = self.version
        now = self._unchanged(touched, base, newest)
        old = self._read([now[str(b)] for b in touched if str(b) in now])
        part = f"data/{uuid.uuid4().hex}"
        if resolve is None:
            kept = old.join(new.select(*self.keys), list(self.keys), "left_anti")
            after = kept.unionByName(new.where("not _delete").drop("_delete", "_bucket"))
        else:
            row = lambda df, name: df.select(*self.keys, F.struct(*self.schema.names).alias(name))
            after = resolve(row(old, "old").join(row(new.where("not _delete"), "new"), list(self.keys), "full")).join(new.where("_delete").select(*self.keys), list(self.keys), "left_anti")
        after.select(*self.schema.names).withColumn("_bucket", self._bucket()).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{part}")
        fs, _ = _fs(self.spark, self.root)
        path = lambda b: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}/_bucket={b}")
        made = {str(b): f"{part}/_bucket={b}" for b in touched if fs.exists(path(b))}  # others have lost all their rows
        while True:
            folders = {b: f for b, f in now.items() if int(b) not in touched} | made
            body = json.dumps({"version": newest + 1, "base": base, "touched": touched, "buckets": folders}, sort_keys=True)
            if put_in_place(self.spark, f"{self.root}/VERSION.{newest + 1:012d}", body):
                return newest + 1
            # someone was faster; what was written still holds if they left our buckets alone
            newest = self.version
            now = self._unchanged(touched, base, newest)

    def _unchanged(self, touched: list[int], base: int, newest: int) -> dict[str, str]:
        """The newest version's folders; where they differ from base in a bucket of ours, someone else was there."""
        before, now = self._folders(base), self._folders(newest)
        if clash := [b for b in touched if before.get(str(b)) != now.get(str(b))]:
            raise Conflict(f"version {newest} changed buckets {clash} after version {base}")
        return now


def persist_rules(store: DecisionStore, decided: DataFrame, base: int, waiting: DataFrame | None = None) -> int:
    """Write the rules' decisions into the store: keys that people decided keep their rows, keys of ``waiting`` wait as possible.

    ``decided`` has the store's columns; ``waiting(sub_id, entity_key)`` are records of which open questions ask.
    """
    rows = decided
    if waiting is not None:
        asked = waiting.select(*store.keys).distinct().withColumn("_w", F.lit(True))
        rows = decided.join(asked, list(store.keys), "left").withColumn("bucket", F.when(F.col("_w"), "possible").otherwise(F.col("bucket"))).drop("_w")

    def people_first(both: DataFrame) -> DataFrame:
        human = F.coalesce(F.col("old.method").isin("user", "remap", "question"), F.lit(False))
        kept = F.when(F.col("new").isNull() | human, F.col("old")).otherwise(F.col("new"))
        return both.select(kept.alias("r")).select("r.*")

    return store.merge(rows, base, people_first)
