"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode a temporary one if it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="siltworks-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_open: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; an enclosing :func:`scratch` deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables that operators wrote within it.

    Operators return plans that read such tables, so write what is to stay before the end, with ``keep`` if
    by :func:`materialise`.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            erase(spark, path)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """While it lasts, the session has these settings (``__`` for each dot); afterwards its own again."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _batch(spark: SparkSession, most: int) -> str:
    """The session's number of rows in an Arrow batch, or ``most`` if that is less or the session has no limit."""
    rows = int(spark.conf.get(_BATCH))
    return str(min(rows, most) if rows > 0 else most)


def arrow_batches(spark: SparkSession, most: int = BATCH_ROWS):
    """While it lasts, Arrow batches hold at most ``most`` rows; see :func:`small_batches`."""
    return settings(spark, **{_BATCH: _batch(spark, most)})


def materialise(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage there.

    Shuffle files of the write are deleted when it is done: no later plan reads them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if keep and _open:
        _open[-1].remove(path)
    with settings(spark, **{_BATCH: _batch(spark, batch_rows), _CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = BATCH_ROWS) -> None:
    """From now on Arrow batches of this session hold at most ``most`` rows.

    Ten thousand texts or wide arrays at a time would take much of an executor's memory beside its heap.
    """
    spark.conf.set(_BATCH, _batch(spark, most))


def erase(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that no later plan reads."""
    for df in tables:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            erase(df.sparkSession, parent)
