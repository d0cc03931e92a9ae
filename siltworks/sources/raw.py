"""Reading raw files without losing anything, reference lookups, and publishing builds."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siltworks.functions.text import squeeze
from siltworks.operators.checks import checksum, shrunk


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def _csv(spark: SparkSession, **options):
    return spark.read.options(header=True, quote='"', escape='"', multiLine=True, inferSchema=False, **options)


def all_text(spark: SparkSession, *paths: str) -> DataFrame:
    """Drops of one table with every column as text; columns are matched by name, what a drop lacks is null."""
    parts = [_csv(spark).csv(p) for p in paths]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def with_lineage(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A strict read: a malformed row fails it. ``source_file`` says where a row comes from."""
    reader = _csv(spark, mode="FAILFAST")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select("*", F.col("_metadata.file_path").alias("source_file"))


def lenient(spark: SparkSession, path: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a file whose rows may be short or broken, and the broken ones as they stand in it."""
    schema = StructType([*(StructField(c, StringType()) for c in columns), StructField("_broken", StringType())])
    df = spark.read.options(header=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_broken").schema(schema).csv(path)
    return df.drop("_broken"), df.where("_broken is not null").select("_broken")


def lookup(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A reference table, or an empty one of the same columns if its file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = _csv(spark).csv(path)
    return raw.select(*(squeeze(F.col(f.name)).try_cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def put_in_place(spark: SparkSession, path: str, body: str) -> bool:
    """Writes a small file whole under a name that no one has taken; false if it is taken.

    A draft is written first and then given the name: by a rename, which fails where the name exists, or on a local disk, where it
    would not fail, by a hard link.
    """
    fs, draft = _fs(spark, f"{path.rpartition('/')[0]}/_draft.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(body.encode()))
    out.close()
    _, target = _fs(spark, path)
    if fs.getScheme() != "file":
        if done := fs.rename(draft, target):
            return done
        fs.delete(draft, False)
        return False
    local = lambda p: spark._jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
    try:
        spark._jvm.java.nio.file.Files.createLink(local(target), local(draft))
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(draft, False)


class Shrunk(ValueError):
    """Tables of a build lost more rows than allowed; it wasn't published."""


def publish(tables: dict[str, DataFrame], root: str, build_id: str, info: dict, most_lost: float | None = None) -> str:
    """Writes a build beside the others, then its pointer under a name of its own; readers never see half a build.

    Pointers are numbered and never replaced: the newest one whose file is whole counts, so a reader finds
    the old build or the new one at any moment. With ``most_lost`` a build is refused if a table has lost more than
    that share of the rows that the published build has. The pointer holds each table's rows and checksum.
    """
    spark = next(iter(tables.values())).sparkSession
    old = _pointers(spark, root)
    prints = {}
    for name, df in tables.items():
        path = f"{root}/build_id={build_id}/{name}"
        df.write.mode("overwrite").parquet(path)
        prints[name] = checksum(spark.read.parquet(path)).first().asDict()
    if most_lost is not None and old:
        before = {t: p["rows"] for t, p in current(spark, root).get("tables", {}).items()}
        if lost := shrunk(before, {t: p["rows"] for t, p in prints.items()}, most_lost):
            raise Shrunk(f"rows before and after: {lost}")
    body = json.dumps(info | {"build_id": build_id, "tables": prints}, sort_keys=True)
    if not put_in_place(spark, f"{root}/CURRENT.{old[-1] + 1 if old else 1:012d}", body):
        raise FileExistsError(f"another build was published at {root} meanwhile")
    return build_id


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, pattern = _fs(spark, f"{root}/CURRENT.*")
    return sorted(int(f.getPath().getName().rpartition(".")[2]) for f in fs.globStatus(pattern) or [])


def current(spark: SparkSession, root: str) -> dict:
    """What the newest pointer says of the published build."""
    known = _pointers(spark, root)
    if not known:
        raise FileNotFoundError(f"nothing is published at {root}")
    return json.loads(spark.read.text(f"{root}/CURRENT.{known[-1]:012d}", wholetext=True).first()[0])


def follow(spark: SparkSession, root: str, since: str | None = None) -> dict | None:
    """The published build if it is another than ``since``, else nothing: for readers that move on to new builds."""
    if not _pointers(spark, root):
        return None
    now = current(spark, root)
    return now if now["build_id"] != since else None


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/build_id={current(spark, root)['build_id']}/{name}")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def report_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)
