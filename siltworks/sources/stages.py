"""Builds that do again only what has changed.

A stage's fingerprint is taken of the code, the settings, its name and columns, and what its plan reads: raw files by path, length and time, tables
of earlier stages by the checksum of their rows. Code outside this library's own modules has to be named by the caller's ``code``. A stage whose fingerprint is known is not run. One that is run but comes to the rows that
it had before keeps its old table, so what reads it is not run either. Checksums are trees: a table's rows lie in leaves by their hash, so
two versions can be compared leaf by leaf.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, is_dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.operators.checks import fingerprint
from siltworks.sources.raw import _fs, exists, put_in_place

LEAVES = 256


def code_digest() -> str:
    """A digest of the library's own modules that say what a build's rows are."""
    top = Path(__file__).resolve().parents[1]
    files = sorted(p for d in (".", "functions", "operators") for p in (top / d).glob("*.py"))
    return hashlib.sha256(b"".join(p.name.encode() + p.read_bytes() for p in files)).hexdigest()


def tree(df: DataFrame, leaves: int = LEAVES) -> dict[str, list]:
    """``{leaf: [rows, checksum]}`` of a table: the same for the same rows in any order, partitioning or layout."""
    row = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}))
    found = df.select(row.alias("h")).groupBy(F.pmod("h", F.lit(leaves)).cast("int").alias("leaf")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s"))
    return {str(r.leaf): [r.n, r.s] for r in found.collect()}  # at most ``leaves`` rows


def root_of(leaves: dict[str, list], schema: str) -> str:
    return fingerprint(schema, leaves)


def changed(before: dict[str, list], after: dict[str, list]) -> dict[str, tuple[int, int]]:
    """Leaves that differ, with their rows before and after."""
    return {k: (before.get(k, [0])[0], after.get(k, [0])[0]) for k in sorted({*before, *after}, key=int) if before.get(k) != after.get(k)}


@dataclass
class Done:
    """What became of a stage: ``reused`` (not run), ``same`` (run, same rows, old table kept) or ``written``."""

    stage: str
    action: str
    rows: int
    leaves_changed: int


class Stages:
    """A ``keep(name, df)`` for builds, with memory in ``root``. Say ``report`` afterwards for what it did.

    ``settings`` may be a dataclass or anything that JSON can hold. ``tables`` are inputs that lie in no files, such as small lookups: their rows
    are part of every fingerprint.
    """

    def __init__(self, spark: SparkSession, root: str, settings: object = None, tables: tuple[DataFrame, ...] = (), code: str | None = None) -> None:
        self.spark, self.root, self.report = spark, root.rstrip("/"), []
        loose = [root_of(tree(t), t.schema.json()) for t in tables]
        self.base = fingerprint(code or code_digest(), asdict(settings) if is_dataclass(settings) else settings, loose)
        self._made: dict[str, str] = {}  # folder of a stage's table to the checksum of its rows

    def _inputs(self, df: DataFrame) -> list[str]:
        """What a plan reads, by content where a stage made it."""
        out, fs_of = set(), {}
        for file in df.inputFiles():
            folder = file.rpartition("/")[0]
            made = next((f for f in self._made if folder.endswith(f)), None)
            if made:
                out.add(self._made[made])
                continue
            if folder not in fs_of:
                fs, path = _fs(self.spark, folder)
                fs_of[folder] = {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)} if fs.isDirectory(path) else {}
            out.add(f"{file}|{fs_of[folder].get(file.rpartition('/')[2])}")
        return sorted(out)

    def _known(self, name: str, key: str = "*") -> list[dict]:
        fs, pattern = _fs(self.spark, f"{self.root}/stages/{name}.{key}.json")
        found = sorted(fs.globStatus(pattern) or [], key=lambda f: (f.getModificationTime(), f.getPath().getName()))
        return [json.loads(self.spark.read.text(f.getPath().toString(), wholetext=True).first()[0]) for f in found]

    def _serve(self, df: DataFrame, entry: dict) -> DataFrame:
        self._made[entry["folder"]] = entry["root"]
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{entry['folder']}")

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        key = fingerprint(self.base, name, df.schema.json(), self._inputs(df))
        if known := self._known(name, key):
            self.report.append(Done(name, "reused", known[-1]["rows"], 0))
            return self._serve(df, known[-1])
        folder = f"data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        leaves = tree(self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}"))
        entry = {"folder": folder, "root": root_of(leaves, df.schema.json()), "rows": sum(n for n, _ in leaves.values()), "leaves": leaves}
        before = self._known(name)
        same = next((b for b in reversed(before) if b["root"] == entry["root"] and exists(self.spark, f"{self.root}/{b['folder']}")), None)
        if same:
            fs, path = _fs(self.spark, f"{self.root}/{folder}")
            fs.delete(path, True)
            entry["folder"] = same["folder"]
        put_in_place(self.spark, f"{self.root}/stages/{name}.{key}.json", json.dumps(entry, sort_keys=True))
        differ = changed(before[-1]["leaves"], leaves) if before and not same else leaves if not before else {}
        self.report.append(Done(name, "same" if same else "written", entry["rows"], len(differ)))
        return self._serve(df, entry)
