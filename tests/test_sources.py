import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from siltworks.operators import checks as C
from siltworks.sources import raw


def put(path, text):
    path.write_text(text)
    return str(path)


def test_all_text_by_name(spark, tmp_path):
    a = put(tmp_path / "a.csv", 'id,name\n007,"Smith, ""Bob"""\n12.0,\n')
    b = put(tmp_path / "b.csv", "name,extra,id\nZoe,x,9\n")
    got = {tuple(r) for r in raw.all_text(spark, a, b).select("id", "name", "extra").collect()}
    assert got == {("007", 'Smith, "Bob"', None), ("12.0", None, None), ("9", "Zoe", "x")}


def test_strict_and_lenient(spark, tmp_path):
    path = put(tmp_path / "c.csv", "n,m\n1,2\n3\n")
    rows, broken = raw.lenient(spark, path, ["n", "m"])
    assert {tuple(r) for r in rows.collect()} == {("1", "2"), ("3", None)}
    ints = StructType([StructField("n", IntegerType()), StructField("m", IntegerType())])
    bad = put(tmp_path / "d.csv", "n,m\nx,2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        raw.with_lineage(spark, bad, ints).collect()
    good = put(tmp_path / "e.csv", "n,m\n1,2\n")
    assert raw.with_lineage(spark, good, ints).first().source_file.endswith("e.csv")


def test_lookup_and_stub(spark, tmp_path):
    schema = StructType([StructField("code", StringType()), StructField("label", StringType()), StructField("serious", BooleanType()), StructField("rank", IntegerType())])
    path = put(tmp_path / "v.csv", "code,label,serious\nW, Willful ,true\n")
    assert [tuple(r) for r in raw.lookup(spark, path, schema).collect()] == [("W", "Willful", True, None)]
    missing = raw.lookup(spark, str(tmp_path / "none.csv"), schema)
    assert missing.schema == schema and missing.isEmpty()


def test_publish(spark, tmp_path):
    root = str(tmp_path / "builds")
    with pytest.raises(FileNotFoundError):
        raw.current(spark, root)
    for build, n in (("b1", 3), ("b2", 5)):
        raw.publish({"t": spark.range(n)}, root, build, {"rows": {"t": n}})
    assert raw.current(spark, root)["rows"] == {"t": 5} and raw.published(spark, root, "t").count() == 5
    assert raw.current(spark, root)["tables"]["t"]["rows"] == 5 and raw.follow(spark, root, "b2") is None and raw.follow(spark, root, "b1")["build_id"] == "b2"
    with pytest.raises(raw.Shrunk):
        raw.publish({"t": spark.range(4)}, root, "b3", {}, most_lost=0.1)
    assert raw.current(spark, root)["build_id"] == "b2"
    raw.publish({"t": spark.range(5)}, root, "b4", {}, most_lost=0.1)
    prints = {b: raw.current(spark, root)["tables"]["t"] for b in ("b4",)}
    assert prints["b4"]["checksum"] == C.checksum(spark.range(5)).first().checksum and raw.published(spark, root, "t").count() == 5
    assert raw.follow(spark, f"{root}/none") is None
    raw.report_csv(spark.range(2), f"{root}/report")
    raw.append(spark.range(2), f"{root}/log")
    raw.append(spark.range(2), f"{root}/log")
    assert spark.read.parquet(f"{root}/log").count() == 4


def test_checks_and_guards(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    a, b = C.checksum(df).first(), C.checksum(df.repartition(7)).first()
    assert a == b and a.rows == 3 and C.checksum(df.limit(0)).first().checksum == "0"
    n = lambda x: spark.range(1).select(F.lit(x))
    rows = C.all_checks(C.check("same", n(5), n(5)), C.check("near", n(99), n(100), "warn", 0.02), C.check("off", n(1), n(2)))
    assert {r.check_name: r.passed for r in rows.collect()} == {"same": True, "near": True, "off": False}
    assert [r.check_name for r in C.failed_errors(rows).collect()] == ["off"]
    assert C.shrunk({"a": 100, "b": 100}, {"a": 98, "b": 97}) == {"b": (100, 97)}
    assert C.fingerprint({"x": 1}) == C.fingerprint({"x": 1}) != C.fingerprint({"x": 2})
