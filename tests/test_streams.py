import datetime as dt
import random

from pyspark.sql import functions as F

from siltworks.plans import marts
from siltworks.streaming import requeue as Q, runs as S
from siltworks.streaming.stateful import drain, timers

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def in_drops(spark, df, folder, drops):
    """``df`` written as files in the order of ``drop``; a stream that takes one file at a time reads them so."""
    for k in range(drops):
        df.where(F.col("drop") == k).drop("drop").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, df, folder):
    return spark.readStream.schema(df.drop("drop").schema).option("maxFilesPerTrigger", 1).parquet(folder)


def late_events(spark, days=2):
    """Events in drops by day, each put off by up to a day; last of all an event far ahead, which closes everything."""
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    late = F.pmod(F.xxhash64("event_id"), F.lit(86_400))
    day = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) + late - 1_704_067_200) / (86_400 * days)).cast("int")
    n = 17
    far = spark.createDataFrame([(-1, -1, "end", dt.datetime(2030, 1, 1), n), (-1, -2, "end", dt.datetime(2030, 1, 2), n + 1)], "user_id long, event_id long, event_type string, ts timestamp_ntz, drop int")
    return e, e.withColumn("drop", F.least(day, F.lit(n - 1))).unionByName(far), n + 2


def test_runs_with_late_rows_equal_the_batch(spark, tmp_path):
    e, df, n = late_events(spark)
    folder, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    in_drops(spark, df.where("drop < 8"), folder, 8)
    drain(S.runs(stream(spark, df, folder)), sink, ck)
    some = spark.read.parquet(sink).where("user_id >= 0").count()
    # the stream stopped and starts again from its checkpoint
    for k in range(8, n):
        df.where(F.col("drop") == k).drop("drop").coalesce(1).write.mode("append").parquet(folder)
    drain(S.runs(stream(spark, df, folder)), sink, ck)
    got = spark.read.parquet(sink).where("user_id >= 0")
    want = marts.QUERIES["sessionize_runs"](spark, SF).select("user_id", "run", "n", "first_ts", "last_ts")
    assert as_rows(got) == as_rows(want) and 0 < some < got.count()


def test_gap_sessions_with_late_rows_equal_the_batch(spark, tmp_path):
    e, df, n = late_events(spark)
    folder, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    in_drops(spark, df, folder, n)
    S_ = S.gap_sessions(stream(spark, df, folder), late="1 day")
    drain(S_, sink, ck)
    assert as_rows(spark.read.parquet(sink).where("user_id >= 0")) == as_rows(S.gap_sessions(e))


def test_split():
    h = 3_600_000_000
    rows = [(0, 1, "a"), (6 * h, 2, "a"), (12 * h + 1, 3, "a"), (13 * h + 1, 4, "b"), (14 * h + 2, 5, "a")]
    assert [[r[1] for r in run] for run in S.split(rows[::-1], 6 * h, h)] == [[1, 2], [3, 4], [5]]
    assert S.split([], 1, 1) == []


def decisions(spark):
    r, start, rows = random.Random(4), dt.datetime(2024, 1, 1), []
    for k in range(600):
        at = start + dt.timedelta(minutes=r.randint(0, 1500), seconds=r.randint(0, 59))
        late = r.randint(0, 50)
        out = r.random() < 0.6
        rows.append((k, r.randint(1, 20), f"e{r.randint(1, 8)}", "possible" if out or r.random() < 0.3 else "matched", "rule", "unavailable" if out else "rules", r.random() < 0.1 if out else None, at, int((at - start).total_seconds() / 60 + late) // 100))
    far = [(9000 + k, -1, "end", "matched", "rule", "rules", None, dt.datetime(2030, 1, 1 + k), 16 + k) for k in range(2)]
    return spark.createDataFrame(rows + far, "decision_id long, sub_id long, entity_key string, bucket string, method string, decided_by string, needs_adjudication boolean, decided_at timestamp_ntz, drop int")


def test_requeue_equals_the_batch_and_goes_on(spark, tmp_path):
    df = decisions(spark)
    folder, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for first, upto in ((0, 6), (6, 18)):
        for k in range(first, upto):
            df.where(F.col("drop") == k).drop("drop").coalesce(1).write.mode("append").parquet(folder)
        drain(Q.requeue(stream(spark, df, folder)), sink, ck)
    want = as_rows(Q.requeued(df, F.lit(dt.datetime(2029, 1, 1))))
    assert as_rows(spark.read.parquet(sink)) == want and len(want) > 50


def test_requeue_by_the_clock(spark, tmp_path):
    old = dt.datetime(2024, 1, 1)
    rows = [(1, 1, "a", "possible", "rule", "unavailable", False, old), (2, 1, "b", "possible", "rule", "unavailable", False, old), (3, 1, "b", "matched", "user", "someone", None, old + dt.timedelta(minutes=1)), (4, 1, "c", "possible", "rule", "unavailable", False, dt.datetime(2100, 1, 1))]
    df = spark.createDataFrame(rows, "decision_id long, sub_id long, entity_key string, bucket string, method string, decided_by string, needs_adjudication boolean, decided_at timestamp_ntz")
    folder, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    df.coalesce(1).write.parquet(folder)
    for _ in range(2):  # the second run goes on from the first one's checkpoint
        with timers(spark):
            q = Q.requeue(stream(spark, df, folder), by_clock=True).writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck).trigger(processingTime="1 second").start()
        q.awaitTermination(20)
        q.stop()
    assert [r.entity_key for r in spark.read.parquet(sink).collect()] == ["a"]  # b was decided, c is not due yet
