"""Records whose decision could not be made go back after a while: a timer for each, put off or dropped by later decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WAIT_MINUTES = 30
UNAVAILABLE = "unavailable"
_OUT = "sub_id long, entity_key string, decided_us long, due_us long"


def stranded() -> Column:
    """Whether a decision is one that could not be made: left possible by the rules, decided by no one, and not waiting already."""
    left = (F.col("decided_by") == UNAVAILABLE) & (F.col("method") == "rule") & (F.col("bucket") == "possible") & ~F.coalesce("needs_adjudication", F.lit(False))
    return F.coalesce(left, F.lit(False))


class _Timers(StatefulProcessor):
    """A record's decisions from the first that still waits on, the newest in any case, and a timer for each that is stranded."""

    def __init__(self, wait_ms: int, by_clock: bool) -> None:
        self.wait, self.by_clock = wait_ms, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getListState("known", "decided_us long, decision_id long, timer_ms long")

    def _rows(self) -> list[tuple[int, int, int]]:
        return sorted(tuple(map(int, r)) for r in self.known.get()) if self.known.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._rows()
        for us, decision_id, waits in (r for batch in rows for r in batch[["us", "decision_id", "stranded"]].itertuples(index=False, name=None)):
            timer = 0
            if waits:
                timer = int(us) // 1000 + self.wait + 1
                if self.by_clock:
                    timer = max(timer, timerValues.getCurrentProcessingTimeInMs() + 1)
                self.handle.registerTimer(timer)
            known.append((int(us), int(decision_id), timer))
        self.known.put(sorted(known))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, out, now = self._rows(), [], expiredTimerInfo.getExpiryTimeInMs()
        for k, (us, decision_id, timer) in enumerate(known):
            if timer and timer <= now:
                after = known[k + 1][0] if k + 1 < len(known) else None
                if after is None or (not self.by_clock and after > us + self.wait * 1000):
                    out.append((key[0], key[1], us, us + self.wait * 1000))
                known[k] = us, decision_id, 0
        seen = 0 if self.by_clock else timerValues.getCurrentWatermarkInMs() * 1000
        first = next((k for k, r in enumerate(known) if r[2] or (seen and r[0] >= seen)), len(known) - 1)
        self.known.put(known[first:])
        if out:
            yield pd.DataFrame(out, columns=["sub_id", "entity_key", "decided_us", "due_us"])

    def close(self) -> None:
        pass


def requeue(stream: DataFrame, minutes: int = WAIT_MINUTES, late: str = "1 hour", by_clock: bool = False) -> DataFrame:
    """``sub_id, entity_key, decided_at`` of records that have waited, each once for the decision that stranded it.

    ``stream`` has decision_id, sub_id, entity_key, bucket, method, decided_by, needs_adjudication, decided_at. A record goes back unless
    another decision came before its time was up, by decided_at and then decision_id, in whatever order they arrive. By the
    clock, time is up when the clock says so, and any later decision that has arrived counts; otherwise when the watermark, ``late``
    behind the newest decision, has passed it, which gives the same rows at every run.
    """
    keyed = stream.select("decision_id", "sub_id", "entity_key", F.col("decided_at").cast("timestamp").alias("decided_at"), stranded().alias("stranded")).withColumn("us", F.unix_micros("decided_at"))
    if not by_clock:
        keyed = keyed.withWatermark("decided_at", late)
    out = keyed.groupBy("sub_id", "entity_key").transformWithStateInPandas(_Timers(minutes * 60_000, by_clock), _OUT, "Append", "ProcessingTime" if by_clock else "EventTime")
    return out.select("sub_id", "entity_key", F.timestamp_micros("decided_us").cast("timestamp_ntz").alias("decided_at"))


def requeued(decisions: DataFrame, now: Column, minutes: int = WAIT_MINUTES) -> DataFrame:
    """The same over a finished table: records whose latest decision by ``now`` stranded them ``minutes`` ago or more.

    A decision that came after a record had gone back doesn't take that back: what counts is whether its time was up before the next.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("sub_id", "entity_key").orderBy("decided_at", "decision_id")
    rows = decisions.select("decision_id", "sub_id", "entity_key", F.col("decided_at").cast("timestamp").alias("decided_at"), stranded().alias("stranded"))
    due = F.col("decided_at") + F.make_dt_interval(mins=F.lit(minutes))
    rows = rows.withColumns({"due": due, "next": F.lead("decided_at").over(w)})
    done = rows.where(F.col("stranded") & (F.col("due") < now) & (F.col("next").isNull() | (F.col("next") > F.col("due"))))
    return done.select("sub_id", "entity_key", F.col("decided_at").cast("timestamp_ntz").alias("decided_at"))
