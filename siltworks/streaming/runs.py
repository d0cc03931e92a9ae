"""Runs of events with gaps between them, from a stream whose rows may come late.

:func:`gap_sessions` is the plain rule, a session ends where nothing follows for a while, as Spark's own session windows. :func:`runs`
also parts events of different kinds after a shorter gap, which no window expresses: a late row may join two runs or
part one, so rows wait in state until nothing can come between them any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GAP_MS, KIND_GAP_MS = 6 * 3_600_000, 3_600_000


def gap_sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """``user_id, n, first_ts, last_ts`` of sessions; a row no more than ``gap`` after another is in its session.

    A stream needs ``late``, the watermark: rows that come later than that are dropped, sessions are given out once
    it has passed their end, and until then late rows still join or lengthen them.
    """
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    if late:
        rows = rows.withWatermark("ts", late)
    # a window ends before its gap does, so one microsecond more makes the gap itself count as within
    found = rows.groupBy("user_id", F.session_window("ts", f"{gap} 1 microsecond")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.select("user_id", "n", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


def split(rows: list[tuple], gap_us: int, kind_gap_us: int) -> list[list[tuple]]:
    """Runs of (time, id, kind) rows in order of time and id; times are microseconds."""
    out: list[list[tuple]] = []
    for row in sorted(rows):
        before = out[-1][-1] if out else None
        if before and row[0] - before[0] <= (gap_us if row[2] == before[2] else kind_gap_us):
            out[-1].append(row)
        else:
            out.append([row])
    return out


_ROW, _OUT = "ts long, event_id long, kind string", "user_id long, run int, n long, first_us long, last_us long"


class _Runs(StatefulProcessor):
    """One user's waiting rows, and how many runs are done."""

    def __init__(self, gap_ms: int, kind_gap_ms: int) -> None:
        self.gap, self.kind_gap = gap_ms * 1000, kind_gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.done = handle.getValueState("done", "runs int")

    def _wake(self, last_us: int) -> None:
        self.handle.registerTimer((last_us + self.gap) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for batch in rows for r in batch[["us", "event_id", "event_type"]].itertuples(index=False, name=None)]
        self.waiting.appendList([(int(t), int(e), k) for t, e, k in new])
        # once the watermark is a gap beyond a row, its run may be over
        for t in {int(t) for t, _, _ in new}:
            self._wake(t)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        known = list(self.waiting.get()) if self.waiting.exists() else []
        found = split([(int(t), int(e), k) for t, e, k in known], self.gap, self.kind_gap)
        n, out = (self.done.get()[0] if self.done.exists() else 0), []
        while found and found[0][-1][0] + self.gap < upto:
            run, n = found.pop(0), n + 1
            out.append((key[0], n, len(run), run[0][0], run[-1][0]))
        if out:
            self.done.update((n,))
            left = [r for run in found for r in run]
            self.waiting.put(left) if left else self.waiting.clear()
            yield pd.DataFrame(out, columns=["user_id", "run", "n", "first_us", "last_us"])

    def close(self) -> None:
        pass


def runs(stream: DataFrame, late: str = "1 day", gap_ms: int = GAP_MS, kind_gap_ms: int = KIND_GAP_MS) -> DataFrame:
    """``user_id, run, n, first_ts, last_ts`` of finished runs of a stream of user_id, event_id, event_type, ts.

    A run ends after ``gap_ms`` without a row, or ``kind_gap_ms`` without one of the same kind. Rows may come up to ``late``
    out of order. A user's rows of the last gap and ``late`` are in state, whatever came before; runs are numbered from 1.
    """
    rows = stream.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = rows.withColumn("us", F.unix_micros("ts"))
    found = rows.groupBy("user_id").transformWithStateInPandas(_Runs(gap_ms, kind_gap_ms), _OUT, "Append", "EventTime")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select("user_id", "run", "n", at("first_us").alias("first_ts"), at("last_us").alias("last_ts"))
