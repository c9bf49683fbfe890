"""A spend monitor: usage snapshots of runs in, one reason to stop per run out.

A run is to be stopped when its recorded spend reaches the limit less a reserve, when it has run for its longest time,
and when its usage can't be trusted: a snapshot that is unreadable, lacks a status, is negative or falls, or none for
`silence` seconds. A terminal status ends the watch. Stopping itself is up to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Snapshots: at in seconds; spent is null where it couldn't be read.
SNAPSHOTS = "run_id string, at double, spent double, status string"
STOPS = "run_id string, at double, spent double, reason string"
# Terminal states and the reasons in their order.
TERMINAL = ("STOPPED", "COMPLETED", "FAILED", "CANCELLED", "CANCELED")
INVALID, LIMIT, RUNTIME, ENDED = "usage unavailable or invalid", "recorded spend limit", "runtime limit", "terminal"


def trigger(limit: float, reserve: float, longest: float) -> float:
    """The spend at which a run is stopped; a policy that makes no sense is refused."""
    if not (reserve >= 0 and limit - reserve > 0 and longest > 0):
        raise ValueError("invalid guard policy")
    return limit - reserve


class Monitor(StatefulProcessor):
    """State of a run: its last good spend, when it was first and last heard of, whether it is decided."""

    def __init__(self, trigger: float, longest: float, silence: float):
        self.trigger, self.longest, self.silence = trigger, longest, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "spent double, began double, decided boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("at", kind="stable")
        spent, began, done = self.state.get() if self.state.exists() else (0.0, float(new["at"].iloc[0]), False)
        out = []
        for row in new.itertuples():
            if done:
                break
            good = row.spent is not None and row.spent == row.spent and abs(row.spent) != float("inf") and row.spent >= max(spent, 0.0) and bool(row.status)
            if not good:
                reason = INVALID
            elif row.status.upper() in TERMINAL:
                reason = ENDED
            elif row.spent >= self.trigger:
                reason = LIMIT
            elif row.at - began >= self.longest:
                reason = RUNTIME
            else:
                reason = None
            spent = float(row.spent) if good else spent
            if reason:
                done = True
                out.append((key[0], float(row.at), spent, reason))
        self.state.update((spent, began, done))
        self.timers(timerValues.getCurrentProcessingTimeInMs(), done)
        yield pd.DataFrame(out, columns=["run_id", "at", "spent", "reason"])

    def timers(self, now: int, done: bool) -> None:
        """The timer of silence starts anew; that of the run's time was set when it was first heard of."""
        set_ = [t for (t,) in self._timers()]
        for t in set_:
            self.handle.deleteTimer(t)
        if not done:
            self.handle.registerTimer(now + int(1000 * self.silence))

    def _timers(self) -> list[tuple]:
        return [(t if isinstance(t, int) else t[0],) for t in self.handle.listTimers()]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spent, began, done = self.state.get()
        if not done:
            self.state.update((spent, began, True))
            yield pd.DataFrame([(key[0], None, spent, INVALID)], columns=["run_id", "at", "spent", "reason"]).astype({"at": float})

    def close(self) -> None:
        pass


def watched(snapshots: DataFrame, limit: float, reserve: float, longest: float, silence: float) -> DataFrame:
    """A stream of STOPS, at most one per run; `at` is null where a run fell silent (by the processing clock)."""
    guard = Monitor(trigger(limit, reserve, longest), longest, silence)
    return snapshots.groupBy("run_id").transformWithStateInPandas(statefulProcessor=guard, outputStructType=STOPS, outputMode="Append", timeMode="ProcessingTime")


def good(spent: Column, status: Column, before: Column) -> Column:
    known = spent.isNotNull() & ~F.isnan(spent.cast("double")) & (F.abs(spent.cast("double")) != F.lit(float("inf")))
    return F.coalesce(known & (spent >= F.greatest(before, F.lit(0))) & (F.coalesce(status, F.lit("")) != ""), F.lit(False))


def stopped(snapshots: DataFrame, limit: float, reserve: float, longest: float, silence: float) -> DataFrame:
    """The same STOPS for whole logs, in which silence is a gap between snapshots; `at` is then the last one's.

    Until the first bad snapshot all spends are good, so the one before is simply the row before; what comes after the
    first reason is dropped.
    """
    w = Window.partitionBy("run_id").orderBy("at")
    ok = good(F.col("spent"), F.col("status"), F.coalesce(F.lag("spent").over(w), F.lit(0)))
    rows = snapshots.withColumns({"_ok": ok, "_before": F.lag("spent").over(w), "_began": F.min("at").over(Window.partitionBy("run_id")), "_next": F.lead("at").over(w)})
    by_row = (
        F.when(~F.col("_ok"), INVALID)
        .when(F.upper("status").isin(*TERMINAL), ENDED)
        .when(F.col("spent") >= trigger(limit, reserve, longest), LIMIT)
        .when(F.col("at") - F.col("_began") >= longest, RUNTIME)
        .when(F.col("_next") - F.col("at") > silence, INVALID)
    )
    told = rows.withColumn("reason", by_row).withColumn("spent", F.when(F.col("_ok"), F.col("spent")).otherwise(F.coalesce("_before", F.lit(0))))
    return told.filter("reason is not null").groupBy("run_id").agg(F.min_by(F.struct("at", "spent", "reason"), "at").alias("s")).select("run_id", "s.*")
