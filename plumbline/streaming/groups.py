"""Streams: append-only run logs, assembly of groups with stale ones dropped, batch cuts, spend monitoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines that appear in a folder of run logs; a run is complete when its end line has come."""
    return spark.readStream.text(folder)


def assemble(stream: DataFrame, size: int, newest: int, bound: int) -> DataFrame:
    """Groups of `size` members as they complete: (group_id, rewards, failed, version, kept).

    stream: group_id, member, status (arrived, failed or cancelled), reward, version. A group is complete when arrived,
    failed and cancelled members make up its size; a member older than newest - 1 - bound is stale and counts as failed.
    kept is false where no member survives or all rewards agree (such groups carry no signal). State per group holds at
    most `size` rewards.
    """
    schema = "group_id long, rewards array<double>, failed int, version long, kept boolean"
    state_schema = "members array<long>, rewards array<double>, failed int, version long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        members, rewards, failed, version = state.get if state.exists else ([], [], 0, 0)
        members, rewards = list(members), list(rewards)
        for frame in frames:
            for row in frame.sort_values("member").itertuples():
                if row.member in members or len(members) >= size:
                    continue
                members.append(row.member)
                version = max(version, row.version)
                if row.status == "arrived" and row.version >= newest - 1 - bound:
                    rewards.append(float(row.reward))
                else:
                    failed += 1
        if len(members) == size and failed >= 0:
            state.update((members, rewards, -1, version))  # complete: what comes later is ignored
            yield pd.DataFrame({"group_id": [key[0]], "rewards": [rewards], "failed": [failed], "version": [version], "kept": [len(set(rewards)) > 1]})
        elif failed >= 0:
            state.update((members, rewards, failed, version))

    return stream.groupBy("group_id").applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def batches(groups: DataFrame, target: int) -> DataFrame:
    """Kept groups cut into batches of at least `target` answers, by group id: batch numbers from 0.

    The cut is a running sum over all groups in their order: a single sequence that can't scale out.
    It runs inside foreachBatch on one micro-batch's groups, not on the corpus.
    """
    done = F.sum(F.size("rewards")).over(Window.orderBy("group_id").rowsBetween(Window.unboundedPreceding, -1))
    return groups.filter("kept").withColumn("batch", F.floor(F.coalesce(done, F.lit(0)) / target).cast("long"))


def spend_alerts(snapshots: DataFrame, limit: float) -> DataFrame:
    """(run_id, at, spent, reason): unreadable, falling and limit-passing usage snapshots of a stream, in each micro-batch."""
    reason = F.when(F.col("spent").isNull() | F.isnan("spent"), "unreadable").when(F.col("spent") < 0, "negative").when(F.col("spent") >= limit, "limit reached")
    return snapshots.withColumn("reason", reason).filter("reason is not null")


def replayed(spark: SparkSession, stream: DataFrame, name: str, each: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Runs a stream over what is there and returns what it appended."""
    writer = stream.writeStream.outputMode("append").trigger(availableNow=True)
    query = writer.format("memory").queryName(name).start() if each is None else writer.foreachBatch(lambda df, _: each(df)).start()
    query.awaitTermination()
    return spark.table(name) if each is None else None
