"""Finalisation of groups of answers in a stream, with the newest policy version as a watermark.

Two streams meet here: what becomes of the members of groups, and what happens to the policy. A group is decided when as
many members as it has have arrived, failed or been cancelled; its kept members then wait in a queue until they are
shipped, or until the policy has moved so far that they are stale. Late data is told by version, not by time: a member of
version v may be trained while newest - 1 - v <= bound.

Groups of a run are dealt over shards; a change of the policy goes to each of them. So a run isn't one task's work, and a
shard knows the newest version without asking others. State holds the groups that wait for members (dropped after
`patience_ms`, if the rest never comes) and the members that wait to be shipped.

`decided` is the same for a finished log: the test holds the stream against it, SQL holds it against the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Columns of the two streams.
MEMBERS = "run string, seq long, group_id long, member long, status string, reward double, version long"
POLICY = "run string, seq long, event string, group_id long, version long"
DECISIONS = "run string, group_id long, member long, seq long, decision string, version long"
#: What becomes of a member: trainable, arrived without a usable trace, request failed, cancelled, cancelled as stale.
STATUSES = ("arrived", "errored", "failed", "cancelled", "stale")
#: What happens to the policy: a newer version, or a group that went out with a batch.
ADVANCE, SHIP = "advance", "ship"


def together(members: DataFrame, policy: DataFrame, shards: int = 16) -> DataFrame:
    """Both streams as one, by shard: members and shipped groups go to their group's shard, newer versions to all."""
    shard = F.pmod(F.xxhash64("group_id"), F.lit(shards)).cast("int")
    a = members.select("run", shard.alias("shard"), "seq", F.col("status").alias("kind"), "group_id", "member", "reward", "version")
    everywhere = F.when(F.col("event") == ADVANCE, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(shard))
    b = policy.select("run", F.explode(everywhere).alias("shard"), "seq", F.col("event").alias("kind"), "group_id", F.lit(None).cast("long").alias("member"), F.lit(None).cast("double").alias("reward"), "version")
    return a.unionByName(b)


def verdict(members: list[tuple], newest: int, bound: int, least: float | None, prune: bool) -> list[tuple]:
    """(member, decision, version) of a complete group's members (member, status, reward, version).

    One cancelled as stale voids its whole group. Otherwise members without a usable trace are dropped; a group whose mean
    reward is below `least` isn't admitted; with prune, members whose reward is the group's mean have no signal; members
    that are stale already are dropped; the rest is queued.
    """
    void = any(status == "stale" for _, status, _, _ in members)
    rewards = [reward for _, status, reward, _ in members if status == "arrived"]
    mean = sum(rewards) / len(rewards) if rewards else None
    out = []
    for member, status, reward, version in members:
        if void:
            decision = "void"
        elif status != "arrived":
            decision = "no trace"
        elif least is not None and mean < least:
            decision = "not admitted"
        elif prune and reward == mean:
            decision = "no signal"
        elif version < newest - 1 - bound:
            decision = "stale on arrival"
        else:
            decision = "queued"
        out.append((member, decision, version))
    return out


class Finaliser(StatefulProcessor):
    """State of one shard of a run: the newest version, groups that wait for members, members that wait for a batch."""

    def __init__(self, size: int, bound: int, least: float | None, prune: bool, patience_ms: int | None):
        self.size, self.bound, self.least, self.prune, self.patience_ms = size, bound, least, prune, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "version long")
        lists = "member array<long>, status array<string>, reward array<double>, version array<long>"
        self.open = handle.getMapState("open", "group_id long", lists, self.patience_ms)
        self.queue = handle.getMapState("queue", "group_id long", "member array<long>, version array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        newest = self.newest.get()[0] if self.newest.exists() else 0
        out = []
        for row in new.itertuples():
            group = None if pd.isna(row.group_id) else int(row.group_id)
            if row.kind == ADVANCE:
                if row.version > newest:
                    newest = int(row.version)
                    out += self.sweep(key[0], int(row.seq), newest)
            elif row.kind == SHIP:
                if self.queue.containsKey((group,)):
                    members, versions = self.queue.getValue((group,))
                    out += [(key[0], group, m, int(row.seq), "shipped", v) for m, v in zip(members, versions, strict=True)]
                    self.queue.removeKey((group,))
            else:
                out += self.arrived(key[0], group, row, newest)
        self.newest.update((newest,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISIONS.split(", ")]).astype({"version": "Int64"})

    def arrived(self, run: str, group: int, row, newest: int) -> list[tuple]:
        member, status, reward, version = (list(x) for x in self.open.getValue((group,))) if self.open.containsKey((group,)) else ([], [], [], [])
        if row.member in member:
            return []  # told twice
        member.append(int(row.member))
        status.append(row.kind)
        reward.append(None if pd.isna(row.reward) else float(row.reward))
        version.append(None if pd.isna(row.version) else int(row.version))
        if len(member) < self.size:
            self.open.updateValue((group,), (member, status, reward, version))
            return []
        if self.open.containsKey((group,)):
            self.open.removeKey((group,))
        told = verdict(list(zip(member, status, reward, version, strict=True)), newest, self.bound, self.least, self.prune)
        kept = [(m, v) for m, decision, v in told if decision == "queued"]
        if kept:
            self.queue.updateValue((group,), ([m for m, _ in kept], [v for _, v in kept]))
        return [(run, group, m, int(row.seq), decision, v) for m, decision, v in told]

    def sweep(self, run: str, seq: int, newest: int) -> list[tuple]:
        """Takes members past the bound out of the queue."""
        out, left = [], {}
        for (group,), (members, versions) in list(self.queue.iterator()):
            fresh = [(m, v) for m, v in zip(members, versions, strict=True) if v >= newest - 1 - self.bound]
            if len(fresh) < len(members):
                left[group] = fresh
                out += [(run, group, m, seq, "swept", v) for m, v in zip(members, versions, strict=True) if v < newest - 1 - self.bound]
        for group, fresh in left.items():
            if fresh:
                self.queue.updateValue((group,), ([m for m, _ in fresh], [v for _, v in fresh]))
            else:
                self.queue.removeKey((group,))
        return out

    def close(self) -> None:
        pass


def finalised(members: DataFrame, policy: DataFrame, size: int, bound: int, least: float | None = None, prune: bool = True, shards: int = 16, patience_ms: int | None = None) -> DataFrame:
    """A stream of DECISIONS, for streams of MEMBERS and POLICY whose micro-batches come in the order of seq.

    patience_ms: how long a group waits for its members by the processing clock (for ever, if None). Needs RocksDB as
    state store, which sweeps a shard's queue without rewriting it.
    """
    rows = together(members, policy, shards)
    return rows.groupBy("run", "shard").transformWithStateInPandas(
        statefulProcessor=Finaliser(size, bound, least, prune, patience_ms), outputStructType=DECISIONS, outputMode="Append", timeMode="None" if patience_ms is None else "ProcessingTime"
    )


def decided(members: DataFrame, policy: DataFrame, size: int, bound: int, least: float | None = None, prune: bool = True) -> DataFrame:
    """The same DECISIONS for whole logs. Members count once, as first told; groups that miss members are undecided.

    One shuffle by group decides the groups. What was newest when a group completed, and what first made its members
    stale, come from as-of joins with the run's versions (`ordered`), which deal a large run over many tasks.
    """
    first = Window.partitionBy("run", "group_id", "member").orderBy("seq", "status")
    rows = members.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    group = Window.partitionBy("run", "group_id")
    place = F.row_number().over(group.orderBy("seq", "member"))
    rows = rows.withColumn("_place", place).filter(F.col("_place") <= size)
    rows = rows.withColumns({
        "_done": F.max("seq").over(group), "_n": F.count("*").over(group), "_void": F.bool_or(F.col("status") == "stale").over(group),
        "_mean": F.avg(F.when(F.col("status") == "arrived", F.col("reward"))).over(group),
    }).filter(F.col("_n") == size)
    advances = policy.filter(F.col("event") == ADVANCE).select("run", "seq", "version")
    rows = newest_at(rows, advances, "_done", "_newest")
    ships = policy.filter(F.col("event") == SHIP).select("run", "group_id", F.col("seq").alias("_ship"))
    stale = F.col("version") < F.col("_newest") - 1 - bound
    rejected = F.lit(False) if least is None else F.col("_mean") < least
    flat = (F.col("reward") == F.col("_mean")) if prune else F.lit(False)
    decision = F.when(F.col("_void"), "void").when(F.col("status") != "arrived", "no trace").when(rejected, "not admitted").when(flat, "no signal").when(stale, "stale on arrival").otherwise("queued")
    told = rows.withColumn("decision", decision)
    queued = told.filter("decision = 'queued'").select("run", "group_id", "member", "version", "_done")
    shipped = queued.select("run", "group_id", "_done").distinct().join(ships, ["run", "group_id"]).filter("_ship > _done").groupBy("run", "group_id").agg(F.min("_ship").alias("_ship"))
    queued = first_beyond(queued.withColumn("_limit", F.col("version") + 1 + bound), advances, "_limit", "_swept").join(shipped, ["run", "group_id"], "left")
    swept = F.coalesce(F.col("_swept") < F.col("_ship"), F.col("_swept").isNotNull())
    left = queued.withColumns({"seq": F.when(swept, F.col("_swept")).otherwise(F.col("_ship")), "decision": F.when(swept, "swept").otherwise("shipped")}).filter("seq is not null")
    names = [c.split()[0] for c in DECISIONS.split(", ")]
    return told.drop("seq").withColumnRenamed("_done", "seq").select(names).unionByName(left.select(names))


def newest_at(rows: DataFrame, advances: DataFrame, at: str, name: str) -> DataFrame:
    """rows with the newest version of their run before `at` (0 if none): both in one order, by run."""
    return ordered(rows, advances, at, F.col("seq"), F.col("version"), name, F.lit(0))


def first_beyond(rows: DataFrame, advances: DataFrame, limit: str, name: str) -> DataFrame:
    """rows with the seq of the first advance of their run whose version exceeds `limit` (null if none).

    Versions only grow, so the first one beyond a limit is the one with the least version beyond it, at its first seq.
    """
    rising = advances.withColumn("_top", F.max("version").over(Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    rising = rising.filter("_top is null or version > _top").drop("_top")
    return ordered(rows, rising, limit, F.col("version"), F.col("seq"), name, F.lit(None).cast("long"), after=True)


def ordered(rows: DataFrame, others: DataFrame, at: str, key: Column, value: Column, name: str, otherwise: Column, after: bool = False) -> DataFrame:
    """An as-of join by run: rows with the value of the last of `others` before `at`, or of the first after it.

    Others are distinct keys of a run; each covers the range up to its neighbour. Ranges are cut at the bounds of as many
    equal buckets as the run has keys, so a row meets only the ranges of its bucket and a run is dealt over its buckets.
    """
    w = Window.partitionBy("_run").orderBy("_k")
    spans = others.select(F.col("run").alias("_run"), key.alias("_k"), value.alias("_v"))
    base = spans.groupBy("_run").agg(F.min("_k").alias("_base"), F.greatest(F.lit(1), F.ceil((F.max("_k") - F.min("_k") + 1) / F.count("*"))).cast("long").alias("_width"), F.count("*").alias("_keys"))
    bucket = lambda x: F.least(F.greatest(F.floor((x - F.col("_base")) / F.col("_width")), F.lit(-1)), F.col("_keys") + 1).cast("long")
    if after:
        spans = spans.select("_run", F.coalesce(F.lag("_k").over(w), F.lit(-(1 << 60))).alias("_low"), (F.col("_k") - 1).alias("_high"), "_v")
    else:
        spans = spans.withColumn("_v", F.max("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        spans = spans.select("_run", (F.col("_k") + 1).alias("_low"), F.coalesce(F.lead("_k").over(w), F.lit(1 << 60)).alias("_high"), "_v")
    spans = spans.join(base, "_run").select("_run", "_low", "_high", "_v", F.explode(F.sequence(bucket(F.col("_low")), bucket(F.col("_high")))).alias("_bucket"))
    told = rows.join(base.withColumnRenamed("_run", "_of"), F.col("run") == F.col("_of"), "left").withColumn("_at", bucket(F.col(at))).drop("_of", "_base", "_width", "_keys")
    here = (F.col("run") == F.col("_run")) & (F.col("_at") == F.col("_bucket")) & (F.col(at) >= F.col("_low")) & (F.col(at) <= F.col("_high"))
    return told.join(spans, here, "left").withColumn(name, F.coalesce("_v", otherwise)).drop("_run", "_low", "_high", "_v", "_bucket", "_at")
