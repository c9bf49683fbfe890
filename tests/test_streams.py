"""Streams against their batch forms, with late, repeated and stale rows, replays and silence."""

import time

import pytest
from pyspark.sql import functions as F

from plumbline.plans import streams
from plumbline.streaming import finalise, spend, steps

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def in_batches(spark, df, cuts, folder, key):
    """A stream of df in micro-batches cut by key."""
    df = df.cache()
    bounds = [None, *cuts, None]
    for n, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        part = df if low is None else df.filter(F.col(key) >= low)
        part = part if high is None else part.filter(F.col(key) < high)
        part.coalesce(1).write.parquet(f"{folder}/part={n}")
        time.sleep(0.01)  # files are taken in the order of their times
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def ran(stream, name, where, rows=None):
    """What the stream appends; with timers it never ends by itself, so it is stopped after so many rows."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(where))
    query = writer.trigger(availableNow=True).start() if rows is None else writer.trigger(processingTime="500 milliseconds").start()
    until = time.time() + 90
    while query.isActive and time.time() < until and (rows is None or stream.sparkSession.table(name).count() < rows):
        time.sleep(0.3)
    query.stop()
    return stream.sparkSession.table(name)


def told(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("cuts", [[], [300, 700, 701, 1500]])
def test_groups_of_events(spark, tmp_path, cuts):
    events = spark.read.parquet(f"{SF}/events.parquet")
    members, policy = streams.members_of(events), streams.policy_of(events)
    want = finalise.decided(members, policy, streams.SIZE, streams.BOUND)
    a, b = (in_batches(spark, df, cuts, f"{tmp_path}/{name}", "seq") for name, df in (("members", members), ("policy", policy)))
    got = ran(finalise.finalised(a, b, streams.SIZE, streams.BOUND, shards=3), f"groups{len(cuts)}", tmp_path / "state")
    assert told(got) == told(want) and got.count() > 200


def members_and_policy(spark):
    members = []
    for group, versions in ((1, (5, 5, 5)), (2, (3, 5, 5)), (3, (5, 5, 4)), (4, (5, 5, 5)), (5, (5, 5, 5)), (6, (5, 5, 5))):
        members += [("a", 100 * group + m, group, m, "arrived", float(m), v) for m, v in enumerate(versions)]
    members += [("a", 150, 1, 2, "arrived", 9.0, 5), ("a", 151, 1, 7, "arrived", 9.0, 5)]  # told twice, and one too many
    members += [("a", 101, 7, 0, "arrived", 1.0, 5), ("a", 102, 7, 1, "failed", None, None), ("a", 103, 7, 2, "errored", None, 5)]
    members += [("a", 111, 8, 0, "arrived", 1.0, 5), ("a", 112, 8, 1, "stale", None, None), ("a", 113, 8, 2, "cancelled", None, None)]
    members += [("b", 1, 9, 0, "arrived", 1.0, 0), ("b", 2, 9, 1, "arrived", 3.0, 0), ("b", 3, 9, 2, "arrived", 2.0, 0), ("b", 4, 10, 0, "arrived", 1.0, 0)]
    policy = [("a", 10, finalise.ADVANCE, None, 6), ("a", 350, finalise.ADVANCE, None, 7), ("a", 450, finalise.SHIP, 4, None), ("a", 451, finalise.SHIP, 77, None), ("a", 460, finalise.ADVANCE, None, 6), ("a", 520, finalise.ADVANCE, None, 9), ("a", 700, finalise.ADVANCE, None, 20)]
    return spark.createDataFrame(members, finalise.MEMBERS), spark.createDataFrame(policy, finalise.POLICY)


def test_decisions(spark, tmp_path):
    members, policy = members_and_policy(spark)
    out = finalise.decided(members, policy, 3, 1, least=0.5)
    got = {(r.group_id, r.member, r.decision): r.seq for r in out.collect()}
    assert {k[2] for k in got if k[0] == 8} == {"void"} and {k[1:] for k in got if k[0] == 7} == {(0, "no signal"), (1, "no trace"), (2, "no trace")}
    assert (2, 0, "stale on arrival") in got and got[2, 2, "swept"] == 520 and (2, 1, "no signal") in got
    assert got[4, 0, "shipped"] == 450 and got[1, 0, "swept"] == 520 and got[3, 2, "swept"] == 350
    assert got[6, 0, "stale on arrival"] == 602 and {k for k in got if k[0] == 10} == set()
    assert not any(k[0] == 9 and k[2] == "swept" for k in got)  # the other run's policy never moved
    a, b = in_batches(spark, members, [150, 400, 600], f"{tmp_path}/members", "seq"), in_batches(spark, policy, [150, 400, 600], f"{tmp_path}/policy", "seq")
    assert told(ran(finalise.finalised(a, b, 3, 1, least=0.5, shards=2), "decisions", tmp_path / "state")) == told(out)
    high = {r.decision for r in finalise.decided(members, policy, 3, 1, least=1.5).filter("group_id = 1").collect()}
    assert high == {"not admitted"}


def test_empty_logs(spark):
    members, policy = members_and_policy(spark)
    assert finalise.decided(members.limit(0), policy, 3, 1).count() == 0
    alone = finalise.decided(members, policy.limit(0), 3, 1)
    assert alone.filter("decision in ('swept', 'shipped', 'stale on arrival')").count() == 0 and alone.filter("decision = 'queued'").count() > 0


SNAPSHOTS = [
    *(("limit", float(t), 10.0 * t, "running") for t in range(12)),
    *(("falls", float(t), s, "running") for t, s in enumerate((1.0, 5.0, 4.0, 90.0))),
    ("unread", 0.0, 1.0, "running"), ("unread", 1.0, None, "running"), ("nan", 0.0, float("nan"), "running"), ("negative", 0.0, -1.0, "running"),
    ("no status", 0.0, 1.0, "running"), ("no status", 1.0, 1.0, None), ("ends", 0.0, 1.0, "running"), ("ends", 1.0, 85.0, "completed"), ("ends", 2.0, 86.0, "running"),
    *(("long", float(t), 1.0, "running") for t in range(0, 60, 5)), ("fine", 0.0, 1.0, "running"), ("fine", 3.0, 1.0, "running"),
]


def test_spend_stops(spark, tmp_path):
    df = spark.createDataFrame(SNAPSHOTS, spend.SNAPSHOTS)
    want = spend.stopped(df, 100.0, 20.0, 50.0, 1000.0)
    reasons = {r.run_id: (r.at, r.spent, r.reason) for r in want.collect()}
    assert reasons == {
        "limit": (8.0, 80.0, spend.LIMIT), "falls": (2.0, 5.0, spend.INVALID), "unread": (1.0, 1.0, spend.INVALID), "nan": (0.0, 0.0, spend.INVALID), "negative": (0.0, 0.0, spend.INVALID),
        "no status": (1.0, 1.0, spend.INVALID), "ends": (1.0, 85.0, spend.ENDED), "long": (50.0, 1.0, spend.RUNTIME),
    }
    stream = in_batches(spark, df, [2.0, 9.0], f"{tmp_path}/in", "at")
    assert told(ran(spend.watched(stream, 100.0, 20.0, 50.0, 1000.0), "stops", tmp_path / "state", want.count())) == told(want)
    gap = {r.run_id: r.at for r in spend.stopped(df, 100.0, 20.0, 1000.0, 2.5).collect()}
    assert gap["fine"] == 0.0 and gap["long"] == 0.0
    with pytest.raises(ValueError):
        spend.trigger(10.0, 10.0, 1.0)


def test_silence_stops(spark, tmp_path):
    df = spark.createDataFrame([("quiet", 0.0, 1.0, "running"), ("done", 0.0, 1.0, "completed")], spend.SNAPSHOTS)
    stream = in_batches(spark, df, [], f"{tmp_path}/in", "at")
    ran(spend.watched(stream, 100.0, 20.0, 1e9, 2.0), "silence", tmp_path / "state", 2)
    assert {(r.run_id, r.at, r.reason) for r in spark.table("silence").collect()} == {("done", 0.0, spend.ENDED), ("quiet", None, spend.INVALID)}


def test_replayed_batches_count_once(spark, tmp_path):
    answers = streams.answers_of(spark.read.parquet(f"{SF}/events.parquet")).cache()
    days = [r.batch for r in answers.select("batch").distinct().orderBy("batch").limit(4).collect()]
    sink = steps.StepMetrics(f"{tmp_path}/steps")
    for n, day in enumerate(days):
        sink(answers.filter(F.col("batch") == day), n)
    told_ = lambda df: told(df.withColumn("reward", F.round("reward", 9)))
    once = told_(steps.totals(spark, f"{tmp_path}/steps"))
    sink(answers.filter(F.col("batch") == days[3]), 3)  # a replay of the last and of an older batch
    sink(answers.filter(F.col("batch") == days[1]), 1)
    assert told_(steps.totals(spark, f"{tmp_path}/steps")) == once
    number = F.dense_rank().over(streams.Window.orderBy("batch")) - 1
    want = steps.running(steps.metrics_by(answers.filter(F.col("batch") <= days[3]), ["batch"]).withColumn("batch", number.cast("int")))
    assert once == told_(want.withColumn("batch", F.col("batch").cast("int")))


def test_step_metrics_in_a_stream(spark, tmp_path):
    answers = streams.answers_of(spark.read.parquet(f"{SF}/events.parquet")).drop("batch").withColumn("n", F.col("group_id"))
    stream = in_batches(spark, answers, [5, 10], f"{tmp_path}/in", "n")
    sink = steps.StepMetrics(f"{tmp_path}/steps")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(300)
    last = steps.totals(spark, f"{tmp_path}/steps").filter("scope = 'agg' and subset = 'all'").orderBy(F.desc("batch")).first()
    assert last.batch == 2 and last.total_answers == answers.count()
