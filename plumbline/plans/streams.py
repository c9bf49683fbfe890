"""Queries: what the streams compute, over the whole event log at once."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.plans.registry import register, table
from plumbline.streaming import finalise, spend, steps

SIZE, BOUND = 4, 1
ROUND = 500  # events between two policy versions


def members_of(events):
    """Events as members: four of a user's events in a row are a group, policy versions grow with the event id."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = events.withColumns({"nth": nth, "version": F.floor(F.col("event_id") / ROUND) - F.floor(F.col("value") * 100) % 3})
    status = F.when(F.col("event_id") % 211 == 0, "stale").when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 13 == 0, "errored").otherwise("arrived")
    reward = F.when(status == "arrived", (F.floor(F.col("value") * 100) % 4).cast("double"))
    group = F.col("user_id") * 1_000_000 + F.floor(F.col("nth") / SIZE)
    return rows.select(F.lit("r").alias("run"), (2 * F.col("event_id") + 1).alias("seq"), group.alias("group_id"), (F.col("nth") % SIZE).cast("long").alias("member"), status.alias("status"), reward.alias("reward"), "version")


def policy_of(events):
    """Every ROUND events a newer version; a user's next group ships the one before, if its event id is even."""
    advance = events.filter(F.col("event_id") % ROUND == 0).select(F.lit("r").alias("run"), (2 * F.col("event_id")).alias("seq"), F.lit(finalise.ADVANCE).alias("event"), F.lit(None).cast("long").alias("group_id"), F.floor(F.col("event_id") / ROUND).alias("version"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    starts = events.withColumn("nth", nth).filter((F.col("nth") % SIZE == 1) & (F.col("nth") > SIZE) & (F.col("event_id") % 2 == 0))
    ship = starts.select(F.lit("r").alias("run"), (2 * F.col("event_id")).alias("seq"), F.lit(finalise.SHIP).alias("event"), (F.col("user_id") * 1_000_000 + F.floor(F.col("nth") / SIZE) - 1).alias("group_id"), F.lit(None).cast("long").alias("version"))
    return advance.unionByName(ship)


@register(
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth FROM events),
    m AS (SELECT 2 * event_id + 1 AS seq, user_id * 1000000 + nth // {SIZE} AS group_id, nth % {SIZE} AS member, event_id // {ROUND} - floor(value * 100)::BIGINT % 3 AS version, (floor(value * 100)::BIGINT % 4)::DOUBLE AS reward,
      CASE WHEN event_id % 211 = 0 THEN 'stale' WHEN event_type = 'error' THEN 'failed' WHEN event_id % 13 = 0 THEN 'errored' ELSE 'arrived' END AS status FROM e),
    a AS (SELECT 2 * event_id AS seq, event_id // {ROUND} AS version FROM events WHERE event_id % {ROUND} = 0),
    p AS (SELECT 2 * event_id AS ship, user_id * 1000000 + nth // {SIZE} - 1 AS group_id FROM e WHERE nth % {SIZE} = 1 AND nth > {SIZE} AND event_id % 2 = 0),
    g AS (SELECT *, max(seq) OVER w AS done, count(*) OVER w AS n, bool_or(status = 'stale') OVER w AS void, avg(reward) FILTER (WHERE status = 'arrived') OVER w AS mean FROM m WINDOW w AS (PARTITION BY group_id)),
    t AS (SELECT *, (SELECT coalesce(max(a.version), 0) FROM a WHERE a.seq < done) AS newest FROM g WHERE n = {SIZE}),
    d AS (SELECT group_id, member, done AS seq, version, CASE WHEN void THEN 'void' WHEN status <> 'arrived' THEN 'no trace' WHEN reward = mean THEN 'no signal' WHEN version < newest - 1 - {BOUND} THEN 'stale on arrival' ELSE 'queued' END AS decision FROM t),
    q AS (SELECT d.*, (SELECT min(a.seq) FROM a WHERE a.version > d.version + 1 + {BOUND}) AS swept, (SELECT min(ship) FROM p WHERE p.group_id = d.group_id AND ship > d.seq) AS ship FROM d WHERE decision = 'queued')
    SELECT 'r' AS run, group_id, member, seq, decision, version FROM d
    UNION ALL SELECT 'r', group_id, member, coalesce(least(swept, ship), swept, ship), CASE WHEN ship IS NULL OR swept < ship THEN 'swept' ELSE 'shipped' END, version FROM q WHERE coalesce(swept, ship) IS NOT NULL"""
)
def group_finalisation(spark, d):
    """Every decision on every member of the event log's groups."""
    events = table(spark, d, "events")
    return finalise.decided(members_of(events), policy_of(events), SIZE, BOUND)


LIMIT, RESERVE, LONGEST, SILENCE = 3000.0, 200.0, 2_000_000.0, 250_000.0


def seconds(ts):
    """Seconds of a timestamp without a zone since 1970."""
    whole = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return (whole * 1_000_000 + (F.extract(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("long")) / 1e6


def snapshots_of(events):
    """Events as usage snapshots: a user is a run, its spend what its events have cost so far."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    spent = F.sum(F.col("value").cast("decimal(12,2)")).over(w).cast("decimal(18,2)") - F.when(F.col("event_id") % 97 == 0, 500).otherwise(0)
    status = F.when(F.col("event_id") % 331 == 0, "completed").when(F.col("event_id") % 401 == 0, "").otherwise("running")
    return events.select(F.col("user_id").cast("string").alias("run_id"), seconds("ts").alias("at"), F.when(F.col("event_id") % 499 != 0, spent).cast("double").alias("spent"), status.alias("status"))


@register(
    f"""WITH s AS (SELECT user_id::VARCHAR AS run_id, epoch_us(ts) / 1e6 AS "at", CASE WHEN event_id % 499 <> 0 THEN (sum(value::DECIMAL(12,2)) OVER (PARTITION BY user_id ORDER BY event_id) - CASE WHEN event_id % 97 = 0 THEN 500 ELSE 0 END)::DOUBLE END AS spent,
      CASE WHEN event_id % 331 = 0 THEN 'completed' WHEN event_id % 401 = 0 THEN '' ELSE 'running' END AS status FROM events),
    w AS (SELECT *, lag(spent) OVER r AS former, lead("at") OVER r AS later, min("at") OVER (PARTITION BY run_id) AS began FROM s WINDOW r AS (PARTITION BY run_id ORDER BY "at")),
    o AS (SELECT *, coalesce(spent >= greatest(coalesce(former, 0), 0) AND status <> '', false) AS ok FROM w),
    x AS (SELECT *, CASE WHEN NOT ok THEN 'usage unavailable or invalid' WHEN status = 'completed' THEN 'terminal' WHEN spent >= {LIMIT - RESERVE} THEN 'recorded spend limit' WHEN "at" - began >= {LONGEST} THEN 'runtime limit' WHEN later - "at" > {SILENCE} THEN 'usage unavailable or invalid' END AS reason FROM o)
    SELECT run_id, "at", CASE WHEN ok THEN spent ELSE coalesce(former, 0) END AS spent, reason FROM x WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY "at") = 1"""
)
def spend_monitor(spark, d):
    """Of each user's events as a run: when and why it is stopped."""
    return spend.stopped(snapshots_of(table(spark, d, "events")), LIMIT, RESERVE, LONGEST, SILENCE)


def answers_of(events):
    return events.select(
        F.to_date("ts").cast("string").alias("batch"), F.col("event_type").alias("source"), F.col("user_id").alias("group_id"), F.col("value").alias("reward"), F.length("props").cast("long").alias("tokens"),
        (F.col("event_type") == "error").alias("failed"), (F.col("value") > 5).alias("effective"),
    )


@register(
    """WITH a AS (SELECT ts::DATE::VARCHAR AS batch, event_type AS source, user_id, value, length(props) AS tokens, value > 5 AS e FROM events),
    x AS (SELECT batch, unnest(['agg', source]) AS scope, user_id, value, tokens, e, source FROM a), y AS (SELECT *, unnest(CASE WHEN e THEN ['all', 'effective'] ELSE ['all'] END) AS subset FROM x),
    g AS (SELECT batch, scope, subset, count(*) AS answers, count(DISTINCT user_id) AS "groups", sum(tokens)::BIGINT AS tokens, round(avg(value) + 1e-9, 6) AS reward, count_if(source = 'error')::BIGINT AS failed FROM y GROUP BY ALL)
    SELECT *, answers / max(answers) FILTER (WHERE scope = 'agg') OVER (PARTITION BY batch, subset) AS share,
      CAST(sum(answers) OVER w AS BIGINT) AS total_answers, CAST(sum("groups") OVER w AS BIGINT) AS total_groups, CAST(sum(tokens) OVER w AS BIGINT) AS total_tokens FROM g WINDOW w AS (PARTITION BY scope, subset ORDER BY batch)"""
)
def step_metrics(spark, d):
    """Metrics of each day as a step, by event type and in all, with running totals."""
    out = steps.running(steps.metrics_by(answers_of(table(spark, d, "events")), ["batch"]))
    return out.withColumn("reward", F.round(F.col("reward") + 1e-9, 6))
