"""Training logs and samples: pruning, gates, pools, discards, warnings, step tables, screening runs."""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import selection, stats
from plumbline.sources.runs import Runs

# Pools by the largest reward they take, and their weights.
POOLS = (("hard", 0.25, 0.2), ("normal", 0.75, 1.0), ("easy", 1.0, 0.2))


def pruned(samples: DataFrame) -> DataFrame:
    """samples with the weights of trained tokens without advantage set to 0, and `trainable`: whether anything is left.

    samples: mask, advantages, rl_weights, ce_weights, ref_kl_weights (arrays). Without advantages a sample stays as it
    is; without rl_weights these are 1 where the mask holds. A sample in which nothing changes stays trainable.
    """
    given = F.coalesce("rl_weights", F.transform("mask", lambda m: F.when(m, 1.0).otherwise(0.0)))
    tokens = F.arrays_zip(F.col("mask").alias("m"), F.col("advantages").alias("a"), F.col("_given").alias("w"))
    idle = lambda t: t["m"] & (t["a"] == 0) & (t["w"] != 0)
    rows = samples.withColumn("_given", given).withColumn("_tokens", tokens)
    rows = rows.withColumn("_changed", F.coalesce(F.col("advantages").isNotNull() & F.exists("_tokens", idle), F.lit(False)))
    rows = rows.withColumn("rl_weights", F.when(F.col("_changed"), F.transform("_tokens", lambda t: F.when(idle(t), 0.0).otherwise(t["w"]))).otherwise(F.col("rl_weights")))
    weighs = lambda c: F.coalesce(F.exists(c, lambda w: w != 0), F.lit(False))
    left = F.exists(F.arrays_zip(F.col("mask").alias("m"), F.col("rl_weights").alias("w")), lambda t: t["m"] & (t["w"] != 0))
    return rows.withColumn("trainable", ~F.col("_changed") | left | weighs("ce_weights") | weighs("ref_kl_weights")).drop("_given", "_tokens", "_changed")


def admitted(rows: DataFrame, advantage: str, low: float = 0.0, high: float = 0.0) -> DataFrame:
    """The rows whose advantage lies outside [low, high]; one that is null is let through."""
    if low > high:
        raise ValueError("the lower end of the range is above the upper one")
    return rows.filter(~F.coalesce(F.col(advantage).between(low, high), F.lit(False)))


def pool_of(reward: Column, pools: Sequence[tuple[str, float, float]] = POOLS) -> Column:
    """The first pool, by rising threshold, that takes the reward; null above all."""
    out = F.lit(None).cast("string")
    for name, threshold, _ in sorted(pools, key=lambda p: -p[1]):
        out = F.when(reward <= threshold, name).otherwise(out)
    return out


def mixed(rows: DataFrame, source: str, shares: dict[str, float], n: int, key: Column, seed: int) -> DataFrame:
    """About n rows, of each source its share (rounded): those with the smallest md5 of (seed, key), in any order of input.

    A source with fewer rows gives all it has. Hashes below a bound that leaves some six deviations of room go into the
    ranking, so that no source is sorted whole.
    """
    quota = F.coalesce(*(F.when(F.col(source) == s, F.lit(round(n * share))) for s, share in shares.items()))
    hashed = rows.filter(F.col(source).isin(*shares)).withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")))).withColumn("_quota", quota)
    sizes = hashed.groupBy(source).agg(F.count("*").alias("_n"))
    bound = (F.col("_quota") + 6 * F.sqrt(F.col("_quota") + 1) + 40) / F.col("_n")
    place = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 2**32
    near = hashed.join(F.broadcast(sizes), source).filter(place <= bound)  # a row per source of `shares`
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy("_h")))
    return ranked.filter("_r <= _quota").drop("_h", "_quota", "_n", "_r")


def weighted(rows: DataFrame, reward: str, n: int, key: Column, seed: int, pools: Sequence[tuple[str, float, float]] = POOLS) -> DataFrame:
    """About n rows with `pool`, dealt over the pools by weight times their number of rows (a weight holds per row)."""
    pooled = rows.withColumn("pool", pool_of(F.col(reward), pools)).filter("pool is not null")
    counts = {r["pool"]: r["count"] for r in pooled.groupBy("pool").count().collect()}  # a row per pool
    mass = {name: weight * counts.get(name, 0) for name, _, weight in pools}
    total = sum(mass.values())
    if not total:
        return pooled.limit(0)
    return mixed(pooled, "pool", {name: m / total for name, m in mass.items() if m}, n, key, seed)


def zero_output_warnings(units: DataFrame, by: Sequence[str], order: Sequence[str], size: str, target: int) -> DataFrame:
    """(by, order, total, windows): the rows at which the running total of units without output completes a further batch."""
    w = Window.partitionBy(*by).orderBy(*order)
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = units.withColumn("total", total).withColumn("windows", F.floor(F.col("total") / target))
    before = F.coalesce(F.lag("windows").over(w), F.lit(0))
    return rows.withColumn("_before", before).filter("windows > _before").select(*by, *order, "total", "windows")


def discards(episodes: DataFrame, shipped: DataFrame, buffered: DataFrame, others: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, attempts, discarded, stale, errored, no_signal): what became of a batch's attempts.

    episodes: by, episode_id, cancelled, failed. Discarded are those neither shipped nor buffered; of these the cancelled
    are stale and other failed ones errored. others: by, failures (errored), cancelled_attempts (discarded) and
    stale_attempts (stale) of attempts without an episode. No signal is what remains.
    """
    key = [*by, "episode_id"]
    kept = shipped.select(*key).unionByName(buffered.select(*key)).distinct().withColumn("_kept", F.lit(True))
    rows = episodes.join(kept, key, "left").withColumn("_gone", F.col("_kept").isNull())
    cancelled, failed = F.coalesce("cancelled", F.lit(False)), F.coalesce("failed", F.lit(False))
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("e"), F.count_if("_gone").alias("g"),
        F.count_if(F.col("_gone") & cancelled).alias("s"), F.count_if(F.col("_gone") & ~cancelled & failed).alias("x"),
    )
    numbers = ["e", "g", "s", "x", "failures", "cancelled_attempts", "stale_attempts"]
    all_ = counts.join(others, list(by), "full_outer").fillna(0, numbers)
    out = all_.select(
        *by, F.expr("e + failures + cancelled_attempts").alias("attempts"), F.expr("g + failures + cancelled_attempts").alias("discarded"),
        F.expr("s + stale_attempts").alias("stale"), F.expr("x + failures").alias("errored"),
    )
    return out.withColumn("no_signal", F.expr("discarded - stale - errored"))


def with_histograms(steps: DataFrame, histograms: DataFrame) -> DataFrame:
    """steps with `distribution` (ok or missing) and the counts of the lowest and highest reward bin.

    histograms: run, step, counts (array over the bins of the reward; null where the file held none). A step whose bins
    don't add up to its trained answers stops the query.
    """
    counts = F.col("counts")
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))
    sound = F.when(counts.isNull() | (total == F.col("trained")), counts).otherwise(F.raise_error(F.concat(F.lit("bins and answers differ at step "), F.col("step").cast("string"))))
    rows = steps.join(histograms.select("run", "step", "counts"), ["run", "step"], "left").withColumn("counts", sound)
    ends = {"trained_zero_rewards": F.try_element_at("counts", F.lit(1)), "trained_one_rewards": F.try_element_at("counts", F.lit(-1))}
    return rows.withColumns({"distribution": F.when(counts.isNull(), "missing").otherwise("ok"), **ends}).drop("counts")


def write_steps(steps: DataFrame, path: str) -> None:
    """The step table as CSV with a header; an existing one is not overwritten."""
    steps.write.mode("errorifexists").option("header", True).csv(path)


def read_steps(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The step table; columns are those of the header, so that another order or a missing one stops the query."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def screening(runs: Runs) -> DataFrame:
    """(run_id, tier, spec_id, flags): whether each answer of a spec has the full reward, in the order of rollouts.

    Refused if a run has no end record, or its last one isn't complete.
    """
    status = runs.ends.select("run_id", "status")
    bad = runs.metas.select("run_id").join(status.filter("status = 'complete'"), "run_id", "left_anti")
    if not bad.isEmpty():
        raise selection.Refused("a screening run is not marked complete")
    flag = F.coalesce((F.col("reward") == 1.0).cast("int"), F.lit(0))
    groups = runs.answers.groupBy("run_id", "tier", "spec_id").agg(F.array_sort(F.collect_list(F.struct("rollout", flag.alias("f")))).alias("x"))  # as many as rollouts
    return groups.select("run_id", "tier", "spec_id", F.col("x.f").alias("flags"))


def predicted_interval(groups: DataFrame, by: Sequence[str], flags: str, order: str, m: int, seed: int, draws: int = 10_000) -> DataFrame:
    """(by, low, high): the 95 % interval of the pass rate of m groups drawn with replacement, by Python's generator.

    A row per spec comes in, never per answer. Groups are taken in the order of `order`.
    """
    schema = groups.select(*by).schema.add("low", "double").add("high", "double")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rates = [sum(f) / len(f) for f in part.sort_values(order)[flags]]
        rng = random.Random(seed)
        sims = sorted(sum(rates[rng.randrange(len(rates))] for _ in range(m)) / m for _ in range(draws))
        low, high = stats.picks(draws)
        return part.iloc[:1][list(by)].assign(low=sims[low], high=sims[high])

    return groups.groupBy(*by).applyInPandas(run, schema)
