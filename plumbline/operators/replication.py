"""Replication of a registered comparison on a new split: conformity, verdicts, consistency with the first, pooling."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import compare, selection, stats

# Seed of the draws, and the largest drop of a tier that is no regression.
CONSISTENCY_SEED, DROP = 20261004, 0.10


def conformity(metas: DataFrame, answers: DataFrame, ends: DataFrame, expected: dict, spec_ids: Sequence[str], **exact) -> DataFrame:
    """(run_id, problems): those of the first experiment, with the replication's split in place of its own, and more.

    expected: as for compare.conformity, with the split and split_sha256 of the replication, which metas hold in
    `replication_split`. The answers' spec ids must be exactly spec_ids, and each further field (package_version,
    base_url) the given value.
    """
    as_first = metas.withColumn("test_split", F.col("replication_split"))
    first = compare.conformity(as_first, answers, ends, expected).withColumnRenamed("problems", "_first")
    seen = answers.groupBy("run_id").agg(F.array_sort(F.collect_set("spec_id")).alias("_seen"))  # as many as the split has
    wanted = F.array(*(F.lit(s) for s in sorted(spec_ids)))
    rules = {"the spec ids are not exactly those of the split": ~F.col("_seen").eqNullSafe(wanted)}
    rules |= {f"{name} is not {value}": ~F.col(name).eqNullSafe(F.lit(value)) for name, value in exact.items()}
    rows = metas.join(first, "run_id").join(seen, "run_id", "left")
    return rows.select("run_id", F.concat("_first", selection.problems(rules)).alias("problems"))


def same_prompt(metas: DataFrame) -> DataFrame:
    """One row: prompts (how many different hashes the runs have, a missing one counting as one more), agree."""
    hashes = metas.select(F.coalesce("system_prompt_sha256", F.lit("")).alias("h"))
    return hashes.agg(F.count_distinct("h").alias("prompts")).withColumn("agree", F.col("prompts") == 1)


def per_spec(pairs: DataFrame) -> DataFrame:
    """(spec_id, gain, n): the sum of a spec's differences over its tiers, from compare.paired."""
    return pairs.groupBy("spec_id").agg(F.sum("difference").cast("long").alias("gain"), F.count("*").alias("n"))


def consistency(original: DataFrame, replication: DataFrame, draws: int = compare.DRAWS, seed: int = CONSISTENCY_SEED) -> DataFrame:
    """One row: original_gain, replication_gain, difference, low, high, verdict (smaller, larger or consistent).

    The specs of both splits are resampled independently with Python's own generator, so that published numbers can be
    repeated. One group of two splits, a row per spec and never per answer.
    """
    of = lambda pairs, name: per_spec(pairs).withColumn("split", F.lit(name))
    schema = "original_gain double, replication_gain double, difference double, low double, high double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("spec_id")
        gains = {name: rows.gain.to_numpy(np.int64) for name, rows in part.groupby("split")}
        tiers = {name: int(rows.n.iloc[0]) for name, rows in part.groupby("split")}
        o, r = gains["original"], gains["replication"]
        rng = random.Random(seed)
        took = np.array([[rng.randrange(len(g)) for g in (o, r) for _ in g] for _ in range(draws)])
        size = {name: len(gains[name]) * tiers[name] for name in gains}
        means = np.sort(r[took[:, len(o) :]].sum(axis=1) / size["replication"] - o[took[:, : len(o)]].sum(axis=1) / size["original"])
        low, high = stats.picks(draws)
        a, b = o.sum() / size["original"], r.sum() / size["replication"]
        return pd.DataFrame([(a, b, b - a, means[low], means[high])], columns=[c.split()[0] for c in schema.split(", ")])

    both = of(original, "original").unionByName(of(replication, "replication")).withColumn("all", F.lit(1))
    row = both.groupBy("all").applyInPandas(run, schema)
    return row.withColumn("verdict", F.when(F.col("high") < 0, "smaller").when(F.col("low") > 0, "larger").otherwise("consistent"))


def both_pass(outcomes: DataFrame, by: Sequence[str], tiers: Sequence[str] = compare.TIERS) -> DataFrame:
    """(by, passes, specs): of the specs, how many pass at every tier. Pooled if by is without the experiment."""
    inner = outcomes.filter(F.col("tier").isin(*tiers)).groupBy(*by, "spec_id").agg(F.bool_and(F.col("passed") == 1).alias("all"))
    return inner.groupBy(*by).agg(F.count_if("all").alias("passes"), F.count("*").alias("specs"))


def pooled(experiments: dict[str, DataFrame], tiers: Sequence[str] = compare.TIERS) -> DataFrame:
    """(experiment, passes, specs, lower): of each experiment and of all ("pooled"), with the exact 95 % lower bound.

    A spec id that two experiments share is two specs.
    """
    counts = [both_pass(outcomes.withColumn("experiment", F.lit(name)), ["experiment"], tiers) for name, outcomes in experiments.items()]
    each = counts[0]
    for other in counts[1:]:
        each = each.unionByName(other)
    total = each.agg(F.lit("pooled").alias("experiment"), F.sum("passes").alias("passes"), F.sum("specs").alias("specs"))
    bound = F.udf(stats.exact_lower_bound, "double")  # a row per experiment
    return each.unionByName(total).withColumn("lower", bound("passes", "specs"))


def verdict(row: DataFrame) -> DataFrame:
    """The row of compare.gain with `verdict`: replicated, smaller than worthwhile, or not replicated."""
    above = F.col("low") > 0
    return row.withColumn("verdict", F.when(above & (F.col("point") >= compare.WORTHWHILE), "replicated").when(above, "smaller than worthwhile").otherwise("not replicated"))


def regressions(pairs: DataFrame) -> DataFrame:
    """(tier, difference, regression): tiers whose mean difference is below -DROP."""
    return pairs.groupBy("tier").agg(F.avg("difference").alias("difference")).withColumn("regression", F.col("difference") < -DROP)


def sign_flip_p(clusters: int) -> float:
    """One-sided p of `clusters` specs that all moved one way, if each could as well have moved the other."""
    return 2.0**-clusters


def all_pass_bound(n: int, alpha: float = 0.025) -> float:
    """The lower bound if all of n pass: the closed form of stats.exact_lower_bound(n, n)."""
    return alpha ** (1 / n)


def counts_of_counts(rows: DataFrame, cluster: str) -> DataFrame:
    """(n, clusters): how many clusters have n rows."""
    return rows.groupBy(cluster).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("clusters"))
