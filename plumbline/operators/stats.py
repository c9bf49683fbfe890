"""Statistics of graded answers: means at two levels, percentiles by index, group signals, resampling intervals."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numbers import md5_heads
from plumbline.operators.ranks import numbered


def two_level_mean(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: Column, name: str) -> DataFrame:
    """Mean by (outer, inner), then the mean of these by outer, with their number n."""
    first = df.groupBy(*outer, *inner).agg(F.avg(value).alias(name))
    return first.groupBy(*outer).agg(F.count("*").alias("n"), F.avg(name).alias(name))


def index_percentile(values: Column, q: float) -> Column:
    """sorted[min(n - 1, int(q * n))] of a collected array, without interpolation; null for an empty one."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.least(n, F.floor(n * F.lit(q)).cast("int") + 1)))


def advantages(df: DataFrame, group: Sequence[str], reward: str) -> DataFrame:
    """df with `advantage`: the reward less its group's mean."""
    return df.withColumn("advantage", F.col(reward) - F.avg(reward).over(Window.partitionBy(*group)))


def length_penalised(df: DataFrame, group: Sequence[str], reward: str, tokens: str, turns: str, weight: float = 1.0) -> DataFrame:
    """df with `advantage`: reward less the mean of the token and turn shares of the group's largest, re-centred."""
    w = Window.partitionBy(*group)
    share = lambda c: F.col(c) / F.greatest(F.max(c).over(w), F.lit(1))
    shaped = df.withColumn("shaped", F.col(reward) - weight * (share(tokens) + share(turns)) / 2)
    return shaped.withColumn("advantage", F.col("shaped") - F.avg("shaped").over(w)).drop("shaped")


def group_signal(df: DataFrame, outer: Sequence[str], group: Sequence[str], reward: str, most: float = 1.0) -> DataFrame:
    """By outer: groups of several answers, the shares that are flat (all solved, all zero, same partial), the signal
    (share that isn't flat), the mean population deviation and the mean absolute advantage."""
    answers = advantages(df, [*outer, *group], reward)
    per = answers.groupBy(*outer, *group).agg(
        F.count("*").alias("size"), F.min(reward).alias("low"), F.max(reward).alias("high"), F.stddev_pop(reward).alias("std"), F.avg(F.abs("advantage")).alias("strength")
    )
    flat = F.col("low") == F.col("high")
    share = lambda c: F.avg(c.cast("double"))
    return per.filter("size > 1").groupBy(*outer).agg(
        F.count("*").alias("groups"),
        share(flat & (F.col("low") >= most)).alias("all_solved"),
        share(flat & (F.col("high") <= 0)).alias("all_zero"),
        share(flat & (F.col("low") < most) & (F.col("high") > 0)).alias("same_partial"),
        (1 - share(flat)).alias("signal"),
        F.avg("std").alias("mean_std"),
        F.avg("strength").alias("mean_abs_advantage"),
        F.array_sort(F.collect_set("size")).alias("sizes"),
    )


def pass_at_k(df: DataFrame, outer: Sequence[str], group: Sequence[str], passed: Column) -> DataFrame:
    """By outer: the share of answers that pass and of groups in which any passes."""
    per = df.groupBy(*outer, *group).agg(F.count_if(passed).alias("hits"), F.count("*").alias("n"))
    return per.groupBy(*outer).agg((F.sum("hits") / F.sum("n")).alias("all_pass"), F.avg((F.col("hits") > 0).cast("double")).alias("pass_at_k"))


def rate(hits: Column, of: Column) -> Column:
    """Hits among `of` with a denominator of at least 1."""
    return F.count_if(hits & of) / F.greatest(F.count_if(of), F.lit(1))


def check_rate(checks: str, name: str) -> Column:
    """Pass rate of a check over all rows, a missing one failing; null if no row has the check while some have others."""
    has, any_ = F.bool_or(F.map_contains_key(checks, F.lit(name))), F.bool_or(F.size(checks) > 0)
    passed = F.coalesce(F.try_element_at(checks, F.lit(name)), F.lit(False))
    return F.when(F.coalesce(has, F.lit(False)) | ~F.coalesce(any_, F.lit(False)), F.avg(passed.cast("double")))


# --- resampling ---------------------------------------------------------------------------------------------------


def picks(n: int) -> tuple[int, int]:
    """Places of the 95 % interval in n sorted draws."""
    return int(0.025 * n), int(0.975 * n) - 1


def hashed_place(seed: int, draw: Column, pick: Column, n: Column) -> Column:
    """The cluster that a draw's pick takes: 32 bits of an md5, modulo the number of clusters."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), draw, pick)), 1, 8), 16, 10).cast("long") % n


#: Clusters in all whose values may be broadcast, as one array a group (16 MB).
TOGETHER = 1_000_000
#: Values that a task of a bootstrap holds (64 MB), hashes made at a time, and tasks that share the draws.
HELD, LANES, SHARES = 8_000_000, 1 << 15, 32


def cluster_draws(clusters: DataFrame, by: Sequence[str], order: str, value: str, draws: int, seed: int, name: str = "mean", size: int | None = None, together: int = TOGETHER) -> DataFrame:
    """(by, draw, name): means of clusters resampled with replacement, as many as there are (or `size`).

    clusters holds one row per cluster, with `order` (a number, if `size` is given); a pick takes a cluster by its place in
    that order. Draws of all are made where the values are (`whole_draws`). Of a given size, each draw looks its picks up in
    the array of its group's values where the clusters are few, which is checked; larger groups are numbered, and picks
    counted by (draw, place) before they meet the values.
    """
    if size is None:
        return whole_draws(clusters, by, order, value, draws, seed, name)
    counts = clusters.groupBy(*by).agg(F.count("*").alias("n"))
    draw = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    picks = F.sequence(F.lit(0).cast("long"), F.lit(size).cast("long") - 1)
    if (counts.agg(F.sum("n").alias("n")).first().n or 0) <= together:
        values = clusters.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("c"))
        values = values.select(*(F.col(b).alias(f"_{b}") for b in by), F.col("c.v").alias("v"), F.size("c").cast("long").alias("n"))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("k"))

        def add(acc: Column, pick: Column) -> Column:
            v = F.get("v", hashed_place(seed, F.col("draw"), pick, F.col("n")).cast("int"))
            return F.struct((acc["sum"] + F.coalesce(v, F.lit(0.0))).alias("sum"), (acc["k"] + F.when(v.isNull(), 0).otherwise(1)).alias("k"))

        turns = counts.select(*by, draw).repartition(*by, "draw")
        same = reduce(lambda x, y: x & y, (F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by))
        mean = F.reduce(picks, start, add, lambda acc: F.when(acc["k"] > 0, acc["sum"] / acc["k"]))
        return turns.join(F.broadcast(values), same).select(*by, "draw", mean.alias(name))
    indexed = numbered(clusters.select(*by, order, value), by, order, "index").drop(order)
    rows = counts.select(*by, "n", draw).withColumn("pick", F.explode(picks))
    chosen = rows.withColumn("index", hashed_place(seed, F.col("draw"), F.col("pick"), F.col("n"))).groupBy(*by, "draw", "index").agg(F.count("*").alias("times"))
    met = chosen.join(indexed, [*by, "index"]).filter(F.col(value).isNotNull())
    return met.groupBy(*by, "draw").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias(name))


def whole_draws(clusters: DataFrame, by: Sequence[str], order: str, value: str, draws: int, seed: int, name: str = "mean", held: int = HELD) -> DataFrame:
    """(by, draw, name): means of as many picks as a group has clusters; picks are never rows.

    Sorted clusters are cut to arrays of values, which know the places they begin at. A task holds arrays of about `held`
    values, of several groups or of a part of a large one, and makes the picks of its share of the draws: a pick's hash is
    the same for all groups, so it is made once for those that a task holds, and taken where its place is there. The arrays
    move once for each share, and sums of (by, draw) come back. Parts of a group repeat the hashes of its picks.
    """
    ranged = clusters.select(*by, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v")).repartitionByRange(*by, "_o").sortWithinPartitions(*by, "_o")
    schema = clusters.select(*by).schema.add("_at", "long").add("_size", "long").add("_values", "binary").add("_known", "binary")
    pieces = ranged.mapInArrow(cut(by), schema).persist()
    w = Window.partitionBy(*by)
    start = F.sum("_size").over(w.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    told = pieces.select(*by, "_at", "_size", start.alias("_start"), F.sum("_size").over(w).alias("_n"))
    buckets = math.ceil((told.agg(F.sum("_size").alias("n")).first().n or 1) / held)
    told = told.select("_at", "_start", "_n", F.pmod(F.hash(*by), F.lit(buckets)).alias("_bucket"), F.floor(F.col("_start") / held).alias("_part"))
    held_by = told.select("_bucket", "_part").distinct().collect()  # about two for each `held` clusters
    rooms = clusters.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(sorted(held_by))], "_bucket int, _part long, _room int")
    shares = min(draws, SHARES)
    dealt = pieces.join(told.join(F.broadcast(rooms), ["_bucket", "_part"]), "_at").withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt = dealt.withColumn("_room", F.col("_room") * shares + F.col("_share")).repartitionById(max(len(held_by), 1) * shares, "_room").sortWithinPartitions(*by, "_at")
    sums = dealt.mapInArrow(picked(by, draws, shares, seed), clusters.select(*by).schema.add("draw", "integer").add("_sum", "double").add("_k", "long"))
    return sums.groupBy(*by, "draw").agg(F.when(F.sum("_k") > 0, F.sum("_sum") / F.sum("_k")).alias(name))


def begins(batch: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    """The rows at which a group begins, in rows sorted by group."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for b in by:
        codes = batch.column(b).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def cut(by: Sequence[str]):
    """Sorted rows to arrays of values, with `_at`, by which they are in order, and `_known` where values are null."""

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            first = begins(batch, by)
            ends = [*first[1:].tolist(), batch.num_rows]
            values, known = batch.column("_v").fill_null(0.0).to_numpy(), batch.column("_v").is_valid().to_numpy(zero_copy_only=False)
            spans = [slice(i, j) for i, j in zip(first.tolist(), ends, strict=True)] if batch.num_rows else []
            columns = [batch.column(b).take(pa.array(first)) for b in by]
            columns += [pa.array(range(at, at + len(spans)), pa.int64()), pa.array([s.stop - s.start for s in spans], pa.int64())]
            columns += [pa.array([values[s].tobytes() for s in spans], pa.binary()), pa.array([None if known[s].all() else known[s].tobytes() for s in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*by, "_at", "_size", "_values", "_known"])
            at += len(spans)

    return run


def picked(by: Sequence[str], draws: int, shares: int, seed: int):
    """Arrays of values, sorted by group and place, to sums of those that a share of the draws picks."""

    def groups(batch: pa.RecordBatch):
        """Of each group: number of its clusters, first place held, values, which of them are known (None: all)."""
        first = begins(batch, by).tolist()
        for i, j in zip(first, [*first[1:], batch.num_rows], strict=True):
            values, known = (batch.column(c).slice(i, j - i) for c in ("_values", "_known"))
            held = [np.frombuffer(v.as_buffer(), np.float64) for v in values]
            flags = [np.frombuffer(k.as_buffer(), bool) if k.is_valid else np.ones(len(v), bool) for k, v in zip(known, held, strict=True)]
            yield batch.column("_n")[i].as_py(), batch.column("_start")[i].as_py(), np.concatenate(held), np.concatenate(flags) if known.null_count < len(known) else None

    def sums(held: list, draw: int) -> list[list]:
        out = [[0.0, 0] for _ in held]
        most, low = max(n for n, *_ in held), 0
        while low < most:
            high = min(low + LANES, most, 10 ** len(str(low)))
            heads = md5_heads(f"{seed}|{draw}|".encode(), low, high)
            for total, (n, start, values, known) in zip(out, held, strict=True):
                place = heads[: max(n - low, 0)]
                if n < 2**32:
                    place = place - place // np.uint32(n) * np.uint32(n)
                if start or len(values) < n:
                    place = place[(place >= start) & (place < start + len(values))] - np.uint32(min(start, 2**32 - 1))
                took = values[place]
                if known is not None:
                    took = took[known[place]]
                total[0] += float(took.sum())
                total[1] += len(took)
            low = high
        return out

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.concat_batches(rows)
        held, first = list(groups(rows)), pa.array(begins(rows, by))
        keys, share = [rows.column(b).take(first) for b in by], rows.column("_share")[0].as_py()
        for draw in range(share, draws, shares):
            total = sums(held, draw)
            told = [pa.array([draw] * len(held), pa.int32()), pa.array([s for s, _ in total], pa.float64()), pa.array([k for _, k in total], pa.int64())]
            yield pa.RecordBatch.from_arrays([*keys, *told], [*by, "draw", "_sum", "_k"])

    return run


def interval(draws: DataFrame, by: Sequence[str], n: int, name: str = "mean") -> DataFrame:
    """(by, low, high): the 95 % interval of sorted draws, by place."""
    low, high = picks(n)
    values = F.array_sort(F.collect_list(name))  # as many as the draws
    return draws.groupBy(*by).agg(values.alias("v")).select(*by, F.col("v")[low].alias("low"), F.col("v")[high].alias("high"))


def seeded_interval(clusters: DataFrame, by: Sequence[str], order: str, values: str, draws: int = 10_000, seed: int = 20261001) -> DataFrame:
    """Paired cluster bootstrap with Python's own generator: `values` holds an array per cluster (its tiers stay together).

    One group per comparison; a comparison has as many clusters as specifications, never as many as answers.
    """
    schema = clusters.select(*by).schema.add("point", "double").add("low", "double").add("high", "double")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        rows = [list(v) for v in part[values]]
        rng, n = random.Random(seed), len(rows)
        sums, sizes = [math.fsum(r) for r in rows], [len(r) for r in rows]
        means = []
        for _ in range(draws):
            at = [rng.randrange(n) for _ in range(n)]
            means.append(math.fsum(sums[i] for i in at) / max(1, sum(sizes[i] for i in at)))
        means.sort()
        low, high = picks(draws)
        first = part.iloc[0]
        return pd.DataFrame([{**{b: first[b] for b in by}, "point": math.fsum(sums) / max(1, sum(sizes)), "low": means[low], "high": means[high]}])

    return clusters.groupBy(*by).applyInPandas(run, schema)


def exact_lower_bound(k: int, n: int, alpha: float = 0.025) -> float:
    """Clopper-Pearson lower bound: the p at which k or more of n have probability alpha.

    Log probabilities of the tail over a grid of p, refined around the value sought.
    """
    if k == 0:
        return 0.0
    i = np.arange(k, n + 1)
    ways = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i])
    low, high = 0.0, 1.0
    while high - low > 1e-15:
        p = np.linspace(low, high, 66)[1:-1]
        terms = ways + i * np.log(p)[:, None] + (n - i) * np.log1p(-p)[:, None]
        at = int(np.searchsorted(np.exp(terms).sum(axis=1), alpha))
        edges = np.concatenate([[low], p, [high]])
        if edges[at] == low and edges[at + 1] == high:
            break
        low, high = float(edges[at]), float(edges[at + 1])
    return (low + high) / 2
