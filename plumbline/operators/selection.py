"""Selection, coverage and set operations over runs and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Refused(ValueError):
    """Input that doesn't match its plan: no number is computed."""


def latest_clean(df: DataFrame, by: Sequence[str], clean: Column, order: str) -> DataFrame:
    """The latest clean row of each group, else its latest, with `superseded`: how many others there are."""
    w = Window.partitionBy(*by)
    first = w.orderBy(clean.cast("int").desc(), F.desc(order))
    ranked = df.withColumn("_r", F.row_number().over(first)).withColumn("superseded", F.count("*").over(w) - 1)
    return ranked.filter("_r = 1").drop("_r")


def coverage(planned: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys planned but not seen ('missing') and seen but not planned ('extra')."""
    p, s = planned.select(*keys).distinct(), seen.select(*keys).distinct()
    return p.join(s, list(keys), "left_anti").withColumn("problem", F.lit("missing")).unionByName(s.join(p, list(keys), "left_anti").withColumn("problem", F.lit("extra")))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the excess."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("excess")).filter("excess > 0")


def same_set(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> bool:
    return coverage(left, right, keys).isEmpty()


def must_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which every row must find its partner; refused otherwise."""
    if not left.join(right, list(keys), "left_anti").isEmpty():
        raise Refused(f"rows without a partner by {', '.join(keys)}")
    return left.join(right, list(keys))


def with_ambiguity(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with `ambiguous`: partners whose key occurs more than once give no evidence (nulls)."""
    once = right.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in right.columns if c not in keys))
    joined = left.join(once, list(keys), "left").withColumn("ambiguous", F.coalesce(F.col("_n") > 1, F.lit(False)))
    return joined.select(*left.columns, "ambiguous", *(F.when(~F.col("ambiguous"), F.col(c)).alias(c) for c in right.columns if c not in keys))


def problems(rules: dict[str, Column]) -> Column:
    """The messages of all rules that hold, in their order."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(text)) for text, rule in rules.items())))


def refuse_if_any(df: DataFrame, column: str = "problems") -> DataFrame:
    """df, unless a row has problems: then nothing is computed."""
    bad = df.filter(F.size(column) > 0).select(column).limit(5).collect()
    if bad:
        raise Refused("; ".join(sorted({p for r in bad for p in r[column]})))
    return df


def hash_sample(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """The n rows with the smallest md5 of (seed, key): the same in any order of input."""
    return df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")))).orderBy("_h").limit(n).drop("_h")


def stratified_split(df: DataFrame, order: Sequence[str], edge: int, every: int, most: int) -> DataFrame:
    """The `edge` smallest, the `edge` largest and every `every`-th row in between, at most `most` of these.

    Ranks come from a range partitioning and per-partition counts, not from a window over one partition.
    """
    ranked = global_rank(df, order)
    n = ranked.count()
    middle = (F.col("rank") > edge) & (F.col("rank") <= n - edge)
    nth = (F.col("rank") - edge - 1) % every == 0
    place = F.floor((F.col("rank") - edge - 1) / every)
    stratum = F.when(F.col("rank") <= edge, "smallest").when(F.col("rank") > n - edge, "largest").when(middle & nth & (place < most), "middle")
    return ranked.withColumn("stratum", stratum).filter("stratum is not null")


def global_rank(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with `rank` from 1 in a total order: rows are range partitioned, and each partition's offset comes from counts."""
    parts = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    counts = local.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    return local.join(before.select("_p", "_before"), "_p").withColumn("rank", F.col("_r") + F.col("_before")).drop("_p", "_r", "_before")


def interval_union(df: DataFrame, by: Sequence[str], low: str, high: str, gap: float) -> DataFrame:
    """By group: covered length, first low, last high and number of segments; gaps of at most `gap` close."""
    w = Window.partitionBy(*by).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = df.withColumn("_new", F.coalesce((F.col(low) > reach + gap).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*by, "_island").agg(F.min(low).alias("_l"), F.max(high).alias("_h"))
    return merged.groupBy(*by).agg(F.sum(F.col("_h") - F.col("_l")).alias("covered"), F.min("_l").alias("first_low"), F.max("_h").alias("last_high"), F.count("*").alias("segments"))


def running_stop(df: DataFrame, by: Sequence[str], order: Sequence[str], cost: str, budget: float) -> DataFrame:
    """Rows before the one at which what was spent plus the average so far would pass the budget.

    Rows without an order come last. Rows of the same order stop together; among them the cheaper are spent first.
    """
    w = Window.partitionBy(*by)
    places = [F.asc_nulls_last(c) for c in order]
    before = w.orderBy(*places, F.asc_nulls_last(cost)).rowsBetween(Window.unboundedPreceding, -1)
    spent, n = F.coalesce(F.sum(cost).over(before), F.lit(0.0)), F.count(cost).over(before)
    stop = (spent + F.when(n > 0, spent / n).otherwise(0.0)) > budget
    upto = w.orderBy(*places).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # peers too
    return df.withColumn("_s", stop.cast("int")).withColumn("_s", F.max("_s").over(upto)).filter("_s = 0").drop("_s")


def abort_after(df: DataFrame, by: Sequence[str], order: Sequence[str], error: Column, times: int) -> DataFrame:
    """Rows up to and including the `times`-th error in a row."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_e", error.cast("int")).withColumn("_island", F.sum(1 - F.col("_e")).over(upto))
    streak = marked.withColumn("_k", F.sum("_e").over(Window.partitionBy(*by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    over = streak.withColumn("_a", F.coalesce(F.max((F.col("_k") >= times).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return over.filter("_a = 0").drop("_e", "_island", "_k", "_a")


def batch_cut(df: DataFrame, by: Sequence[str], order: Sequence[str], tokens: str, threshold: float) -> DataFrame:
    """Rows until the running total passes the threshold; the row that crosses it is included."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_t", F.sum(tokens).over(w)).filter(F.col("_t") - F.col(tokens) < threshold).drop("_t")


def not_monotonic(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is lower than the one before, null or not finite."""
    w = Window.partitionBy(*by).orderBy(*order)
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return df.withColumn("previous", F.lag(value).over(w)).filter(~finite | (F.col(value) < F.col("previous")))


def banded_join(points: DataFrame, grid: DataFrame, value: str, at: str, tolerance: float, eps: float = 1e-9) -> DataFrame:
    """Pairs with |value - at| <= tolerance + eps: an equi-join on buckets of that width (each grid row in three) and a filter."""
    width = 2 * (tolerance + eps)
    left = points.withColumn("_b", F.floor(F.col(value) / width))
    right = grid.withColumn("_b", F.explode(F.sequence(F.floor(F.col(at) / width) - 1, F.floor(F.col(at) / width) + 1)))
    return left.join(right, "_b").filter(F.abs(F.col(value) - F.col(at)) <= tolerance + eps).drop("_b")
