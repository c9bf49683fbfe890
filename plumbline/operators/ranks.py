"""Exact order statistics, row numbers and shuffles of groups of any size: no group is sorted in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that one task may rank, parts of a sketch, and the share of a group that a sketch may be off by.
ENOUGH, PARTS, OFF = 100_000, 500, 1e-3


def at_ranks(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]], enough: int = ENOUGH) -> DataFrame:
    """(by, n, a column per rank): the values at the ranks (from 1, of the n values that aren't null) of each group.

    A sketch of a group, merged from those of its tasks, tells a range of values around the ranks; exact counts below and
    inside tell whether the ranks lie in it, or on which side. Rounds narrow the range until few rows are inside, or one
    value alone; only those are counted by value and ranked. A round reads the rows twice and moves one sketch per task
    and group. There is one row of state per group.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.struct(*by).alias("g"), F.col(value).alias("v"))
    wanted = F.array_sort(F.array(*(rank(F.col("n")) for rank in ranks.values())))
    state = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = state.withColumns({"first": F.element_at(wanted, 1), "last": F.element_at(wanted, -1), "below": F.lit(0).cast("long"), "inside": F.col("n")}).persist()
    inside = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    wide = (F.col("inside") > enough) & (F.col("lo") < F.col("hi"))
    while not state.filter(wide).isEmpty():
        state, old = narrowed(rows, state, inside, wide).persist(), state
        state.count()
        old.unpersist()
    few = rows.join(state, "g").filter(inside).groupBy("g", "n", "below", "v").agg(F.count("*").alias("c"))
    few = few.withColumn("to", F.col("below") + F.sum("c").over(Window.partitionBy("g").orderBy("v")))
    picks = [F.min(F.when(F.col("to") >= rank(F.col("n")), F.col("v"))).alias(name) for name, rank in ranks.items()]
    return few.groupBy("g", "n").agg(*picks).select("g.*", "n", *ranks)


def narrowed(rows: DataFrame, state: DataFrame, inside: Column, wide: Column) -> DataFrame:
    """The state with the ranges of wide groups cut to what holds their ranks."""
    open_ = rows.join(state.filter(wide).select("g", "lo", "hi"), "g").filter(inside)
    cuts = open_.groupBy("g").agg(F.percentile_approx("v", [i / PARTS for i in range(PARTS + 1)], int(1 / OFF)).alias("cuts"))
    place = lambda rank: (F.col(rank) - F.col("below")) * PARTS / F.col("inside")
    cut = lambda i: F.element_at("cuts", F.greatest(F.least(i.cast("int"), F.lit(PARTS)), F.lit(0)) + 1)
    told = state.join(cuts, "g", "left").withColumns({"low": F.coalesce(cut(F.floor(place("first")) - 1), F.col("lo")), "high": F.coalesce(cut(F.ceil(place("last")) + 1), F.col("hi"))}).drop("cuts").persist()
    counts = rows.join(told.select("g", "lo", "hi", "low", "high"), "g").filter(inside)
    counts = counts.groupBy("g").agg(F.count_if(F.col("v") < F.col("low")).alias("under"), F.count_if((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).alias("within"))
    start = F.col("below") + F.col("under")
    left, right = F.col("first") <= start, F.col("last") > start + F.col("within")  # ranks beyond the new range: it stays open there
    return told.join(counts, "g").select(
        "g", "n", F.when(left, F.col("lo")).otherwise(F.col("low")).alias("lo"), F.when(right, F.col("hi")).otherwise(F.col("high")).alias("hi"), "first", "last",
        F.when(left, F.col("below")).otherwise(start).alias("below"),
        (F.when(right, F.col("inside")).otherwise(F.col("under") + F.col("within")) - F.when(left, 0).otherwise(F.col("under"))).alias("inside"),
    )


def index_percentile_by(df: DataFrame, by: Sequence[str], value: str, q: float, name: str, enough: int = ENOUGH) -> DataFrame:
    """(by, name): sorted[min(n - 1, int(q * n))] of each group, without interpolation."""
    return at_ranks(df, by, value, {name: lambda n: F.least(n, F.floor(n * F.lit(q)).cast("long") + 1)}, enough).drop("n")


def median_by(df: DataFrame, by: Sequence[str], value: str, name: str, enough: int = ENOUGH) -> DataFrame:
    """(by, n, name): the exact median, the mean of both middle values of an even number."""
    out = at_ranks(df, by, value, {"low_": lambda n: F.floor((n + 1) / 2), "high_": lambda n: F.floor((n + 2) / 2)}, enough)
    return out.select(*by, "n", ((F.col("low_") + F.col("high_")) / 2).alias(name))


def numbered(df: DataFrame, by: Sequence[str], order: str, name: str, parts: int = 200) -> DataFrame:
    """df with the place (from 0) of each row in its group by a numeric column; ties and nulls have arbitrary places.

    Each group is cut at `parts` approximate quantiles; parts are numbered in tasks of their own, from how many rows the
    parts before them hold.
    """
    g, cuts, part, base = "_g", "_cuts", "_part", "_base"
    rows = df.withColumn(g, F.struct(*by))
    marks = rows.groupBy(g).agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10 * parts).alias(cuts))
    rows = rows.join(marks, g, "left").withColumn(part, F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col(order))), F.lit(-1))).drop(cuts)
    sizes = rows.groupBy(g, part).agg(F.count("*").alias("_n"))
    starts = sizes.withColumn(base, F.coalesce(F.sum("_n").over(Window.partitionBy(g).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy(g, part).orderBy(order)) - 1
    return rows.withColumn(name, nth.cast("long")).join(starts, [g, part]).withColumn(name, F.col(name) + F.col(base)).drop(g, part, base)


# --- shuffles ---------------------------------------------------------------------------------------------------------


def permuted(rank: Column, n: Column, seed: int, rounds: int = 6, walk: int = 64) -> Column:
    """A place from 0 to n - 1 for each rank from 0 to n - 1, all different, told by the seed alone.

    A Feistel network over the a x b grid that holds n cells, a and b near the root of n: each round adds a hash of one
    coordinate to the other, so it is a bijection of the grid. Ranks that leave the n cells walk on until they are back;
    fewer than a cells lie outside, so walks are short. Nothing is sorted or shuffled to tell a place.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / F.nullif(a, F.lit(0))).cast("long")

    def once(x: Column) -> Column:
        state = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))

        def turn(s: Column, i: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(seed)), a), a)
            return F.struct(left.alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(left, -i, F.lit(seed)), b), b).alias("r"))

        done = F.reduce(F.sequence(F.lit(1), F.lit(rounds)), state, turn)
        return done["l"] + a * done["r"]

    steps = F.sequence(F.lit(1), F.least(F.greatest(a, F.lit(1)), F.lit(walk)).cast("int"))
    first = once(rank.cast("long"))
    return F.reduce(steps, first, lambda x, _: F.when(x >= n, once(x)).otherwise(x))


def shuffled(df: DataFrame, rank: str, seed: int, name: str = "place") -> DataFrame:
    """df with a seeded place of each row; `rank` numbers the rows from 0. Reruns and repartitions change nothing."""
    n = df.agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(n)).withColumn(name, permuted(F.col(rank), F.col("_n"), seed)).drop("_n")  # one row
