"""Mixing sources to target weights by the cube method.

Each source's target gives its documents an expected number of copies r = target / source size, the whole part of which
every document gets. The fractional part is an inclusion probability, decided by the cube method: a flight phase moves
the probabilities of three documents at a time along the null space of two constraints (token total, document total)
until one of them is 0 or 1. Blocks of `block` documents of a source fly independently; the at most two undecided
documents of each block meet in the next round, with as many rounds as the counts need, and a last landing picks the
outcome nearest to the source's totals. No step holds more than one block.

Null texts have size 0. Documents of size 0 are balanced on the document total alone. A null source is a source of its
own and comes last. Repeated rows are decided one by one, in the order of their ids and sizes, so reruns agree. Where all
texts are empty, targets are 0 and nothing is taken.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Shelf, fresh

#: Weights of the sources in code point order, repeating; total words as a share of all words; most copies.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0


def targets(sizes: dict, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """source -> target words: the total is shared by weight, caps are most * size, excess is reshared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            open_.remove(s)
        left -= sum(target[s] for s in over)
    return target


def fly(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight phase in the given order: at most two entries of the result are strictly between 0 and 1.

    draw: a number in [0, 1) for each entry, which decides the direction of the step that the entry enters.
    """
    p = p.astype(float).copy()
    active: list[int] = []
    eps = 1e-9
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = round(p[i])
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        # The null space of [[p size], [1 1 1]] over the three: u = (sb - sc, sc - sa, sa - sb), any if all sizes agree.
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[j]) / x if x > 0 else -p[j] / x for j, x in zip(active, u, strict=True) if x)
        down = min(p[j] / x if x > 0 else (p[j] - 1) / x for j, x in zip(active, u, strict=True) if x)
        step = up if draw[i] * (up + down) < down else -down
        for j, x in zip(active, u, strict=True):
            p[j] += step * x
        rest = []
        for j in active:
            if eps < p[j] < 1 - eps:
                rest.append(j)
            else:
                p[j] = round(p[j])
        active = rest
    return p


def land(p: np.ndarray, size: np.ndarray, flips: int = 4) -> np.ndarray:
    """Rounds the last two or fewer undecided entries to the outcome nearest to their expected words; while that is
    off, up to `flips` single decisions are turned that bring the words nearest."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    want = float((p * size).sum())
    rest = want - float((p[open_] * size[open_]).sum())
    options = [[k >> i & 1 for i in range(len(open_))] for k in range(1 << len(open_))]
    p[open_] = min(options, key=lambda o: (abs(rest + sum(x * s for x, s in zip(o, size[open_], strict=True)) - want), sum(o)))
    for _ in range(flips):
        off = float((p * size).sum()) - want
        turned = off + np.where(p > 0.5, -size, size)
        best = int(np.argmin(np.abs(turned)))
        if abs(turned[best]) >= abs(off):
            break
        p[best] = 1 - p[best]
    return p


def sized(docs: DataFrame, text_col: str = "text", name: str = "size") -> DataFrame:
    """docs with `name`: the number of words of the whole text."""
    return docs.withColumn(name, F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def plan(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = 20_000) -> DataFrame:
    """sizes: (unit long, unit2 long, doc_id, source, size), both units together unique. Returns it with source_size,
    target and copies.

    Target rows are one per source; they are gathered to share the excess out, and broadcast only while Spark sees them
    as small (the join states no hint).
    """
    spark = sizes.sparkSession
    shelf = Shelf(spark)
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).toArrow().to_pylist()
    target = targets({r["source"]: r["source_size"] for r in per_source}, weights, share, most)
    table = spark.createDataFrame(
        [(r["source"], r["source_size"], float(target[r["source"]]), max(1, -(-r["n"] // block))) for r in per_source],
        "s string, source_size long, target double, blocks long",
    )
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    rows = sizes.join(table, sizes["source"].eqNullSafe(table["s"]), "left").drop("s").withColumn("rate", rate)
    rows = rows.withColumn("sure", F.floor(F.col("rate") + 1e-9).cast("long")).withColumn("p", F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0)))

    columns = "unit long, unit2 long, source string, size long, p double, blocks long"

    def flight(last: bool):
        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["draw", "unit", "unit2"], ignore_index=True)
            p = fly(part.p.to_numpy(), part["size"].to_numpy(float), part.draw.to_numpy())
            return part.assign(p=land(p, part["size"].to_numpy(float)) if last else p)[["unit", "unit2", "source", "size", "p", "blocks"]]

        return run

    todo = rows.filter("p > 1e-9").select("unit", "unit2", "source", "size", "p", "blocks")
    decided, most_blocks, level = [], max([1, *(max(1, -(-r["n"] // block)) for r in per_source)]), 0
    while True:
        draw = F.pmod(F.xxhash64("unit", F.lit(level)), F.lit(1 << 40)) / float(1 << 40)
        slot = F.pmod(F.xxhash64("unit", F.lit(-1 - level)), F.col("blocks"))
        flown = todo.withColumn("draw", draw).groupBy("source", slot.alias("slot")).applyInPandas(flight(most_blocks == 1), columns)
        flown = shelf.put(flown, f"flight{level}")
        decided.append(flown.filter("p <= 0 or p >= 1").select("unit", "unit2", "p"))
        if most_blocks == 1:
            break
        most_blocks = -(-2 * most_blocks // block)
        todo = flown.filter("p > 0 and p < 1").withColumn("blocks", F.greatest(F.lit(1), F.ceil(2 * F.col("blocks") / block)))
        level += 1
    done = decided[0]
    for more in decided[1:]:
        done = done.unionByName(more)
    out = rows.join(done.withColumnRenamed("p", "extra"), ["unit", "unit2"], "left")
    return out.withColumn("copies", F.col("sure") + F.coalesce(F.col("extra"), F.lit(0.0)).cast("long")).drop("blocks", "rate", "sure", "p", "extra")


def units(sizes: DataFrame) -> DataFrame:
    """sizes with `unit` and `unit2`: the same numbers for a document in every run, also among rows of a repeated id."""
    part = ["doc_id", "source", "size"]
    counts = sizes.groupBy(*part).count()
    numbered = counts.select(*part, F.posexplode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth", "_")).drop("_")
    return numbered.select(F.xxhash64("doc_id", "source", "size", "nth").alias("unit"), F.xxhash64(F.lit(1), "nth", "size", "source", "doc_id").alias("unit2"), *part)


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row per document of docs."""
    sizes = sized(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "size")
    return plan(units(Shelf(docs.sparkSession).put(sizes, "sizes")), **settings)


def mixed(docs: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The mix itself: each row of docs as many times as it was taken (0 to 2 times), with the columns of docs.

    Rows of one id, source and size are told apart by the hash of their text; wholly equal ones are taken in any order.
    """
    keys = ["doc_id", "source", "size"]
    plain = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col(text_col).alias("text"))
    decided = mix_sources(plain, **settings)
    size, nth, copy, copies, *theirs = fresh(docs.columns, "_size", "_nth", "_copy", "_copies", "_id", "_source", "_words", "_turn")
    number = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    decided = decided.withColumn("nth", number(keys, ["unit", "unit2"]))
    decided = decided.filter("copies > 0").select(*(F.col(c).alias(t) for c, t in zip([*keys, "nth"], theirs, strict=True)), F.col("copies").alias(copies))
    rows = sized(docs, text_col, size)
    rows = rows.withColumn(nth, number(["doc_id", "source", size], [F.xxhash64(text_col)]))
    same = [rows[mine].eqNullSafe(decided[t]) for mine, t in zip(["doc_id", "source", size, nth], theirs, strict=True)]
    out = rows.join(decided, same)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
