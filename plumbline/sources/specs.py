"""Specifications: feasibility, seeded generation, splits, fingerprints, tasks."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import selection

SCHEMA = "id string, length double, width double, thickness double, hole_diameter double, edge_margin double, hole_count int"
TIERS = ("L0", "L1", "L2", "L3", "L4")
# Seeds and sizes of the splits; bounds of draws in half millimetres (upper ends excluded); limits in mm.
SAMPLE_SEED, TEST_SEED, N_TRAIN, N_EVAL, N_TEST = 20260813, 20260927, 200, 30, 60
LENGTHS, WIDTHS, THICKNESSES, LEAST_BORE = (80, 441), (60, 321), (6, 29), 8
MARGIN_LEAST, MARGIN_MOST, BORE_MOST, RIM, WEB, SHARE = 5.0, 25.0, 13.0, 2.0, 4.0, 5


def derived(specs: DataFrame) -> DataFrame:
    """specs with pitches and ideal volume."""
    pitch = lambda c: F.col(c) - 2 * F.col("edge_margin")
    hole = F.pi() * F.pow(F.col("hole_diameter") / 2, 2) * F.col("thickness")
    return specs.withColumns({"pitch_x": pitch("length"), "pitch_y": pitch("width"), "ideal_volume": F.col("length") * F.col("width") * F.col("thickness") - F.col("hole_count") * hole})


def feasible() -> Column:
    """Whether a spec keeps the limits, with a slack of 1e-9: margin and web wide enough, stock thin enough."""
    d, m, slack = F.col("hole_diameter"), F.col("edge_margin"), 1e-9
    web = [F.col(c) - 2 * m - d >= WEB - slack for c in ("length", "width")]
    thin = F.col("thickness") <= F.least("length", "width") / SHARE + slack
    return (m >= F.greatest(F.lit(MARGIN_LEAST), d / 2 + RIM) - slack) & (m <= MARGIN_MOST + slack) & web[0] & web[1] & thin & (d >= LEAST_BORE / 2)


def drawn(rng: random.Random, number: int) -> tuple:
    """A spec row; draws are repeated from the start until a margin is left. The order of draws fixes the rows."""
    half = lambda low, high: rng.randrange(low, high) / 2
    while True:
        length, width, thickness = (half(*bounds) for bounds in (LENGTHS, WIDTHS, THICKNESSES))
        bore = half(LEAST_BORE, int(2 * min(BORE_MOST, width / 2 - 6)))
        room = (min(length, width) - bore - WEB) / 2
        low, high = math.ceil(2 * max(MARGIN_LEAST, bore / 2 + RIM) - 1e-9), math.floor(2 * min(MARGIN_MOST, room) + 1e-9)
        if low <= high and SHARE * thickness <= min(length, width):
            return f"gen-{number:04d}", length, width, thickness, bore, half(low, high + 1), 4


def sample(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n feasible specs on the half-millimetre grid; Python's generator makes them in order, so they come from the driver."""
    rng = random.Random(seed)
    return spark.createDataFrame([drawn(rng, i) for i in range(n)], SCHEMA)


def splits(specs: DataFrame, edge: int = N_EVAL // 3, every: int = N_TRAIN // (N_EVAL // 3), most: int = N_EVAL // 3) -> DataFrame:
    """specs with `split`: eval for the smallest and largest `edge` by area and every n-th in between, train for the rest."""
    number = F.substring_index("id", "-", -1).cast("int")  # equal areas keep the order of drawing
    ordered = specs.withColumns({"area": F.col("length") * F.col("width"), "number": number})
    chosen = selection.stratified_split(ordered, ["area", "number", "id"], edge, every, most).select("id").withColumn("split", F.lit("eval"))
    return specs.join(chosen, "id", "left").fillna("train", ["split"])


def locked_split(spark: SparkSession, seed: int = TEST_SEED, n: int = N_TEST) -> DataFrame:
    """The test split: the first n specs of its seed with parameters that no train or eval spec and no former one has."""
    generator = random.Random(SAMPLE_SEED)
    seen = {drawn(generator, i)[1:6] for i in range(N_TRAIN + N_EVAL)}
    rng, rows = random.Random(seed), []
    while len(rows) < n:
        row = drawn(rng, 0)
        if row[1:6] not in seen:
            seen.add(row[1:6])
            rows.append((f"test-{len(rows) + 1:04d}", *row[1:]))
    return spark.createDataFrame(rows, SCHEMA).withColumn("split", F.lit("test"))


def fingerprint(specs: DataFrame, order: str = "id") -> DataFrame:
    """(split, sha256): over ids and parameters of a split, in order, as compact JSON."""
    numbers = [F.col(c).cast("string") for c in ("length", "width", "thickness", "hole_diameter", "edge_margin")]
    line = F.concat(F.lit('["'), F.col("id"), F.lit('",'), F.concat_ws(",", *numbers), F.lit("]"))
    rows = specs.groupBy("split").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), line.alias("line")))).alias("r"))  # a split has some hundred specs
    return rows.select("split", F.sha2(F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["line"]), ","), F.lit("]")), 256).alias("sha256"))


def moved(tolerances: dict[str, float], slack: float = 0.25) -> Column:
    """Whether any field of revision A (a_*) differs from the spec by more than its tolerance and slack."""
    out = F.lit(False)
    for name, tolerance in tolerances.items():
        out = out | (F.abs(F.col(name) - F.col(f"a_{name}")) > tolerance + slack)
    return out
