"""Holes from cylinder faces: the relational core of measurement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import selection

# Share of the wall that makes a hole or a partial bore, and the gap that joins intervals.
FULL, PARTIAL, GAP = 0.99, 0.30, 1e-4


def bores(faces: DataFrame) -> DataFrame:
    """(part, x, y, diameter, coverage, z_min, z_max, segments, kind) from concave cylinder faces along Z.

    faces: part, cx, cy, radius, area, z_min, z_max. Faces of one axis and diameter are one bore; its coverage is their
    area over that of the full wall.
    """
    keyed = faces.select("part", F.round("cx", 3).alias("x"), F.round("cy", 3).alias("y"), F.round(2 * F.col("radius"), 4).alias("diameter"), "area", F.col("z_min").alias("lo"), F.col("z_max").alias("hi"))
    keys = ["part", "x", "y", "diameter"]
    spans = selection.interval_union(keyed, keys, "lo", "hi", GAP)
    rows = keyed.groupBy(*keys).agg(F.sum("area").alias("area")).join(spans, keys)
    coverage = F.col("area") / (F.pi() * F.col("diameter") * F.col("covered"))
    kind = F.when(coverage >= FULL, "hole").when(coverage >= PARTIAL, "partial")
    return rows.select(*keys, coverage.alias("coverage"), F.col("first_low").alias("z_min"), F.col("last_high").alias("z_max"), "segments", kind.alias("kind")).filter("kind is not null")


def off_axis(faces: DataFrame) -> DataFrame:
    """(part, n): whole bores whose axis isn't Z; faces of one axis and diameter are one bore.

    faces: part, dx, dy, dz, px, py, pz (axis direction and a point on it), diameter, area, low, high (along the direction,
    from the point). A bore counts if its faces cover at least FULL of the wall over their merged spans.
    """
    flip = F.when((F.col("dz") < -1e-9) | ((F.abs("dz") <= 1e-9) & ((F.col("dy") < -1e-9) | ((F.abs("dy") <= 1e-9) & (F.col("dx") < 0)))), -1.0).otherwise(1.0)
    along = F.col("px") * F.col("dx") + F.col("py") * F.col("dy") + F.col("pz") * F.col("dz")
    foot = [F.round(F.col(f"p{c}") - along * F.col(f"d{c}"), 3).alias(f"f{c}") for c in "xyz"]
    axis = [F.round(F.col(f"d{c}") * flip, 3).alias(f"a{c}") for c in "xyz"]
    ends = [flip * (along + F.col(c)) for c in ("low", "high")]
    keyed = faces.filter(F.abs("dz") < 1 - 1e-9).select("part", *axis, *foot, F.round("diameter", 4).alias("d"), "area", F.least(*ends).alias("lo"), F.greatest(*ends).alias("hi"))
    keys = ["part", "ax", "ay", "az", "fx", "fy", "fz", "d"]
    per = keyed.groupBy(*keys).agg(F.sum("area").alias("area")).join(selection.interval_union(keyed, keys, "lo", "hi", GAP), keys)
    return per.filter((F.col("covered") > 0) & (F.col("area") >= FULL * F.pi() * F.col("d") * F.col("covered"))).groupBy("part").agg(F.count("*").alias("n"))


# Positions and dimensions closer than these (mm) are the same.
SAME_PLACE, SAME_SIZE = 1e-7, 1e-9


def nested(axes: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, key_a, key_b): pairs of different circles of a part of which the larger one holds the other's centre.

    axes: by, key, x, y, d. Circles of one place and size are one. A grid join: a circle covers the cells of its own
    level, whose cells are as wide as the next power of two of its diameter (so it touches four at most); every circle
    looks its centre up once for each level at or above its own that the part has. So circles meet where they may overlap,
    and a large circle doesn't widen the cells of small ones.
    """
    level = F.ceil(F.log2("d")).cast("int")
    rows = axes.filter(F.col("d") > 0).select(*by, F.col(key).alias("key"), "x", "y", "d", level.alias("level"))
    cell = lambda v, at: F.floor(v / F.pow(F.lit(2.0), at)).cast("long")
    ends = lambda c: F.sequence(cell(F.col(c) - F.col("d") / 2, F.col("level")), cell(F.col(c) + F.col("d") / 2, F.col("level")))
    large = rows.withColumn("cx", F.explode(ends("x"))).withColumn("cy", F.explode(ends("y")))
    levels = rows.groupBy(*by).agg(F.array_sort(F.collect_set("level")).alias("levels"))  # few: sizes are some powers of two
    small = rows.join(levels, by).withColumn("at", F.explode(F.filter("levels", lambda x: x >= F.col("level")))).drop("levels")
    small = small.select(*by, *(F.col(c).alias(f"{c}_") for c in ("key", "x", "y", "d")), F.col("at").alias("level"), cell(F.col("x"), F.col("at")).alias("cx"), cell(F.col("y"), F.col("at")).alias("cy"))
    near = F.hypot(F.col("x") - F.col("x_"), F.col("y") - F.col("y_"))
    larger = (F.col("d") > F.col("d_")) | ((F.col("d") == F.col("d_")) & (F.col("key") < F.col("key_")))
    other = ~((near <= SAME_PLACE) & (F.abs(F.col("d") - F.col("d_")) <= SAME_SIZE))
    found = large.join(small, [*by, "level", "cx", "cy"]).filter(larger & (near < F.col("d") / 2) & other)
    return found.select(*by, F.least("key", "key_").alias(f"{key}_a"), F.greatest("key", "key_").alias(f"{key}_b"))
