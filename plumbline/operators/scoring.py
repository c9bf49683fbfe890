"""Versioned scoring of measured parts against their specification: gates, requirements, reward.

Measurements arrive as rows; no submitted code is run. `null` means not measured and never passes. A part is one row with
the spec's columns beside a `m` struct of measurements; `holes` is an array of structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tolerances (mm) and rounding allowance by scorer version.
TOLERANCES = {
    "0.4.0": {"linear": 0.5, "hole": 0.2, "position": 0.5, "margin": 0.5, "datum": 0.5, "eps": 1e-6},
    "0.5.0": {"linear": 0.1, "hole": 0.1, "position": 0.1, "margin": 0.1, "datum": 0.1, "eps": 1e-9},
}
# Shared limits.
PLATE_SHARE, MATERIAL_SHARE, FORM_LIMIT, SPAN, FLOOR, GATE_EPS = 0.12, 0.03, 1e-3, 0.01, 0.05, 1e-6
GATES = ("gate:single_solid", "gate:clean_solid", "gate:simple_through_holes", "gate:hole_count_sane", "gate:is_plate")
REQUIREMENTS = ("R1:length", "R2:width", "R3:thickness", "R4a:hole_count", "R4b:hole_diameter", "R5:hole_pattern", "R6:material", "R7:edge_margin", "R8:z_datum", "R9:no_other_features")


def close(a: Column, b: Column, tolerance: Column | float, eps: Column | float) -> Column:
    """Inclusive: |a - b| <= tolerance + eps."""
    return F.abs(a - b) <= F.lit(tolerance) + F.lit(eps)


def sure(condition: Column) -> Column:
    """Unknown is not a pass."""
    return F.coalesce(condition, F.lit(False))


def bores(diameter) -> Column:
    """Volume that the holes take, by each hole's own diameter or a given one."""
    return F.aggregate("m.holes", F.lit(0.0), lambda acc, h: acc + F.pi() * F.pow((h["diameter"] if diameter is None else diameter) / 2, 2) * (h["depth"] if diameter is None else F.col("m.thickness")))


def gates() -> dict[str, Column]:
    holes = F.col("m.holes")
    # Every position: one diameter, its first hole in one segment and through the stock, all open.
    here = lambda h: F.filter(holes, lambda g: (g["x"] == h["x"]) & (g["y"] == h["y"]))
    simple = F.forall(
        holes,
        lambda h: F.forall(here(h), lambda g: (g["diameter"] == h["diameter"]) & g["open"])
        & (here(h)[0]["segments"] == 1)
        & (F.abs(here(h)[0]["z_min"] - F.col("m.z_min")) <= SPAN + GATE_EPS)
        & (F.abs(here(h)[0]["z_max"] - F.col("m.z_max")) <= SPAN + GATE_EPS),
    )
    plate = F.col("m.length") * F.col("m.width") * F.col("m.thickness") - bores(None)
    return {
        "gate:single_solid": sure(F.col("m.solid_count") == 1),
        "gate:clean_solid": sure(F.col("m.valid") & (F.col("m.shell_count") == F.col("m.solid_count")) & (F.col("m.loose_count") == 0)),
        "gate:simple_through_holes": sure((F.size(holes) > 0) & simple),
        "gate:hole_count_sane": sure(F.size(holes) <= 3 * F.col("hole_count")),
        "gate:is_plate": sure((plate > 0) & (F.abs(F.col("m.volume") - plate) <= PLATE_SHARE * plate + GATE_EPS)),
    }


def corners() -> Column:
    """The four expected hole positions, to two decimals, each once."""
    x, y = F.round(F.col("length") / 2 - F.col("edge_margin"), 2), F.round(F.col("width") / 2 - F.col("edge_margin"), 2)
    return F.array_distinct(F.array(*(F.struct((sx * x).alias("x"), (sy * y).alias("y")) for sx in (-1, 1) for sy in (-1, 1))))


def pattern(one_to_one: Column) -> Column:
    """Each expected position has a hole within the tolerance; in the strict form no hole serves two positions.

    One-to-one is Hall's condition: any set of positions is near at least as many holes. Four positions have 15 sets.
    """
    holes, spots = F.col("m.holes"), corners()
    near = lambda p, h: F.sqrt(F.pow(p["x"] - h["x"], 2) + F.pow(p["y"] - h["y"], 2)) <= F.col("tol.position") + F.col("tol.eps")
    all_near = F.forall(spots, lambda p: F.exists(holes, lambda h: near(p, h)))
    subsets = F.sequence(F.lit(1), F.shiftleft(F.lit(1), 4) - 1)
    member = lambda s, i: s.bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0
    hall = F.forall(
        subsets,
        lambda s: F.size(F.filter(holes, lambda h: F.exists(F.filter(spots, lambda p, i: member(s, i)), lambda p: near(p, h))))
        >= F.size(F.filter(spots, lambda p, i: member(s, i))),
    )
    return F.when(one_to_one, hall).otherwise(all_near)


def margin() -> Column:
    """The largest deviation of a hole's distance to the nearest edge from the margin, on X and on Y."""
    def off(h):
        x = F.least(h["x"] - F.col("m.x_min"), F.col("m.x_max") - h["x"])
        y = F.least(h["y"] - F.col("m.y_min"), F.col("m.y_max") - h["y"])
        return F.greatest(F.abs(x - F.col("edge_margin")), F.abs(y - F.col("edge_margin")))

    return F.aggregate("m.holes", F.lit(0.0), lambda acc, h: F.greatest(acc, off(h)))


def form() -> tuple[Column, Column]:
    """(verdict, why) of the strict form check."""
    conform, boundary, extra, missing = (F.col(f"m.{c}") for c in ("surface_conformance", "boundary_consistent", "extra_volume", "missing_volume"))
    why = (
        F.when(conform.isNull() | boundary.isNull() | extra.isNull() | missing.isNull(), "not measured")
        .when(~conform, "a face lies off the envelope")
        .when(~boundary, "the boundary is inconsistent")
        .when(extra > FORM_LIMIT, "extra material")
        .when(missing > FORM_LIMIT, "missing material")
    )
    return why.isNull(), why


def requirements() -> dict[str, Column]:
    tol = lambda name: F.col(f"tol.{name}")
    eps = tol("eps")
    near = lambda name, kind: sure(close(F.col(f"m.{name}"), F.col(name), tol(kind), eps))
    holes = F.col("m.holes")
    strict = F.col("scorer_version") != "0.4.0"
    nominal = F.col("m.length") * F.col("m.width") * F.col("m.thickness") - F.col("hole_count") * F.pi() * F.pow(F.col("hole_diameter") / 2, 2) * F.col("m.thickness")
    return {
        "R1:length": near("length", "linear"),
        "R2:width": near("width", "linear"),
        "R3:thickness": near("thickness", "linear"),
        "R4a:hole_count": sure(F.size(holes) == F.col("hole_count")),
        "R4b:hole_diameter": sure((F.size(holes) > 0) & F.forall(holes, lambda h: close(h["diameter"], F.col("hole_diameter"), tol("hole"), eps))),
        "R5:hole_pattern": sure(pattern(strict)),
        "R6:material": sure((nominal > 0) & (F.abs(F.col("m.volume") - nominal) <= MATERIAL_SHARE * nominal + GATE_EPS)),
        "R7:edge_margin": sure((F.size(holes) > 0) & (margin() <= tol("margin") + eps)),
        "R8:z_datum": sure(F.abs((F.col("m.z_min") + F.col("m.z_max")) / 2) <= tol("datum") + eps),
        "R9:no_other_features": F.when(strict, form()[0]),
    }


def score(parts: DataFrame, specs: DataFrame) -> DataFrame:
    """parts: (spec_id, scorer_version, build_error, m); specs: (spec_id, length, ..., edge_margin).

    Adds checks (map; requirements that a version lacks are absent), gates_passed, reward, floored and binary reward.
    A build error or an unknown spec gives 0; a part whose scorer was unavailable must not come here.
    """
    spark = parts.sparkSession
    tolerances = spark.createDataFrame([(v, t) for v, t in TOLERANCES.items()], "scorer_version string, tol map<string,double>")
    tol = tolerances.select("scorer_version", F.struct(*(F.col("tol")[k].alias(k) for k in ("linear", "hole", "position", "margin", "datum", "eps"))).alias("tol"))
    rows = parts.join(F.broadcast(tol), "scorer_version").join(specs, "spec_id", "left")  # two versions: a fixed size
    gate, need = gates(), requirements()
    flags = F.map_from_arrays(F.array(*map(F.lit, [*gate, *need])), F.array(*gate.values(), *need.values()))
    built = F.col("build_error").isNull() & F.col("m").isNotNull() & F.col("length").isNotNull()
    rows = rows.withColumn("checks", F.when(built, F.map_filter(flags, lambda k, v: v.isNotNull())))
    passed = lambda names: F.forall(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.try_element_at("checks", n), F.lit(True)))
    wanted = F.map_filter("checks", lambda k, v: k.isin(*REQUIREMENTS))
    share = F.size(F.map_filter(wanted, lambda k, v: v)) / F.size(wanted)
    rows = rows.withColumn("gates_passed", sure(F.col("checks").isNotNull() & passed(GATES)))
    reward = F.when(F.col("gates_passed"), F.round(share, 4)).otherwise(0.0)
    rows = rows.withColumn("reward", reward)
    parsed = F.col("checks").isNotNull()
    return rows.withColumn("floored", F.when(parsed, F.greatest("reward", F.lit(FLOOR))).otherwise(0.0)).withColumn("binary", (parsed & (F.col("reward") == 1.0)).cast("double"))


def all_checks_pass(checks: str) -> Column:
    """There are checks, and all hold (not the same as reward = 1)."""
    return F.coalesce((F.size(checks) > 0) & F.forall(F.map_values(checks), lambda x: x), F.lit(False))


def observe(rows: DataFrame) -> DataFrame:
    """rows with `status` and `reason` of the observation map, judged in order."""
    holes = F.col("m.holes")
    through = lambda h: (h["z_min"] <= F.col("m.z_min") + 1e-7) & (h["z_max"] >= F.col("m.z_max") - 1e-7)
    reason = (
        F.when(F.coalesce(F.col("m.solid_count") != 1, F.lit(True)), "not_single_solid:solids")
        .when(F.coalesce(F.col("m.off_axis_bores") > 0, F.lit(False)), "out_of_scope:off-axis bores")
        .when(F.size("m.partial_bores") > 0, "out_of_scope:partial bores")
        .when(F.exists(holes, lambda h: ~through(h)), "out_of_scope:blind holes")
        .when(F.exists(holes, lambda h: h["segments"] != 1), "out_of_scope:stepped holes")
        .when(F.size(holes) != 4, "out_of_scope:hole count")
        .when(~form()[0], "form_violation:form")
    )
    return rows.withColumn("status", F.coalesce(F.split(reason, ":")[0], F.lit("ok"))).withColumn("reason", F.split(reason, ":")[1])
