"""How far a scorer agrees with known truth: rates, families, perturbations, an independent verdict, other targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tolerances (mm; the last a share of the volume) of a part against another target, and their allowance.
LINEAR, HOLE, MATERIAL, EPS = 0.5, 0.2, 0.03, 1e-6


def credit_rates(rows: DataFrame, wrong: Column, credited: Column, agree: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, wrong, right, false_credit, false_rejection, agreed, and their rates): denominators are at least 1.

    wrong: whether the part is wrong in truth; credited: whether it got full credit; agree: whether the failed checks are
    exactly those that should fail.
    """
    over = lambda n, of: F.col(n) / F.greatest(F.col(of), F.lit(1))
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.count_if(~wrong).alias("right"),
        F.count_if(wrong & credited).alias("false_credit"), F.count_if(~wrong & ~credited).alias("false_rejection"), F.count_if(agree).alias("agreed"),
    )
    return counts.withColumns({"false_credit_rate": over("false_credit", "wrong"), "false_rejection_rate": over("false_rejection", "right"), "agreement_rate": over("agreed", "n")})


def by_family(rows: DataFrame, family: str, agree: Column) -> DataFrame:
    """(family, agree, n)."""
    return rows.groupBy(family, agree.alias("agree")).agg(F.count("*").alias("n"))


def quadrants(scores: DataFrame, geometry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: the scorer's verdict against an independent one; `differing` lists the rows on which they differ.

    scores: keys and `passed`; geometry: keys and `nominal`. A score without a geometry is not counted.
    """
    passed, nominal = F.col("passed"), F.col("nominal")
    return scores.join(geometry, list(keys)).agg(
        F.count_if(passed & nominal).alias("pass_nominal"), F.count_if(passed & ~nominal).alias("pass_not_nominal"),
        F.count_if(~passed & nominal).alias("failure_nominal"), F.count_if(~passed & ~nominal).alias("failure_not_nominal"),
    )


def differing(scores: DataFrame, geometry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): pass_not_nominal or failure_nominal."""
    rows = scores.join(geometry, list(keys)).filter(F.col("passed") != F.col("nominal"))
    return rows.select(*keys, F.when(F.col("passed"), "pass_not_nominal").otherwise("failure_nominal").alias("side"))


def sensitivity(rows: DataFrame, by: Sequence[str], reward: Column, expected: Column, failed: str) -> DataFrame:
    """(by, n, caught, expected_failed, failed): perturbed parts that lost their full reward, those that failed the check
    meant for the change, and how often each check failed, as a map."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(reward != 1).alias("caught"), F.count_if(F.array_contains(F.col(failed), expected)).alias("expected_failed"))
    checks = rows.select(*by, F.explode(failed).alias("check")).groupBy(*by, "check").agg(F.count("*").alias("k"))
    named = checks.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("check", "k")))).alias("failed"))  # as many as checks
    return counts.join(named, list(by), "left").withColumn("failed", F.coalesce("failed", F.create_map().cast("map<string,bigint>")))


def eligible(parts: DataFrame, specs: DataFrame, reach: float = LINEAR + EPS) -> DataFrame:
    """(part, spec): the specs that a fixed part of four holes satisfies.

    parts: part, length, width, thickness, volume, holes (array of structs x, y, diameter); specs: spec, length, width,
    thickness, hole_diameter, pitch_x, pitch_y, edge_margin. An equi-join on buckets of the length, each spec in three,
    comes before the other conditions.
    """
    bucket = lambda x: F.floor(x / (2 * reach))
    p = parts.filter(F.size("holes") == 4).select("part", "holes", "volume", *(F.col(c).alias(f"p_{c}") for c in ("length", "width", "thickness")))
    p = p.withColumn("_b", bucket(F.col("p_length")))
    s = specs.withColumn("_b", F.explode(F.sequence(bucket(F.col("length")) - 1, bucket(F.col("length")) + 1)))
    near = lambda a, b, within: F.abs(a - b) <= within + EPS
    sizes = [near(F.col(f"p_{c}"), F.col(c), LINEAR) for c in ("length", "width", "thickness")]
    bores = F.forall("holes", lambda h: near(h["diameter"], F.col("hole_diameter"), HOLE))
    margins = F.forall("holes", lambda h: near(F.col("p_length") / 2 - F.abs(h["x"]), F.col("edge_margin"), LINEAR) & near(F.col("p_width") / 2 - F.abs(h["y"]), F.col("edge_margin"), LINEAR))
    corner = lambda sx, sy: F.exists("holes", lambda h: F.hypot(h["x"] - sx * F.col("pitch_x") / 2, h["y"] - sy * F.col("pitch_y") / 2) <= LINEAR + EPS)
    block = F.col("p_length") * F.col("p_width") * F.col("p_thickness")
    nominal = block - F.pi() * F.pow("hole_diameter", F.lit(2)) * F.col("p_thickness")
    material = F.abs(F.col("volume") - nominal) <= MATERIAL * nominal + EPS
    rows = p.join(s, "_b")
    for rule in (*sizes, bores, margins, material, *(corner(x, y) for x in (-1, 1) for y in (-1, 1))):
        rows = rows.filter(rule)
    return rows.select("part", "spec")
