import math

import pytest

from plumbline.operators import scoring

PART = """spec_id string, scorer_version string, build_error string, m struct<length:double,width:double,thickness:double,volume:double,solid_count:int,shell_count:int,
loose_count:int,valid:boolean,x_min:double,x_max:double,y_min:double,y_max:double,z_min:double,z_max:double,off_axis_bores:int,
surface_conformance:boolean,boundary_consistent:boolean,extra_volume:double,missing_volume:double,partial_bores:array<struct<diameter:double>>,
holes:array<struct<diameter:double,x:double,y:double,depth:double,z_min:double,z_max:double,segments:int,open:boolean>>>"""
SPEC = "spec_id string, length double, width double, thickness double, hole_diameter double, edge_margin double, hole_count int"


def part(version="0.5.0", error=None, holes=None, **change):
    spots = holes if holes is not None else [(sx * 40.0, sy * 20.0, 6.5) for sx in (-1, 1) for sy in (-1, 1)]
    m = {"length": 100.0, "width": 60.0, "thickness": 8.0, "solid_count": 1, "shell_count": 1, "loose_count": 0, "valid": True, "off_axis_bores": 0,
         "surface_conformance": True, "boundary_consistent": True, "extra_volume": 0.0, "missing_volume": 0.0, "partial_bores": [],
         "z_min": -4.0, "z_max": 4.0} | change
    m |= {"x_min": -m["length"] / 2, "x_max": m["length"] / 2, "y_min": -m["width"] / 2, "y_max": m["width"] / 2}
    m.setdefault("volume", m["length"] * m["width"] * m["thickness"] - sum(math.pi * (d / 2) ** 2 * m["thickness"] for _, _, d in spots))
    m["holes"] = [{"diameter": d, "x": x, "y": y, "depth": m["thickness"], "z_min": m["z_min"], "z_max": m["z_max"], "segments": 1, "open": True} for x, y, d in spots]
    return {"spec_id": "s", "scorer_version": version, "build_error": error, "m": None if error else m}


def scored(spark, *parts):
    specs = spark.createDataFrame([("s", 100.0, 60.0, 8.0, 6.5, 10.0, 4)], SPEC)
    rows = scoring.score(spark.createDataFrame(list(parts), PART), specs).collect()
    return rows[0] if len(rows) == 1 else rows


def failed(row):
    return {k for k, v in row.checks.items() if not v}


def test_perfect_part(spark):
    row = scored(spark, part())
    assert failed(row) == set() and (row.reward, row.binary) == (1.0, 1.0)
    old = scored(spark, part("0.4.0"))
    assert "R9:no_other_features" not in old.checks and old.reward == 1.0


@pytest.mark.parametrize(("version", "diameter", "ok"), [("0.5.0", 6.6, True), ("0.5.0", 6.600001, False), ("0.4.0", 6.7, True), ("0.4.0", 6.71, False)])
def test_diameter_edges(spark, version, diameter, ok):
    spots = [(sx * 40.0, sy * 20.0, diameter) for sx in (-1, 1) for sy in (-1, 1)]
    assert ("R4b:hole_diameter" in failed(scored(spark, part(version, holes=spots)))) is not ok


def test_unknown_is_never_a_pass(spark):
    assert failed(scored(spark, part(surface_conformance=None))) == {"R9:no_other_features"}


def test_build_error_and_gate_give_zero(spark):
    row = scored(spark, part(error="no code"))
    assert (row.reward, row.floored, row.checks) == (0.0, 0.0, None)
    row = scored(spark, part(solid_count=2, shell_count=2))
    assert failed(row) == {"gate:single_solid"} and (row.reward, row.floored) == (0.0, 0.05)


def test_one_to_one_pattern(spark):
    # Two holes stacked near one corner, none at another: any-match and one-to-one both fail; a missing corner fails R5.
    spots = [(-40.0, -20.0, 6.5), (-40.05, -20.0, 6.5), (40.0, -20.0, 6.5), (40.0, 20.0, 6.5)]
    assert "R5:hole_pattern" in failed(scored(spark, part(holes=spots)))
    spots = [(-40.0, -20.0, 6.5), (-40.0, 20.0, 6.5), (40.0, -20.0, 6.5), (40.0, 20.05, 6.5)]
    assert "R5:hole_pattern" not in failed(scored(spark, part(holes=spots)))


def test_fifth_hole_leaves_the_pattern(spark):
    spots = [(sx * 40.0, sy * 20.0, 6.5) for sx in (-1, 1) for sy in (-1, 1)] + [(0.0, 0.0, 6.5)]
    got = failed(scored(spark, part(holes=spots)))
    assert "R4a:hole_count" in got and "R5:hole_pattern" not in got


def test_size_partial_credit(spark):
    row = scored(spark, part(length=101.0))
    assert {"R1:length", "R7:edge_margin"} <= failed(row) and row.reward == round((10 - len(failed(row))) / 10, 4)


def test_observation(spark):
    frame = spark.createDataFrame([part(), part(solid_count=2), part(off_axis_bores=1), part(extra_volume=1.0)], PART)
    assert [r.status for r in scoring.observe(frame).collect()] == ["ok", "not_single_solid", "out_of_scope", "form_violation"]
