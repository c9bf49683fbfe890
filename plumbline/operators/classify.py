"""Failure labels by ordered rules: the first that holds wins.

An answer is judged by what its run says (unfinished, not built), then by its measured holes, then by its failed checks.
Submitted code is never run: measurements arrive as columns, and code is only searched by patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import first_match

# Distance (mm) within which two lengths are the same.
SAME = 0.5
# Patterns and labels of answers that didn't build.
SYNTAX = "SyntaxError|IndentationError"
KERNEL = r"Standard_\w+|StdFail|BRep_API|TopoDS"
TYPES = "(?:Workplane|Sketch|Assembly|Shape|Solid|Compound|Face|Wire|Edge|Vertex|Shell|Vector|Location|Plane|Matrix)"
LIBRARY = (
    rf"AttributeError: '{TYPES}' object has no attribute|AttributeError: module 'cadquery[\w.]*' has no attribute|TypeError: {TYPES}\.\w+\(\)"
    "|DispatchError|Cannot find a solid on the stack|No pending wires present|No pending edges|Do not know how to handle until argument|Cannot union type"
)
NO_PART = "did not define|no CadQuery shape|no solid|no code|not a shape"
ORIGIN = r"^execution failed \[raised in (model code|cadquery(?:: ([\w.<>]+))?|other library)\]"
ORIGIN_AT_END = r"\[raised in ([\w ]+)\]\s*$"
# Kinds of API misuse; {1} and {2} are the groups of the pattern.
API_KINDS = (
    (r"DispatchError: \('(\w+): \d+ methods found', \(<class '[\w.]*?(\w+)'>", "no matching signature for {2}.{1}()"),
    (r"No pending wires present", "operation needs a sketch or wire"),
    (r"cannot be interpreted as an integer", "non-integer count"),
    (r"Do not know how to handle until argument", "invalid extrude or cut argument"),
    (r"AttributeError: '(\w+)' object has no attribute '(\w+)'", "no such method: {1}.{2}"),
    (r"AttributeError: module '([\w.]+)' has no attribute '(\w+)'", "no such function: {1}.{2}"),
    (r"TypeError: (?:[\w.]+\.)?(\w+)\(\) (?:takes|got|missing)", "wrong arguments to {1}()"),
    (r"Cannot find a solid on the stack", "operation needs a solid on the stack"),
    (r"NameError: name '(\w+)' is not defined", "undefined name"),
    (r"Cannot union type", "union needs a solid or shape"),
)
# What in the code places a drill, drills twice, or anchors a pattern at a corner.
PLACED = r"\.(transformed|moveTo|move|pushPoints|vertices|rarray|polarArray)\s*\(|\.center\(\s*(?!0(\.0)?\s*,\s*0(\.0)?\s*\))"
DRILL = r"\.hole\s*\("
SAME_SPOT = r"(?s)for\s+(\w+)[^:]*:\s*\n(?:(?!\1).)*?\.hole\("
CORNER = r"centered\s*=\s*False|[\[,]\s*\(\s*0(\.0)?\s*,\s*0(\.0)?\s*\)"
# Failed checks and their labels, in order; the groups of labels.
CHECKS = (
    ("gate:single_solid", "gate: single_solid"), ("gate:clean_solid", "gate: clean_solid"), ("gate:simple_through_holes", "gate: simple_through_holes"),
    ("gate:hole_count_sane", "gate: hole_count_sane"), ("gate:is_plate", "gate: is_plate"),
    ("R1:length", "wrong plate size"), ("R2:width", "wrong plate size"), ("R3:thickness", "wrong plate size"), ("R8:z_datum", "off Z datum"),
    ("R4b:hole_diameter", "wrong hole diameter"), ("R4a:hole_count", "wrong hole count"), ("R6:material", "material off"), ("R7:edge_margin", "edge margin off"),
    ("R5:hole_pattern", "holes misplaced (other)"), ("R9:no_other_features", "unrequested feature"),
)
GROUPS = {
    "did not finish": ("API error", "degenerate loop", "cut off"),
    "code did not build": ("syntax error", "CadQuery API error", "geometry kernel failure", "Python error in model code", "no part produced", "timeout", "build failed", "classifier error"),
    "holes not bound to positions": ("holes stacked at one point", "holes drilled along the wrong axis", "no holes"),
    "hole pattern misread": ("pattern anchored at a corner", "margin applied twice", "X and Y swapped", "pitch read as coordinates", "one axis misplaced", "some holes right, some wrong", "holes misplaced (other)"),
    "change order not applied": ("change order ignored", "change not propagated to pitch"),
    "gate fired": ("gate: single_solid", "gate: clean_solid", "gate: simple_through_holes", "gate: hole_count_sane", "gate: is_plate"),
    "one dimension wrong": ("wrong plate size", "off Z datum", "wrong hole diameter", "wrong hole count", "material off", "edge margin off", "other"),
}


def group_of(label: Column) -> Column:
    """The group of a label; null for a label of none."""
    return F.coalesce(*(F.when(label.isin(*labels), F.lit(group)) for group, labels in GROUPS.items()))


def same(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= SAME


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def error_origin(error: Column) -> Column:
    """struct(origin, function) from the tag of an error text, at its start or, in older files, at its end; nulls without one."""
    error = F.coalesce(error, F.lit(""))
    tagged = found(error, ORIGIN)
    origin = F.when(tagged.startswith("cadquery"), F.lit("cadquery")).otherwise(tagged)
    return F.struct(F.coalesce(origin, found(error, ORIGIN_AT_END)).alias("origin"), found(error, ORIGIN, 2).alias("function"))


def unbuilt_label(error: Column, timeout: Column | None = None) -> Column:
    error = F.coalesce(error, F.lit(""))
    origin, failed = error_origin(error)["origin"], error.startswith("execution failed")
    late = F.coalesce(timeout, F.lit(False)) if timeout is not None else F.lit(False)
    rules = [
        ("timeout", late | error.contains("execution budget")),
        ("syntax error", error.rlike(SYNTAX)),
        ("geometry kernel failure", failed & error.rlike(KERNEL)),
        ("CadQuery API error", failed & (error.rlike(LIBRARY) | origin.eqNullSafe(F.lit("cadquery")))),
        ("Python error in model code", failed & origin.eqNullSafe(F.lit("model code"))),
        ("no part produced", ~failed & (error.rlike(NO_PART) | (error == ""))),
    ]
    return first_match(rules, "build failed")


def api_kind(error: Column) -> Column:
    """What the code got wrong, by the first pattern; else the exception and, if tagged, the function that raised it."""
    error = F.coalesce(error, F.lit(""))
    kinds = []
    for pattern, form in API_KINDS:
        text = F.lit(form)
        for group in (1, 2):
            if f"{{{group}}}" in form:
                text = F.replace(text, F.lit(f"{{{group}}}"), F.regexp_extract(error, pattern, group))
        kinds.append(F.when(error.rlike(pattern), F.replace(text, F.lit(".__init__()"), F.lit("()"))))
    exception = F.coalesce(found(error, r"execution failed(?: \[[^\]]*\])?: (\w+)"), F.lit("unknown"))
    function = error_origin(error)["function"]
    return F.coalesce(*kinds, F.concat(exception, F.lit(" in "), function, F.lit("()")), exception)


def check_label(checks: Column) -> Column:
    """The label of the first failed check in their fixed order, or 'other'; a missing check is not a failure."""
    return first_match([(label, F.try_element_at(checks, F.lit(name)).eqNullSafe(F.lit(False))) for name, label in CHECKS], "other")


def axis(values: Column, pitch: Column, other: Column, margin: Column) -> Column:
    """What the hole coordinates along one axis look like, by their extremes."""
    low, high = F.array_min(values), F.array_max(values)
    spacing, centre = high - low, (high + low) / 2
    return first_match(
        [
            ("ok", same(spacing, pitch) & same(centre, F.lit(0.0))),
            ("corner", same(spacing, pitch) & same(F.abs(centre), pitch / 2)),
            ("shifted", same(spacing, pitch)),
            ("margin twice", same(spacing, F.abs(pitch - 2 * margin))),
            ("swapped", same(spacing, other) & ~same(pitch, other)),
            ("coords", same(spacing, 2 * pitch)),
        ],
        "other",
    )


def predicted(kind: Column, values: Column, pitch: Column, other: Column, margin: Column) -> Column:
    """The coordinates at which all holes of an axis sit if it is of this kind; empty for kinds that predict none."""
    pair = lambda x: F.array(-x, x)
    low = F.array_min(values)
    return (
        F.when(kind == "ok", pair(pitch / 2))
        .when(kind == "corner", F.array(low, low + pitch))
        .when(kind == "margin twice", pair(F.abs(pitch / 2 - margin)))
        .when(kind == "swapped", pair(other / 2))
        .when(kind == "coords", pair(pitch))
        .otherwise(F.array().cast("array<double>"))
    )


def drilled_again(code: Column) -> Column:
    """Several drills with nothing that moves the drill in between."""
    return ((F.regexp_count(code, F.lit(DRILL)) >= 2) & ~code.rlike(PLACED)) | code.rlike(SAME_SPOT)


def single_point_label(x: Column, y: Column, code: Column) -> Column:
    """The label of a plate with holes at one position only."""
    dense, origin = F.regexp_replace(code, r"\s+", ""), same(x, F.lit(0.0)) & same(y, F.lit(0.0))
    one_rectangle = dense.contains(".rect(") & ~dense.contains(".vertices()") & ~dense.contains("pushPoints")
    rules = [("holes stacked at one point", drilled_again(code) | (origin & one_rectangle)), ("pattern anchored at a corner", origin & code.rlike(CORNER))]
    return first_match(rules, "holes misplaced (other)")


def pattern_label(points: Column, pitch_x: Column, pitch_y: Column, margin: Column, code: Column, off_axis: Column) -> Column:
    """Null if the hole pattern is right, else what is wrong with it. points: array<struct<x, y>> of holes and partial
    bores; a mistake is named only if every hole sits where it predicts."""
    code = F.coalesce(code, F.lit(""))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    kx, ky = axis(xs, pitch_x, pitch_y, margin), axis(ys, pitch_y, pitch_x, margin)
    gx, gy = predicted(kx, xs, pitch_x, pitch_y, margin), predicted(ky, ys, pitch_y, pitch_x, margin)
    fits = F.forall(points, lambda p: F.exists(gx, lambda g: same(p["x"], g)) & F.exists(gy, lambda g: same(p["y"], g)))
    nominal = F.array(*(F.struct((sx * pitch_x / 2).alias("x"), (sy * pitch_y / 2).alias("y")) for sx in (-1, 1) for sy in (-1, 1)))
    at = lambda p, q: same(p["x"], q["x"]) & same(p["y"], q["y"])
    hits = F.size(F.filter(nominal, lambda n: F.exists(points, lambda p: at(p, n))))
    stray = F.exists(points, lambda p: ~F.exists(nominal, lambda n: at(p, n)))
    only = lambda *kinds: kx.isin(*kinds) & ky.isin(*kinds)
    has = lambda kind: (kx == kind) | (ky == kind)
    places = F.size(F.array_distinct(F.transform(points, lambda p: F.struct(F.bround(p["x"] / SAME, 0), F.bround(p["y"] / SAME, 0)))))
    named = lambda kind: fits & has(kind) & only(kind, "ok")
    several = (
        F.when(only("ok"), F.when(stray, F.when(hits > 0, "some holes right, some wrong").otherwise("holes misplaced (other)")))
        .when(named("corner"), "pattern anchored at a corner")
        .when(named("margin twice"), "margin applied twice")
        .when(fits & only("swapped"), "X and Y swapped")
        .when(named("coords"), "pitch read as coordinates")
        .when((hits > 0) & (hits < 4), "some holes right, some wrong")
        .when(has("ok"), "one axis misplaced")
        .otherwise("holes misplaced (other)")
    )
    sideways = F.when(drilled_again(code), "holes stacked at one point").otherwise("holes drilled along the wrong axis")
    none = F.when(F.coalesce(off_axis, F.lit(0)) > 0, sideways).otherwise("no holes")
    return F.when(F.size(points) == 0, none).when(places == 1, single_point_label(points[0]["x"], points[0]["y"], code)).otherwise(several)


def change_label(m: str, points: Column, rects: Column) -> Column:
    """What a change order came to: null unless it was ignored, or the hole pattern kept the old pitch.

    m: the column of measurements. The spec's columns and those of its source (a_*) are beside it; rects holds the pairs
    of numbers of rectangles that the code states, which decide where the geometry can't.
    """
    extent = lambda c: F.coalesce(F.array_max(F.transform(points, lambda p: p[c])) - F.array_min(F.transform(points, lambda p: p[c])), F.lit(0.0))
    pitches = lambda a: (F.col(f"{a}length") - 2 * F.col(f"{a}edge_margin"), F.col(f"{a}width") - 2 * F.col(f"{a}edge_margin"))
    sizes = lambda a: tuple(F.col(f"{a}{c}") for c in ("length", "width", "thickness"))
    all_same = lambda p, q: [same(x, y) for x, y in zip(p, q, strict=True)]
    both = lambda conditions: F.forall(F.array(*conditions), lambda c: c)
    size, pitch = sizes(f"{m}."), (extent("x"), extent("y"))
    smallest = F.array_min(F.transform(F.col(f"{m}.holes"), lambda h: F.round(h["diameter"], 1)))
    old_bore = F.coalesce(same(smallest, F.col("a_hole_diameter")), F.lit(True))
    looks_old = both([*all_same(size, sizes("a_")), *all_same(pitch, pitches("a_")), old_bore])
    differs = ~both(all_same(sizes("a_"), sizes(""))) | ~same(F.col("a_hole_diameter"), F.col("hole_diameter"))
    moved, new_size = ~both(all_same(pitches("a_"), pitches(""))), both(all_same(size, sizes("")))
    stated = lambda a: F.exists(F.coalesce(rects, F.array().cast("array<array<double>>")), lambda r: same(r[0], pitches(a)[0]) & same(r[1], pitches(a)[1]))
    stale = both(all_same(pitch, pitches("a_"))) | (stated("a_") & ~stated(""))
    return F.when(looks_old & differs, "change order ignored").when(moved & new_size & stale, "change not propagated to pitch")


def failure_label(row: dict[str, Column], pattern: Column, change: Column | None = None) -> Column:
    """The label of a failed answer. row: api_error, truncated, degenerate, built, error, timeout, measured, tier, checks.

    pattern, change: pattern_label and change_label; the latter counts for the tier L4 only.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(row["api_error"].isNotNull() & (row["api_error"] != ""), "API error")
        .when(~no(row["truncated"]), F.when(no(row["degenerate"]), "cut off").otherwise("degenerate loop"))
        .when(no(row["built"]), unbuilt_label(row["error"], row["timeout"]))
        .when(no(row["measured"]), "build failed")
        .otherwise(F.coalesce(*([F.when(row["tier"] == "L4", change)] if change is not None else []), pattern, check_label(row["checks"])))
    )
