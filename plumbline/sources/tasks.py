"""Tasks: the prompt of a specification at each tier."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import changes
from plumbline.functions.text import short_number
from plumbline.sources import specs as source

# The texts of the prompts, as models have been given them, and which wordings a split may see.
REQUIREMENTS = """\
REQUIREMENTS
  R1  Overall length (X):        {length} mm
  R2  Overall width (Y):         {width} mm
  R3  Plate thickness (Z):       {thickness} mm
  R4  Fastener holes:            {hole_count} off, through, {hole_diameter} mm diameter
{pattern}  R6  Edge margin:               {edge_margin} mm from hole centre to each nearest edge
"""
PITCHES = "  R5  Hole pattern:              rectangular, {pitch_x} mm x {pitch_y} mm centres\n"
CORNERS = "  R5  Hole pattern:              rectangular, one hole near each corner\n"
MODEL = """\
import cadquery as cq
result = (
    cq.Workplane("XY")
    .box({L}, {W}, {T})
    .faces(">Z").workplane()
    .rect({PX}, {PY}, forConstruction=True)
    .vertices()
    .hole({D})
)
"""
GAPS = re.sub(r"\{\w+\}", "???", MODEL)
FILL = (
    "Fill in the CadQuery template below so the part meets every requirement.\n\n",
    "\nTEMPLATE (replace each ??? with the correct number; change nothing else):\n\n" + GAPS + "\n"
    "box() takes (length_x, width_y, thickness_z). rect() takes the hole pattern\n"
    "centre distances (pitch_x, pitch_y). hole() takes a DIAMETER, not a radius.\n"
    "The plate is centred on the origin.\n\n"
    "The completed template is the ENTIRE answer: a runnable Python module, with\n"
    "`import` and `result` at column zero exactly as shown above. Substitute the\n"
    "numbers and change nothing else. Do not add loops, extra holes, extra\n"
    "features, comments, or any further operations after the closing parenthesis.\n",
)
WRITE = (
    "Write a CadQuery Python module that builds the part below and binds the\nfinished solid to a variable named `result`.\n\n",
    "\nThe plate is centred on the origin with its thickness along Z.\n",
)
PROSE = (
    "I need a flat mounting plate, {L} by {W} mm and {T} mm thick. Put a {D} mm through hole near each of the four corners, with every hole centre {M} mm in from both of its nearest edges. Keep it centred on the origin. Write it in CadQuery and assign the part to `result`.",
    "DRAWING NOTES\nPLATE {L} x {W} x {T} THK (MM)\n4X Ø{D} THRU\nHOLE CENTRES {M} FROM ADJACENT EDGES, TYP 4 PL\nPART CENTRED ON ORIGIN, THICKNESS ALONG Z\n\nModel this in CadQuery; the solid must be bound to `result`.",
    "Model a rectangular bolt plate in CadQuery. The four holes are {D} mm clearance holes, drilled all the way through, on a {PX} x {PY} mm rectangular pattern centred on the origin. The plate itself is {L} mm along X, {W} mm along Y and {T} mm along Z. Store the solid in `result`.",
    "Supplier spec: bracket plate, material thickness {T} mm, blank size {L} mm (X) x {W} mm (Y). Four plain holes, diameter {D} mm, through all, one per corner at {M} mm edge distance in both directions. Origin at the blank centre. Provide CadQuery with the part in `result`.",
    "Hi, could you knock up the adapter plate in CadQuery? Stock is {T} mm plate cut to {W} mm wide (Y) and {L} mm long (X). It needs four {D} mm holes straight through, spaced {PX} mm apart along the length and {PY} mm apart across the width, pattern centred on the plate, plate centred on the origin. Please leave the finished body in a variable called result.",
    "Inspection criteria for part to be modelled in CadQuery (bind to `result`): envelope {L} x {W} x {T} mm, centred at (0, 0, 0). Qty 4 through bores of radius {R} mm. Each bore axis lies {M} mm from the two closest outer edges. No other features.",
)
SEEN, HELD_OUT = (0, 1, 2, 3), (4, 5)
EDIT = (
    "Below is the current CadQuery model of a mounting plate (rev A).\n\n```python\n",
    "```\n\n" + changes.HEADER + "\n",
    "\n" + changes.FOOTER + ": four through holes, one per corner, each hole centre at the stated edge margin from its two nearest edges, part centred on the origin.\n\n"
    "Return the complete rev B CadQuery module with the part bound to `result`.",
)


def filled(template: str, values: dict[str, Column]) -> Column:
    """template with each {name} replaced by a text column."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(parts)))


def numbers(prefix: str = "") -> dict[str, Column]:
    """The numbers of a plate by the short names of the templates."""
    v = {short: F.col(f"{prefix}{name}") for short, name in zip("LWTDM", ("length", "width", "thickness", "hole_diameter", "edge_margin"), strict=True)}
    return v | {"PX": v["L"] - 2 * v["M"], "PY": v["W"] - 2 * v["M"], "R": v["D"] / 2}


def prompt(tier: str, held_out: Column) -> Column:
    """The prompt of a spec (with a_* for L4) at a tier; held_out: whether it gets the wordings kept from training."""
    plain = {n: v.cast("string") for n, v in numbers().items()}
    named = {"length": plain["L"], "width": plain["W"], "thickness": plain["T"], "hole_diameter": plain["D"], "edge_margin": plain["M"], "pitch_x": plain["PX"], "pitch_y": plain["PY"], "hole_count": F.col("hole_count").cast("string")}
    table = lambda pattern: filled(REQUIREMENTS.replace("{pattern}", pattern), named)
    if tier == "L0":
        return F.concat(F.lit(FILL[0]), table(PITCHES), F.lit(FILL[1]))
    if tier in ("L1", "L2"):
        return F.concat(F.lit(WRITE[0]), table(PITCHES if tier == "L1" else CORNERS), F.lit(WRITE[1]))
    if tier == "L3":
        short = {n: short_number(v) for n, v in numbers().items()}
        crc = F.crc32(F.col("id").cast("binary"))
        of = lambda wordings: F.coalesce(*(F.when(crc % len(wordings) == i, filled(PROSE[w], short)) for i, w in enumerate(wordings)))
        return F.when(held_out, of(HELD_OUT)).otherwise(of(SEEN))
    old, new = ({f: F.col(f"{p}{f}") for f in changes.FIELDS} for p in ("a_", ""))
    model = filled(MODEL, {n: v.cast("string") for n, v in numbers("a_").items()})
    return F.concat(F.lit(EDIT[0]), model, F.lit(EDIT[1]), changes.order_lines(old, new), F.lit(EDIT[2]))


def tasks(specs: DataFrame, tiers: Sequence[str] = source.TIERS) -> DataFrame:
    """A row per spec (with its split) and tier: question, answer (the spec's id), info (spec_id, tier)."""
    unknown = [t for t in tiers if t not in source.TIERS]
    if unknown:
        raise ValueError(f"unknown tier {unknown[0]!r}; expected one of {source.TIERS}")
    rows = changes.revision_a(specs) if "L4" in tiers else specs
    held_out = F.col("split").isin("eval", "test")
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), prompt(t, held_out).alias("question")) for t in tiers))).alias("t")
    return rows.select("id", each).select(F.col("t.question").alias("question"), F.col("id").alias("answer"), F.struct(F.col("id").alias("spec_id"), F.col("t.tier").alias("tier")).alias("info"))
