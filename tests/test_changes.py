"""Change orders: published revisions, and reading them back against plain Python."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import changes
from plumbline.sources import specs as source

MODEL = "```python\nresult = (\n    .box({L}, {W}, {T})\n    .rect({X}, {Y}, forConstruction=True)\n    .hole({D})\n)\n```\n\n"


def prompt(lines, L=100.0, W=60.0, T=8.0, D=6.5, M=10.0, Y=None, head=changes.HEADER, foot=changes.FOOTER + ": four holes."):
    return "Below is rev A.\n\n" + MODEL.format(L=L, W=W, T=T, D=D, X=L - 2 * M, Y=Y or W - 2 * M) + f"{head}\n" + "\n".join(lines) + f"\n{foot}\n"


def test_published_revisions(spark):
    """Four published orders: (revision A) -> (what it becomes): length, width, thickness, hole, margin."""
    published = [
        ((202.5, 148.5, 10.0, 10.5, 13.0), (202.5, 129.0, 10.0, 10.5, 13.0)),
        ((53.0, 47.0, 7.5, 5.0, 18.5), (48.0, 47.0, 7.5, 5.0, 18.5)),
        ((49.5, 36.0, 6.5, 7.5, 7.0), (43.0, 36.0, 6.5, 8.5, 7.0)),
        ((138.5, 116.5, None, 12.0, 23.5), (115.5, 145.5, None, 12.0, 23.5)),
    ]
    specs = source.sample(spark, 230, source.SAMPLE_SEED).unionByName(source.locked_split(spark).drop("split"))
    rows = changes.revision_a(specs).collect()
    by_target = {tuple(r[f] for f in changes.FIELDS): tuple(r[f"a_{f}"] for f in changes.FIELDS) for r in rows}
    assert len(rows) == 290
    hits = 0
    for before, after in published:
        found = [(t, a) for t, a in by_target.items() if all(x is None or x == y for x, y in zip(after, t, strict=True))]
        hits += any(all(x is None or x == y for x, y in zip(before, a, strict=True)) for _, a in found)
    assert hits == 4


def test_orders_are_read_back(spark):
    specs = source.sample(spark, 40, source.SAMPLE_SEED)
    rows = changes.revision_a(specs)
    old, new = ({f: F.col(f"{p}{f}") for f in changes.FIELDS} for p in ("a_", ""))
    n = lambda c: F.col(c).cast("string")
    pitch = lambda c: (F.col(f"a_{c}") - 2 * F.col("a_edge_margin")).cast("string")
    text = F.concat(F.lit("```python\n.box("), n("a_length"), F.lit(", "), n("a_width"), F.lit(", "), n("a_thickness"), F.lit(").rect("), pitch("length"), F.lit(", "), pitch("width"), F.lit(", forConstruction=True).hole("), n("a_hole_diameter"), F.lit(f")\n```\n{changes.HEADER}\n"), changes.order_lines(old, new), F.lit(f"\n{changes.FOOTER}"))
    read = rows.withColumn("r", changes.read_order(text)).collect()
    for r in read:
        assert r.r.failure is None and (r.r.L, r.r.W, r.r["T"], r.r.D) == pytest.approx((r.length, r.width, r.thickness, r.hole_diameter))
        assert (r.r.PX, r.r.PY) == pytest.approx((r.length - 2 * r.edge_margin, r.width - 2 * r.edge_margin))


def test_failures(spark):
    line = "  - change {} from {} mm to {} mm".format
    cases = [
        (prompt([line("overall length (X)", 100, 90)]), None),
        (prompt([line("overall length (X)", 100, 90), line("overall length (X)", 90, 95)]), None),
        (prompt([line("hole diameter", 7, 8)]), "hole diameter is 6.5 mm before this change, not 7 mm"),
        (prompt([line("overall length (X)", 100, 90), line("overall length (X)", 100, 80)]), "overall length (X) is 90 mm before this change, not 100 mm"),
        (prompt(["  - change colour from 1 mm to 2 mm"]), "unrecognised change line '- change colour from 1 mm to 2 mm'"),
        (prompt([]), "the change order lists no change"),
        (prompt([line("hole diameter", 6.5, 8)], foot="the end"), "the change order has no end"),
        (prompt([line("hole diameter", 6.5, 8)], Y=30.0), "rev A edge margin differs between X (10) and Y (15)"),
        (prompt([line("hole diameter", 6.5, 8)]).replace(".hole(6.5)", ""), "expected one .hole() call in rev A, found 0"),
        (prompt([line("hole diameter", 6.5, 8)]).replace(".hole(6.5)", ".hole(6.5).hole(6.5)"), "expected one .hole() call in rev A, found 2"),
        (changes.HEADER + "\n" + changes.FOOTER, "no rev A code block"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.r for r in df.select("i", changes.read_order(F.col("t")).alias("r")).collect()}
    assert [got[i].failure for i in range(len(cases))] == [why for _, why in cases]
    assert (got[1].L, got[1].PX, got[1].PY) == (95.0, 75.0, 40.0) and got[2].L is None
