import hashlib
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import classify, costs
from plumbline.streaming import groups


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_code_of(spark):
    assert one(spark, "a ```python\n  x = 1\n    y\n``` b ```\nz\n```", text.code_of) == "x = 1\n  y"
    assert one(spark, "no fence", text.code_of) == "no fence"


@pytest.mark.parametrize(("value", "loops"), [("ab" * 800, True), ("word " * 3, False), (" " * 900 + "x" * 20, True), ("\n".join(["same line here"] * 40), True), (" ".join(map(str, range(600))), False)])
def test_degenerate(spark, value, loops):
    assert one(spark, value, text.degenerate) is loops


def test_numbers(spark):
    assert one(spark, "width: 12.5 mm", lambda t: text.number_after(t, "width")) == 12.5
    assert one(spark, "none", lambda t: text.number_after(t, "width")) is None
    assert [one(spark, v, lambda t: text.short_number(t.cast("double"))) for v in ("80.0", "6.5")] == ["80", "6.5"]


def test_labels(spark):
    kind = lambda e: one(spark, e, classify.api_kind)
    assert kind("AttributeError: 'Workplane' object has no attribute 'foo'") == "no such method: Workplane.foo"
    assert kind("TypeError: Workplane.__init__() got an unexpected keyword") == "wrong arguments to __init__()"
    assert kind("DispatchError: ('rect: 0 methods found', (<class 'cadquery.cq.Workplane'>") == "no matching signature for Workplane.rect()"
    assert kind("execution failed [raised in cadquery: Workplane.hole]: ValueError: x") == "ValueError in Workplane.hole()"
    label = lambda e: one(spark, e, classify.unbuilt_label)
    assert label("SyntaxError: invalid syntax") == "syntax error"
    assert label("execution failed: Standard_Failure") == "geometry kernel failure"
    assert label("execution failed [raised in cadquery: Workplane.hole]: ValueError: x") == "CadQuery API error"
    assert label("execution failed [raised in model code]: KeyError: 1") == "Python error in model code"
    assert [label(e) for e in ("", "the answer did not define a part", "execution failed: KeyError", "ran out of its execution budget")] == ["no part produced", "no part produced", "build failed", "timeout"]
    df = spark.createDataFrame([({"gate:single_solid": True, "R2:width": False, "R8:z_datum": False},), ({},)], "c map<string,boolean>")
    assert [r.x for r in df.select(classify.check_label(F.col("c")).alias("x")).collect()] == ["wrong plate size", "other"]
    assert one(spark, "off Z datum", classify.group_of) == "one dimension wrong"


def corners(x, y, dx=0.0, dy=0.0):
    return [(sx * x / 2 + dx, sy * y / 2 + dy) for sx in (-1, 1) for sy in (-1, 1)]


@pytest.mark.parametrize(
    ("points", "code", "off_axis", "label"),
    [
        (corners(80, 40), "", 0, None),
        (corners(80, 40, 40, 20), "", 0, "pattern anchored at a corner"),
        (corners(60, 20), "", 0, "margin applied twice"),
        (corners(40, 80), "", 0, "X and Y swapped"),
        (corners(160, 40), "", 0, "pitch read as coordinates"),
        (corners(80, 40)[:3] + [(0.0, 0.0)], "", 0, "some holes right, some wrong"),
        (corners(80, 33), "", 0, "one axis misplaced"),
        (corners(71, 33), "", 0, "holes misplaced (other)"),
        ([(0.0, 0.0)] * 4, "w.rect(1, 2).hole(6)", 0, "holes stacked at one point"),
        ([(0.0, 0.0)], "pushPoints([(0, 0), (80, 0)])", 0, "pattern anchored at a corner"),
        ([(9.0, 9.0)], "w.hole(6).hole(6)", 0, "holes stacked at one point"),
        ([], "", 0, "no holes"),
        ([], "w.pushPoints(p).hole(6)", 4, "holes drilled along the wrong axis"),
    ],
)
def test_pattern_labels(spark, points, code, off_axis, label):
    frame = spark.createDataFrame([(points, code, off_axis)], "p array<struct<x:double,y:double>>, c string, o int")
    got = frame.select(classify.pattern_label(F.col("p"), F.lit(80.0), F.lit(40.0), F.lit(10.0), F.col("c"), F.col("o")).alias("x"))
    assert got.first().x == label


def test_change_and_failure_labels(spark):
    spec = "length double, width double, thickness double, hole_diameter double, edge_margin double"
    schema = ", ".join(["m struct<length:double,width:double,thickness:double,holes:array<struct<diameter:double>>>", "p array<struct<x:double,y:double>>", "r array<array<double>>", spec, *(f"a_{c}" for c in spec.split(", "))])
    new, old = (120.0, 60.0, 8.0, 6.0, 10.0), (100.0, 60.0, 8.0, 6.0, 10.0)
    rows = [
        ((100.0, 60.0, 8.0, [(6.0,)]), corners(80, 40), None, *new, *old),
        ((120.0, 60.0, 8.0, [(6.0,)]), corners(80, 40), None, *new, *old),
        ((120.0, 60.0, 8.0, []), [], [[80.0, 40.0]], *new, *old),
        ((120.0, 60.0, 8.0, [(6.0,)]), corners(100, 40), None, *new, *old),
    ]
    got = spark.createDataFrame(rows, schema).select(classify.change_label("m", F.col("p"), F.col("r")).alias("x")).collect()
    assert [r.x for r in got] == ["change order ignored", "change not propagated to pitch", "change not propagated to pitch", None]
    fields = "api_error string, truncated boolean, degenerate boolean, built boolean, error string, timeout boolean, measured boolean, tier string, checks map<string,boolean>"
    rows = [("x", None, None, None, None, None, None, "L1", {}), (None, True, True, None, None, None, None, "L1", {}), (None, True, False, None, None, None, None, "L1", {}), (None, False, False, False, "", True, None, "L1", {}), (None, False, False, True, None, False, True, "L1", {"R6:material": False})]
    frame = spark.createDataFrame(rows, fields)
    got = frame.select(classify.failure_label({c: F.col(c) for c in frame.columns}, F.lit(None).cast("string")).alias("x")).collect()
    assert [r.x for r in got] == ["API error", "degenerate loop", "cut off", "timeout", "material off"]


def test_costs(spark):
    rows = spark.createDataFrame([("r", 1, 10, 4, 0.5, 0.5, 0.4, 100.0, 50.0)], "run string, step int, generated int, trained int, e_share double, e_trained_share double, e_solved_rate double, e_input_mean double, e_output_mean double")
    row = costs.steps(rows, ["e"]).first()
    assert (row.e_generated, row.e_trained, row.e_solved, row.e_failed, row.e_discard_input) == (5, 2, 2, 3, 300.0)
    with pytest.raises(Exception, match="no whole number"):
        costs.steps(rows.withColumn("e_share", F.lit(0.55)), ["e"]).collect()


def test_overlapping_phases(spark):
    rows = spark.createDataFrame([(i, 1.0, float(i), 2) for i in range(1, 7)], "step int, cost double, rate double, n int")
    bounds = spark.createDataFrame([("early", 1, 3), ("all", 1, 6)], "phase string, lo int, hi int")
    got = {r.phase: (r.steps, r.cost, r.rate) for r in costs.phases(rows, bounds, ["cost"], {"rate": "n"}, []).collect()}
    assert got == {"early": (3, 3.0, 2.0), "all": (6, 6.0, 3.5)}


def test_stream_assembles_groups(spark, tmp_path):
    schema = "group_id long, member long, status string, reward double, version long"
    rows = [(1, m, "arrived", float(m % 2), 5) for m in range(4)] + [(2, m, "arrived", 1.0, 5) for m in range(4)] + [(3, m, "arrived", float(m % 2), 1) for m in range(4)] + [(4, 0, "arrived", 1.0, 5)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = groups.replayed(spark, groups.assemble(stream, 4, newest=6, bound=2), "assembled")
    got = {r.group_id: (r.failed, r.kept, len(r.rewards)) for r in done.collect()}
    assert got == {1: (0, True, 4), 2: (0, False, 4), 3: (4, False, 0)}
    assert groups.batches(done, 4).count() == 1


WHOLE = [
    "a ```python\n  x = 1\n\ty\n``` b", "```\n\tif a:\n\t\tb\n \t \n\tc\n```", "\t one\n\t  two\n\n\t three", "  a\n b", "\u3000 é\u00a0x\u2028", "Żaden_Error: zły\u200bznak\x07 😀\x1f",
    "TypeError: no", "```\nshort\n``` ```python \r\n    longer block\n      here\n```", "", "   \n\t\n", "\u00a0\ttab",
]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(WHOLE)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_fenced_extract_of_every_document(spark, whole):
    from plumbline.plans import texts

    def code(t):
        return textwrap.dedent(max(re.findall(r"```(?:python)?[ \t]*\r?\n(.*?)```", t, re.S) or [t], key=len)).strip()

    got = {r.doc_id: r.code for r in texts.fenced_extract(spark, whole).collect()}
    assert got == {i: hashlib.sha256(code(t).encode()).hexdigest() for i, t in enumerate(WHOLE)}


def test_normalise_error_of_every_document(spark, whole):
    from plumbline.plans import texts

    got = {r.doc_id: (r.cleaned, r.core) for r in texts.normalise_error(spark, whole).collect()}
    assert got == {i: ("".join(c if c.isprintable() else " " for c in t)[:300], re.sub(r"^\w*(?:Error|Exception): ?", "", t)[:80]) for i, t in enumerate(WHOLE)}
