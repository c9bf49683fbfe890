import math

from pyspark.sql import functions as F

from plumbline.functions import prompts
from plumbline.operators import compare, geometry


def test_bores(spark):
    wall = lambda d, h: math.pi * d * h
    faces = [("p", 1.0, 2.0, 3.0, wall(6, 4), -4.0, 0.0), ("p", 1.0, 2.0, 3.0, wall(6, 4), 0.0, 4.0), ("p", 5.0, 5.0, 2.0, 0.5 * wall(4, 8), -4.0, 4.0), ("p", 9.0, 9.0, 2.0, 0.1 * wall(4, 8), -4.0, 4.0)]
    rows = geometry.bores(spark.createDataFrame(faces, "part string, cx double, cy double, radius double, area double, z_min double, z_max double")).collect()
    assert {(r.x, r.diameter, r.kind, r.segments) for r in rows} == {(1.0, 6.0, "hole", 1), (5.0, 4.0, "partial", 1)}


def test_off_axis(spark):
    s, wall = math.sqrt(0.5), lambda d, h: math.pi * d * h
    faces = [
        ("p", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 4.0, wall(4, 5), 0.0, 5.0),  # two halves of one bore, seen from both sides
        ("p", -1.0, 0.0, 0.0, 7.0, 0.0, 0.0, 4.0, wall(4, 5), -3.0, 2.0),
        ("p", 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 4.0, wall(4, 5), 0.0, 5.0),  # along Z
        ("p", 0.0, s, s, 0.0, 0.0, 0.0, 2.0, 0.9 * wall(2, 5), 0.0, 5.0),  # a wall that is not whole
    ]
    rows = geometry.off_axis(spark.createDataFrame(faces, "part string, dx double, dy double, dz double, px double, py double, pz double, diameter double, area double, low double, high double")).collect()
    assert [(r.part, r.n) for r in rows] == [("p", 1)]


def test_confusion(spark):
    rows = [(["R1"], ["R1"], []), (["R1"], [], []), ([], ["R1"], []), ([], [], []), (["R1"], [], ["R1"])]
    frame = spark.createDataFrame([("f", "m", "s", *r) for r in rows], "family string, mutant string, spec_id string, truth array<string>, said array<string>, unclear array<string>")
    counts = {r.check: r for r in compare.confusion(frame, "truth", "said", "unclear").collect()}
    assert (counts["R1"].missed, counts["R1"].false_alarms) == (1, 1)


def test_prompts(spark):
    values = {"L": 80.0, "W": 60.5, "T": 8.0, "R": 3.25, "M": 10.0}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))
    template = "Plate (X) {L} by {W} by {T}; bores of radius {R}, {M} from edges?"
    text = row.select(prompts.rendered(template, {k: F.col(k) for k in values}).alias("t"))
    assert text.first().t == "Plate (X) 80 by 60.5 by 8; bores of radius 3.25, 10 from edges?"
    got = text.select(prompts.from_templates(F.col("t"), ["Other {L} {W} {T} {D} {PX} {PY}", template]).alias("x")).first().x
    assert tuple(got) == (80.0, 60.5, 8.0, 6.5, 60.0, 40.5)
    table = "Overall length (X):   80 mm\nOverall width (Y): 60.5 mm\nPlate thickness (Z): 8 mm\n4 off, through, 6.5 mm diameter\nEdge margin: 10 mm"
    frame = spark.createDataFrame([(table,)], "t string")
    assert tuple(frame.select(prompts.from_labels(F.col("t"), True).alias("x")).first().x) == (80.0, 60.5, 8.0, 6.5, 60.0, 40.5)
    assert frame.select(prompts.from_labels(F.col("t"), False).alias("x")).first().x is None


def test_nested_circles(spark):
    import math
    import random

    rng = random.Random(3)
    rows = [(p, i, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice((0.3, 1.0, 2.0, 7.9, 16.0, 60.0)) if p else 1.0) for p in range(3) for i in range(90)]
    rows += [(3, 0, 1.0, 1.0, 2.0), (3, 1, 1.0, 1.0, 2.0), (3, 2, 1.0, 1.0, 3.0), (3, 3, 2.0, 1.0, 2.0), (3, 4, 0.0, 0.0, 0.0), (4, 0, 5.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "part int, hole int, x double, y double, d double").repartition(3)
    want = set()
    for n, (p, i, x, y, d) in enumerate(rows):
        for q, j, u, v, e in rows[n + 1 :]:
            far = math.hypot(x - u, y - v)
            if p == q and min(d, e) > 0 and not (far <= 1e-7 and abs(d - e) <= 1e-9) and far < max(d, e) / 2:
                want.add((p, i, j))
    got = [tuple(r) for r in geometry.nested(df, ["part"], "hole").collect()]
    assert len(got) == len(set(got)) and set(got) == want and (3, 0, 1) not in want and (3, 0, 2) in want


def test_completions(spark):
    import json

    from plumbline.functions import prompts

    cases = {
        '"plain"': "plain", "null": "", "5": "", '{"content": "x"}': "", "[]": "", '[{"content": "a"}, {"content": "b"}]': "a\nb", '[{"content": null}, {"role": "x"}, 7, "s", {"content": ""}]': "",
        json.dumps([{"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"text": 5}, "t", {"text": "b"}]}, {"content": "c"}, {"content": 3}, {"content": {"text": "d"}}]): "a\nb\nc", '"é\\n\u2028"': "é\n\u2028",
    }
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r.j: r.t for r in df.select("j", prompts.completion_text(F.try_parse_json("j")).alias("t")).collect()} == cases
    assert df.limit(1).select(prompts.completion_text(F.try_parse_json(F.lit("{no json"))).alias("t")).first().t == ""
