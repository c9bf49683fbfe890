import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plumbline.functions import numbers
from plumbline.operators import arms, replication, reports, selection, training, validation
from plumbline.sources.runs import Runs


def test_arm_problems(spark):
    schema = "run_id string, arm string, split string, temperature double, feedback_retries int, system_prompt string"
    metas = spark.createDataFrame(
        [("a", "hint", "eval", 0.0, None, "P\nH\n"), ("b", "hint", "eval", 0.0, None, "P"), ("c", "feedback", "eval", 0.0, None, "P"), ("d", "first-shot", "test", None, 1, "P"), ("e", "other", "eval", 0.0, 0, None)], schema
    )
    found = {r.run_id: r.problems for r in arms.arm_problems(metas, {"split": "eval", "temperature": 0.0}, {"first-shot": "P", "hint": "P\nH\n", "feedback": "P"}).collect()}
    assert found["a"] == [] and found["b"] == ["the system prompt is not the arm's"] and found["c"] == ["feedback retries are not the arm's"]
    assert found["d"] == ["split is not eval", "temperature is not 0.0", "feedback retries are not the arm's"] and "the arm is not registered" in found["e"]


def test_predictions(spark):
    def of(model, arm, labels):
        return [(model, arm, "L1", f"s{i}", label) for i, label in enumerate(labels)]

    rows = [
        *of("m", "first-shot", ["api"] * 4 + ["stacked"] * 4 + ["twice"] * 2),
        *of("m", "hint", ["api"] * 2 + ["stacked"] * 2 + ["pass"] * 4 + ["twice"] * 2),  # knowledge 8 to 4 of 10
        *of("m", "feedback", ["api"] * 3 + ["stacked"] * 4 + ["pass"] * 3),  # API errors are not halved, twice falls by 0.2
        *of("n", "first-shot", ["pass"] * 10),
    ]
    outcomes = spark.createDataFrame(rows, "model string, arm string, tier string, spec_id string, label string")
    tested = arms.predictions(outcomes, ["api", "stacked"], "api", "stacked", ["twice"], ["m"], ["m", "n"])
    found = {(r.prediction, r.model, r.arm): r.held for r in tested.collect()}
    assert found == {("P1", "m", "hint"): True, ("P2", "m", "feedback"): False, ("P3", "m", "hint"): True, ("P3", "m", "feedback"): False, ("P3", "n", "hint"): None, ("P3", "n", "feedback"): None}
    assert {r.prediction: r.verdict for r in arms.outlook(tested).collect()} == {"P1": "confirmed", "P2": "not confirmed", "P3": "incomplete"}
    assert arms.side_by_side(outcomes, {"api": ["api"]}).filter("model = 'm'").first().asDict() == {"model": "m", "first-shot_api": 0.4, "hint_api": 0.2, "feedback_api": 0.3}
    row = arms.shift(outcomes, "hint", ["api"], draws=200).first()
    assert row.point == pytest.approx(-0.2) and row.low <= row.point <= row.high


def test_retry_counts(spark):
    error = "execution failed [raised in model code]: ValueError: x"
    rows = [
        ("m", False, {"g": False}, "execution failed: ValueError: x", [Row(error=error)]),
        ("m", True, {"g": True}, None, [Row(error=error)]),
        ("m", False, {"g": False}, "execution failed: TypeError: y", [Row(error=error)]),
        ("m", True, {"g": True}, None, None),
        ("m", True, {"g": True}, None, []),
    ]
    df = spark.createDataFrame(rows, "model string, built boolean, checks map<string,boolean>, error string, attempts array<struct<error:string>>")
    assert arms.retry_counts(df).first() == ("m", 3, 1, 1, 1)


def test_labelled_refuses_missing_labels(spark):
    answers = spark.createDataFrame([("r", "L1", "s", 0, {"g": False}), ("r", "L1", "t", 0, {"g": True})], "run_id string, tier string, spec_id string, rollout int, checks map<string,boolean>")
    labels = spark.createDataFrame([("r", "L1", "s", 0, "API")], "run_id string, tier string, spec_id string, rollout int, label string")
    assert {r.spec_id: r.label for r in arms.labelled(answers, labels).collect()} == {"s": "API", "t": "pass"}
    with pytest.raises(selection.Refused):
        arms.labelled(answers, labels.filter("false"))


def pairs_of(spark, differences):
    return spark.createDataFrame([(t, f"s{i:02d}", d) for i, row in enumerate(differences) for t, d in zip(("L2", "L4"), row, strict=True)], "tier string, spec_id string, difference int")


def test_consistency_by_pythons_generator(spark):
    a, b = [[1, 0], [0, 0], [-1, 1], [1, 1]], [[1, 1], [1, 0], [1, 1]]
    row = replication.consistency(pairs_of(spark, a), pairs_of(spark, b).repartition(3), draws=400, seed=5).first()
    rng, draws = random.Random(5), []
    for _ in range(400):
        one = [sum(a[rng.randrange(4)]) for _ in a]
        two = [sum(b[rng.randrange(3)]) for _ in b]
        draws.append(sum(two) / 6 - sum(one) / 8)
    draws.sort()
    assert (row.original_gain, row.replication_gain) == (3 / 8, 5 / 6) and (row.low, row.high) == pytest.approx((draws[10], draws[389]))
    assert row.verdict == ("larger" if row.low > 0 else "consistent")


def test_pooled_and_verdicts(spark):
    rows = [("L2", "s1", 1), ("L4", "s1", 1), ("L2", "s2", 1), ("L4", "s2", 0), ("L1", "s3", 1)]
    df = spark.createDataFrame(rows, "tier string, spec_id string, passed int")
    found = {r.experiment: (r.passes, r.specs, r.lower) for r in replication.pooled({"a": df, "b": df.filter("spec_id = 's1'")}).collect()}
    assert found["a"][:2] == (1, 2) and found["b"][:2] == (1, 1) and found["pooled"][:2] == (2, 3)
    assert found["b"][2] == pytest.approx(replication.all_pass_bound(1)) and replication.sign_flip_p(3) == 0.125
    gains = spark.createDataFrame([(1, 0.2, 0.1), (2, 0.05, 0.01), (3, 0.2, -0.1)], "i int, point double, low double")
    assert [r.verdict for r in replication.verdict(gains).orderBy("i").collect()] == ["replicated", "smaller than worthwhile", "not replicated"]
    drops = replication.regressions(pairs_of(spark, [[-1, 0], [0, 0]])).collect()
    assert {r.tier: r.regression for r in drops} == {"L2": True, "L4": False}
    assert {(r.n, r.clusters) for r in replication.counts_of_counts(df, "spec_id").collect()} == {(2, 2), (1, 1)}
    prompts = spark.createDataFrame([("a",), ("a",), (None,)], "system_prompt_sha256 string")
    assert replication.same_prompt(prompts.filter("system_prompt_sha256 is not null")).first().agree and not replication.same_prompt(prompts).first().agree


def test_eligible_targets(spark):
    def holes(px, py, d=5.0):
        return [Row(x=sx * px / 2, y=sy * py / 2, diameter=d) for sx in (-1, 1) for sy in (-1, 1)]

    volume = 60 * 40 * 5 - 3.141592653589793 * 25 * 5
    parts = [("fits", 60.0, 40.0, 5.0, volume, holes(44, 24)), ("three", 60.0, 40.0, 5.0, volume, holes(44, 24)[:3]), ("bores", 60.0, 40.0, 5.0, volume, holes(44, 24, 5.3))]
    specs = [("same", 60.0, 40.0, 5.0, 5.0, 44.0, 24.0, 8.0), ("near", 60.5, 40.0, 5.0, 5.0, 44.5, 24.0, 8.0), ("long", 60.6, 40.0, 5.0, 5.0, 44.0, 24.0, 8.0), ("pitch", 60.0, 40.0, 5.0, 5.0, 47.0, 24.0, 8.0)]
    p = spark.createDataFrame(parts, "part string, length double, width double, thickness double, volume double, holes array<struct<x:double,y:double,diameter:double>>")
    s = spark.createDataFrame(specs, "spec string, length double, width double, thickness double, hole_diameter double, pitch_x double, pitch_y double, edge_margin double")
    assert {(r.part, r.spec) for r in validation.eligible(p, s).collect()} == {("fits", "same"), ("fits", "near")}


def test_sensitivity_counts_checks(spark):
    df = spark.createDataFrame([("d", 0.5, ["R4"]), ("d", 1.0, []), ("d", 0.0, ["R4", "R5"])], "kind string, reward double, failed array<string>")
    row = validation.sensitivity(df, ["kind"], F.col("reward"), F.lit("R5"), "failed").first()
    assert (row.n, row.caught, row.expected_failed, row.failed) == (3, 2, 1, {"R4": 2, "R5": 1})
    assert validation.sensitivity(df.filter("reward = 1"), ["kind"], F.col("reward"), F.lit("R5"), "failed").first().failed == {}


def test_pruned(spark):
    rows = [
        (1, [True, True], [0.0, 1.0], None, None, None),  # one of two goes
        (2, [True, False], [0.0, 0.0], None, None, None),  # nothing left
        (3, [True], [0.0], None, [0.5], None),  # another loss stays
        (4, [False], [0.0], [0.0], None, None),  # nothing changes
        (5, [True], None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "i int, mask array<boolean>, advantages array<double>, rl_weights array<double>, ce_weights array<double>, ref_kl_weights array<double>")
    found = {r.i: (r.rl_weights, r.trainable) for r in training.pruned(df).collect()}
    assert found == {1: ([0.0, 1.0], True), 2: ([0.0, 0.0], False), 3: ([0.0], True), 4: ([0.0], True), 5: (None, True)}


def test_gate_pools_and_mix(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (None,)], "a double")
    assert training.admitted(df, "a").count() == 2
    with pytest.raises(ValueError):
        training.admitted(df, "a", 1.0, 0.0)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0.1).when(F.col("id") % 3 == 1, 0.5).otherwise(1.0).alias("reward"))
    found = {r["pool"]: r["count"] for r in training.weighted(rows, "reward", 140, F.col("id"), 1).groupBy("pool").count().collect()}
    assert found == {"hard": 20, "normal": 100, "easy": 20}
    ids = lambda df: sorted(r.id for r in training.weighted(df, "reward", 140, F.col("id"), 1).collect())
    assert ids(rows) == ids(rows.repartition(5))
    assert training.weighted(rows.filter("reward > 5"), "reward", 9, F.col("id"), 1).isEmpty()


def test_warnings_and_discards(spark):
    units = spark.createDataFrame([("r", i, s) for i, s in enumerate([4, 7, 1, 25, 2])], "run string, i int, size int")
    assert [(r.i, r.total, r.windows) for r in training.zero_output_warnings(units, ["run"], ["i"], "size", 10).orderBy("i").collect()] == [(1, 11, 1), (3, 37, 3)]
    episodes = spark.createDataFrame([(1, "a", False, False), (1, "b", True, True), (1, "c", False, True), (1, "d", False, False), (1, "e", None, None)], "step int, episode_id string, cancelled boolean, failed boolean")
    of = lambda *ids: spark.createDataFrame([(1, i) for i in ids], "step int, episode_id string")
    others = spark.createDataFrame([(1, 2, 3, 1), (2, 1, 0, 0)], "step int, failures long, cancelled_attempts long, stale_attempts long")
    found = {r.step: tuple(r)[1:] for r in training.discards(episodes, of("a"), of("e"), others, ["step"]).collect()}
    assert found == {1: (10, 8, 2, 3, 3), 2: (1, 1, 0, 1, 0)}


def test_steps(spark, tmp_path):
    steps = spark.createDataFrame([("r", 1, 5), ("r", 2, 4)], "run string, step int, trained long")
    bins = spark.createDataFrame([("r", 1, [2, 0, 3])], "run string, step int, counts array<long>")
    found = {r.step: (r.distribution, r.trained_zero_rewards, r.trained_one_rewards) for r in training.with_histograms(steps, bins).collect()}
    assert found == {1: ("ok", 2, 3), 2: ("missing", None, None)}
    with pytest.raises(Exception, match="bins and answers differ"):
        training.with_histograms(steps.withColumn("trained", F.lit(6)), bins).collect()
    path = str(tmp_path / "steps")
    training.write_steps(steps, path)
    assert sorted(training.read_steps(spark, path, "run string, step int, trained long").collect()) == sorted(steps.collect())
    with pytest.raises(Exception, match="exist"):
        training.write_steps(steps, path)


def test_screening(spark):
    answers = spark.createDataFrame([("a", "L4", "s", 1, 1.0), ("a", "L4", "s", 0, 0.9), ("a", "L4", "t", 0, None)], "run_id string, tier string, spec_id string, rollout int, reward double")
    metas = spark.createDataFrame([("a",)], "run_id string")
    ends = spark.createDataFrame([("a", "complete")], "run_id string, status string")
    groups = training.screening(Runs(metas, answers, ends))
    assert {r.spec_id: r.flags for r in groups.collect()} == {"s": [0, 1], "t": [0]}
    with pytest.raises(selection.Refused):
        training.screening(Runs(metas, answers, ends.filter("false")))
    row = training.predicted_interval(groups, ["tier"], "flags", "spec_id", 3, 7, 100).first()
    rng = random.Random(7)
    sims = sorted(sum([0.5, 0.0][rng.randrange(2)] for _ in range(3)) / 3 for _ in range(100))
    assert (row.low, row.high) == (sims[2], sims[96])


def test_reports(spark):
    answers = spark.createDataFrame([(0.5, "x"), (None, "x"), (0.5004, "y" * 300), (1.0, "")], "reward double, error string")
    assert tuple(reports.spread(answers).first())[0::1][2:] == (0.0, 1.0, 1, 3)
    assert [(r.error, r.n) for r in reports.common_errors(answers).collect()] == [("x", 2), ("y" * 200, 1)]
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    two = spark.createDataFrame([(2, None), (3, "d")], "id int, v string")
    assert {r.id: r.v for r in reports.later_wins([one, two], ["id"]).collect()} == {1: "a", 2: None, 3: "d"}
    models = spark.createDataFrame([("m", 1), ("ref", 0), (None, 1)], "model string, failed int")
    kept, programs = reports.without_programs(models, "model", ["ref"])
    assert kept.count() == 2 and programs.count() == 1
    assert [r.model for r in reports.by_failure_share(models, F.col("failed") == 1).collect()][-1] == "ref"
    priced = spark.createDataFrame([("b", 1.0, 0.0), ("a", 1.0, 0.0), ("c", 9.0, 0.0)], "model string, input_price double, output_price double")
    assert [r.model for r in reports.cheapest(priced, 2, 3.0, F.lit(1), 2)  .collect()] == ["a", "b"]
    assert reports.cheapest(priced, 2, 3.0, F.lit(1), 9, most=6.0).count() == 2


def test_extents(spark):
    def part(name, holes):
        return name, -10.0, 10.0, -5.0, 5.0, [Row(x=float(x), y=float(y)) for x, y in holes]

    df = spark.createDataFrame([part("grid", [(-7, -3), (-7, 3), (7, -3), (7, 3)]), part("line", [(-7, 0), (7, 0), (0, 0), (6, 1)]), part("none", [])], "part string, x_min double, x_max double, y_min double, y_max double, holes array<struct<x:double,y:double>>")
    found = {r.part: tuple(r)[1:] for r in reports.extents(df).collect()}
    assert found["grid"] == (3.0, 2.0, 14.0, 6.0, True, True)
    assert found["line"][4:] == (False, False) and found["none"] == (None, None, None, None, False, False)


def test_numbers(spark):
    values = [2.675, 5e-5, 0.125, -2.5, 1e300]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    assert [r.y for r in df.select(numbers.python_round(F.col("x"), 2).alias("y")).collect()] == [*(round(v, 2) for v in values), None]
    grid = [1.2, 1.25, 1.75, 0.1, 7.0]
    df = spark.createDataFrame([(v,) for v in grid], "x double")
    assert [r.y for r in df.select(numbers.snapped(F.col("x")).alias("y")).collect()] == [max(0.5, round(v * 2) / 2) for v in grid]
    row = spark.sql("select timestamp'2026-01-02 03:04:05' as t").select(numbers.run_id(F.col("t")).alias("i"), numbers.iso(F.col("t")).alias("s"), numbers.seconds_between(F.lit("2026-01-02T03:04:00+00:00"), F.lit("2026-01-02T03:04:05.5+00:00")).alias("d")).first()
    assert row == ("20260102T030405Z", "2026-01-02T03:04:05+00:00", 5.5)


def test_replication_conformity(spark):
    schema = "run_id string, split string, replication_split struct<sha256:string>, feedback_retries int, package_version string"
    metas = spark.createDataFrame([("a", "replication", Row(sha256="f"), None, "1"), ("b", "replication", Row(sha256="g"), None, "2")], schema)
    rows = [(r, t, s, None, "m", "stop") for r, specs in (("a", ("s1", "s2")), ("b", ("s1", "s3"))) for t in ("L2", "L4") for s in specs]
    answers = spark.createDataFrame(rows, "run_id string, tier string, spec_id string, api_error string, served_model string, finish_reason string")
    ends = spark.createDataFrame([("a", "complete"), ("b", "complete")], "run_id string, status string")
    expected = {"split": "replication", "split_sha256": "f", "n_specs": 2, "tiers": ("L2", "L4")}
    found = {r.run_id: r.problems for r in replication.conformity(metas, answers, ends, expected, ["s2", "s1"], package_version="1").collect()}
    assert found["a"] == []
    assert found["b"] == ["not the locked split with the registered fingerprint", "the spec ids are not exactly those of the split", "package_version is not 1"]
