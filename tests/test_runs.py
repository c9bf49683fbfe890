import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import compare, leaderboard
from plumbline.operators.selection import Refused
from plumbline.sources import runs as source
from plumbline.sources import specs as spec_source

SPECS = [f"s{i:02d}" for i in range(6)]


def write_run(folder, run_id, model, passes, tiers=("L1", "L2", "L3", "L4"), status="complete", specs=SPECS, name=None, planned=None, **meta):
    lines = [{"meta": {"run_id": run_id, "model": model, "max_tokens": 100, "rollouts": 1, "planned": {"tiers": list(tiers), "spec_ids": planned or specs, "rollouts": 1, "total": len(tiers) * len(specs)}, **meta}}]
    for t in tiers:
        for s in specs:
            ok = passes(t, s)
            lines.append({"tier": t, "spec_id": s, "rollout": 0, "reward": 1.0 if ok else 0.5, "built": True, "checks": {"gate:single_solid": True, "R1:length": ok}, "completion": "x" * 10, "usage": {"completion_tokens": 5}})
    if status:
        lines.append({"end": {"status": status, "written": len(lines) - 1}})
    (folder / f"{name or run_id}.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")


def test_ranking(spark, tmp_path):
    write_run(tmp_path, "1", "good", lambda t, s: True)
    write_run(tmp_path, "2", "half", lambda t, s: t in ("L1", "L2"))
    write_run(tmp_path, "3", "half", lambda t, s: True, status=None)  # newer, but unfinished
    write_run(tmp_path, "4", "stray", lambda t, s: True, specs=[*SPECS[:-1], "other"])
    runs = source.scan(spark, str(tmp_path))
    chosen = {(r.label, r.tier): (r.run_id, r.superseded) for r in leaderboard.selected(runs).collect()}
    assert chosen["half", "L1"] == ("2", 1) and chosen["good", "L3"] == ("1", 0)
    expected = spark.createDataFrame([(s,) for s in SPECS], "spec_id string")
    rows = {r.model: r for r in leaderboard.ranking(runs, expected, draws=50).collect()}
    assert (rows["good"].headline, rows["good"]["rank"]) == (1.0, 1)
    assert (rows["half"].headline, rows["half"]["rank"]) == (0.5, 2)
    assert rows["stray"].headline is None and rows["stray"]["rank"] is None


def test_summary_of_checks_and_gates(spark, tmp_path):
    gate, length, width = "gate:single_solid", "R1:length", "R2:width"
    meta = {"meta": {"run_id": "r", "model": "m", "max_tokens": 100}}
    rows = [
        answer("a", built=True, checks={gate: True, length: True}, cost_usd=0.5, usage={"completion_tokens": 5}), answer("b", built=True, checks={gate: False}, usage={"completion_tokens": 5}, api_error="", reward=0.0),
        answer("c", built=False, checks={}, api_error="late", reward=0.0), answer("d", built=True, checks={length: True}, cost_usd=0.25),
    ]
    write_lines(tmp_path / "r.jsonl", meta, *rows)
    row = leaderboard.summary(source.scan(spark, str(tmp_path))).first()
    assert row.per_check[length] == 0.5 and row.per_check[width] is None and row.per_gate_fail == {g: (1 / 3 if g == gate else 0.0) for g in leaderboard.GATES}
    assert (row.api_errors, row.unknown_cost, row.cost_usd, row.n, row.specs) == (1, 1, 0.75, 4, 4)


def test_duplicate_run_is_refused(spark, tmp_path):
    write_run(tmp_path, "1", "m", lambda t, s: True)
    write_run(tmp_path, "1", "m", lambda t, s: True, name="copy")
    with pytest.raises(Refused):
        source.scan(spark, str(tmp_path))


def write_lines(path, *records):
    path.write_text("\n".join(map(json.dumps, records)) + "\n")


def answer(spec, **more):
    return {"tier": "L1", "spec_id": spec, "rollout": 0, "reward": 1.0, **more}


def test_last_metadata_and_end_win(spark, tmp_path):
    """A file that was begun twice is one run: nothing is doubled, and the order of lines decides."""
    meta = lambda run, tokens: {"meta": {"run_id": run, "model": "m", "max_tokens": tokens}}
    end = lambda status: {"end": {"status": status}}
    write_lines(tmp_path / "a.jsonl", meta("r", 5), end("stopped"), answer("x"), meta("r", 9), answer("y"), end("complete"))
    write_lines(tmp_path / "b.jsonl", meta("s", 5), answer("x"), end("complete"), end("budget"))
    runs = source.scan(spark, str(tmp_path), last=True)
    assert sorted((r.run_id, r.max_tokens) for r in runs.metas.collect()) == [("r", 9), ("s", 5)]
    assert sorted((r.run_id, r.spec_id, r.run_max_tokens) for r in runs.answers.collect()) == [("r", "x", 9), ("r", "y", 9), ("s", "x", 5)]
    assert {r.run_id: r.status for r in runs.ends.collect()} == {"r": "complete", "s": "budget"}
    with pytest.raises(Refused):
        source.scan(spark, str(tmp_path))


def test_several_runs_in_a_file(spark, tmp_path):
    meta = lambda run, tokens: {"meta": {"run_id": run, "model": "m", "max_tokens": tokens}}
    write_lines(tmp_path / "a.jsonl", {"end": {"status": "lost"}}, meta("r", 5), answer("x"), answer("z", run_id="s"), {"end": {"status": "complete"}}, meta("s", 9), answer("y"), answer("w", run_id="r"))
    runs = source.scan(spark, str(tmp_path))
    assert sorted((r.run_id, r.spec_id, r.run_max_tokens) for r in runs.answers.collect()) == [("r", "w", 5), ("r", "x", 5), ("s", "y", 9), ("s", "z", 9)]
    assert {r.run_id: r.status for r in runs.ends.collect()} == {"r": "complete"}


def test_long_files_keep_their_order(spark, tmp_path):
    """Many blocks of one file: the last end is that of the last line."""
    records = [{"meta": {"run_id": "r", "model": "m", "max_tokens": 5}}]
    for n in range(3000):
        records += [answer(f"s{n}", completion="x" * 200), {"end": {"status": f"at {n:04d}"}}]
    write_lines(tmp_path / "a.jsonl", *records)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        runs = source.scan(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert [r.status for r in runs.ends.collect()] == ["at 2999"] and runs.answers.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_runs(spark, tmp_path):
    meta = {"run_id": "r", "model": "m", "max_tokens": 5, "rollouts": 1, "planned": {"tiers": ["L1"], "spec_ids": ["a", "b"], "rollouts": 1, "total": 2}}
    rows = spark.createDataFrame([("r", "L1", "a", 0, 1.0, True, None, 0.25, True), ("r", "L1", "b", 0, 0.5, True, "TimeoutError: x", None, False)], "run_id string, tier string, spec_id string, rollout int, reward double, built boolean, api_error string, cost_usd double, truncated boolean").repartition(2)
    path = f"{tmp_path}/runs/r.jsonl"
    source.write_run(meta, rows, path)
    runs = source.scan(spark, f"{tmp_path}/runs")
    assert {r.spec_id: (r.run_id, r.reward, r.api_error) for r in runs.answers.collect()} == {"a": ("r", 1.0, None), "b": ("r", 0.5, "TimeoutError: x")}
    end = runs.ends.first()
    assert (end.status, end.written, end.spent_usd, end.unknown_cost_calls, end.truncated) == ("complete", 2, 0.25, 1, 1)
    assert [r.problems for r in leaderboard.completeness(runs).collect()] == [[]]
    with pytest.raises(Exception, match="exists"):
        source.write_run(meta, rows, path)
    assert source.scan(spark, f"{tmp_path}/runs").ends.first().status == "complete"
    # A job that fails leaves no answers and says so; a killed driver leaves no end.
    bad = rows.withColumn("reward", F.when(F.col("spec_id") == "b", F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("reward")))
    with pytest.raises(Exception, match="broken"):
        source.write_run({**meta, "run_id": "q"}, bad, f"{tmp_path}/failed/q.jsonl")
    failed = source.scan(spark, f"{tmp_path}/failed")
    assert failed.ends.first().status == "interrupted" and failed.answers.count() == 0
    (tmp_path / "runs/r.jsonl/part=end").rename(tmp_path / "gone")
    killed = source.scan(spark, f"{tmp_path}/runs")
    assert [r.problems for r in leaderboard.completeness(killed).collect()] == [["interrupted or still running"]]


def test_presence_is_not_null(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(
        "\n".join(
            map(
                json.dumps,
                [
                    {"meta": {"run_id": "r", "model": "m", "max_tokens": 10}},
                    {"tier": "L1", "spec_id": "a", "reward": 0.0, "usage": {"completion_tokens": 10}, "completion": "ab" * 800},
                    {"tier": "L1", "spec_id": "b", "reward": 0.0, "usage": {"completion_tokens": 10}, "finish_reason": None, "truncated": False, "completion": "x"},
                ],
            )
        )
    )
    rows = {r.spec_id: r for r in source.scan(spark, str(tmp_path)).answers.collect()}
    assert (rows["a"].truncated, rows["a"].is_loop, rows["b"].truncated, rows["b"].rollout) == (True, True, False, 0)


def arms(spark, tmp_path, gain):
    (tmp_path / "b").mkdir()
    (tmp_path / "a").mkdir()
    many = [f"s{i:02d}" for i in range(20)]
    write_run(tmp_path / "b", "1", "base", lambda t, s: int(s[1:]) < 5, tiers=("L2", "L4"), specs=many, scorer_version="0.5.0")
    write_run(tmp_path / "a", "2", "tuned", lambda t, s: int(s[1:]) < 5 + gain, tiers=("L2", "L4"), specs=many, scorer_version="0.5.0")
    parts = [source.scan(spark, str(tmp_path / x)) for x in "ba"]
    return [{"metas": p.metas, "answers": p.answers, "ends": p.ends} for p in parts]


def test_verdict(spark, tmp_path):
    base, adapter = arms(spark, tmp_path, 10)
    expected = {"model": "base", "adapter": "tuned", "scorer_version": "0.5.0", "rollouts": 1, "n_specs": 20}
    row = compare.compare(base, adapter, expected).first()
    assert row.point == pytest.approx(0.5) and row.confirmed and row.worthwhile and not row.regression
    assert (row.pairs, row.improved, row.worsened) == (40, 20, 0)
    with pytest.raises(Refused, match="scorer_version"):
        compare.compare(base, adapter, {**expected, "scorer_version": "0.4.0"})
    with pytest.raises(Refused, match="missing or repeated"):
        compare.compare(base, adapter, {**expected, "n_specs": 21})


def test_differing_checks(spark):
    schema = "k int, checks map<string,boolean>"
    a, b = spark.createDataFrame([(1, {"x": True, "y": False}), (2, {"x": True})], schema), spark.createDataFrame([(1, {"x": False}), (2, {"x": True})], schema)
    assert [(r.k, r.changed) for r in compare.differing_checks(a, b, ["k"]).collect()] == [(1, ["x", "y"])]


def test_histograms_tolerate_error_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"bins": {"rewards": [{"bin": "0.0-0.5", "count": 3}], "advantages": [{"bin": "-0.875--0.787", "count": 1}]}}))
    (tmp_path / "b.json").write_text("HTTP 429")
    rows = source.histograms(spark, str(tmp_path)).collect()
    assert {(r.metric, r.low, r.high, r["count"]) for r in rows if not r.corrupt} == {("rewards", 0.0, 0.5, 3), ("advantages", -0.875, -0.787, 1)}
    assert any(r.corrupt for r in rows)


def test_manifest_and_links(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_bytes(b"x\ny\n")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    (tmp_path / "e").mkdir()
    (tmp_path / "e/a.txt").write_bytes(b"other")
    same = spark.createDataFrame([("e/a.txt", digest(b"other")), ("a.txt", digest(b"other"))], "file string, sha256 string")
    assert {r.file: r.state for r in source.verify_manifest(spark, same, str(tmp_path)).collect()} == {"e/a.txt": "as stored", "a.txt": "mismatch"}
    manifest = spark.createDataFrame([("a.txt", digest(b"x\ny\n")), ("b.txt", "0")], "file string, sha256 string")
    assert {r.file: r.state for r in source.verify_manifest(spark, manifest, str(tmp_path)).collect()} == {"a.txt": "as stored", "b.txt": "missing"}
    crlf = spark.createDataFrame([("a.txt", digest(b"x\r\ny\r\n"))], "file string, sha256 string")
    assert source.verify_manifest(spark, crlf, str(tmp_path)).first().state == "CRLF"
    (tmp_path / "d").mkdir()
    (tmp_path / "d/r.md").write_text("[a](../a.txt) [b](gone.md#x) [c](https://x.org)")
    assert [r.link for r in source.broken_links(spark, str(tmp_path)).collect()] == ["gone.md"]


def test_specs(spark):
    specs = spec_source.splits(spec_source.sample(spark, 230, spec_source.SAMPLE_SEED)).cache()
    assert specs.filter(spec_source.feasible()).count() == 230
    assert {r.split: r["count"] for r in specs.groupBy("split").count().collect()} == {"eval": 30, "train": 200}
    a, b = (spec_source.fingerprint(s.withColumn("split", F.lit("x"))).first().sha256 for s in (specs, specs.repartition(3)))
    assert a == b
    # The published fingerprint of the test split.
    assert spec_source.fingerprint(spec_source.locked_split(spark)).first().sha256 == "019d197efecedc079209fcb5900c7d5b2ff894481bc6cc85954826070c30c51b"


def test_catalogue(spark, tmp_path):
    model = lambda i, p, q, out=("text",): {"id": i, "context_length": 1, "architecture": {"output_modalities": out}, "pricing": {"prompt": p, "completion": q}}
    rows = [model("a", "0.001", "0"), model("b", "0", "0"), model("c:free", "1", "1"), model("~d", "1", "1"), model("e~f", "1", "1"), model("g", "1", "1", ("text", "image")), model("h", "-1", "1"), model("i", "1", "1", None)]
    (tmp_path / "models.json").write_text(json.dumps({"data": rows}))
    assert sorted(r.id for r in source.catalogue(spark, str(tmp_path / "models.json")).collect()) == ["a", "e~f", "i"]


def test_conformity(spark, tmp_path):
    (tmp_path / "b").mkdir()
    write_run(tmp_path / "b", "1", "m", lambda t, s: True, tiers=("L2", "L4"), specs=["x", "y"], split="test", test_split={"seed": 1, "sha256": "f"}, arm="hint", hints_source="h", extra_body={"chat_template_kwargs": {"enable_thinking": False}}, temperature=0.0)
    runs = source.scan(spark, str(tmp_path / "b"))
    good = {"model": "m", "temperature": 0.0, "split": "test", "split_sha256": "f", "arm": "hint", "hints": True, "thinking": False, "n_specs": 2}
    problems = lambda **change: compare.conformity(runs.metas, runs.answers, runs.ends, {**good, **change}).first().problems
    assert problems() == []
    assert problems(split_sha256="g", thinking=True, temperature=0.7) == ["temperature is not 0.7", "not the locked split with the registered fingerprint", "thinking is not True"]
    assert problems(tiers=("L2",)) == ["there are unregistered tiers"]
    assert problems(n_specs=3) == ["answers of tier L2 are missing or repeated", "answers of tier L4 are missing or repeated"]


def test_tasks(spark):
    from plumbline.sources import tasks

    specs = spec_source.splits(spec_source.sample(spark, 230, spec_source.SAMPLE_SEED))
    rows = {(r.info.spec_id, r.info.tier): r.question for r in tasks.tasks(specs).collect()}
    assert len(rows) == 1150
    plate = next(k[0] for k, q in rows.items() if k[1] == "L4" and ".box(202.5, 148.5, 10.0)" in q)
    # A published prompt.
    assert rows[plate, "L4"] == """\
Below is the current CadQuery model of a mounting plate (rev A).

```python
import cadquery as cq
result = (
    cq.Workplane("XY")
    .box(202.5, 148.5, 10.0)
    .faces(">Z").workplane()
    .rect(176.5, 122.5, forConstruction=True)
    .vertices()
    .hole(10.5)
)
```

ENGINEERING CHANGE ORDER, rev A -> rev B:
  - change overall width (Y) from 148.5 mm to 129 mm
Every other characteristic stays exactly as in rev A: four through holes, one per corner, each hole centre at the stated edge margin from its two nearest edges, part centred on the origin.

Return the complete rev B CadQuery module with the part bound to `result`."""
    assert "R1  Overall length (X):        202.5 mm\n" in rows[plate, "L0"] and "rectangular, 176.5 mm x 103.0 mm centres\n  R6" in rows[plate, "L1"]
    assert "one hole near each corner" in rows[plate, "L2"] and rows[plate, "L0"].count("???") == 7 and "129" in rows[plate, "L3"] and rows[plate, "L0"].endswith("closing parenthesis.\n")
    wordings = {q.split(" ")[0] for (s, t), q in rows.items() if t == "L3"}
    assert wordings <= {"I", "DRAWING", "Model", "Supplier", "Hi,", "Inspection"} and len(wordings) == 6
    with pytest.raises(ValueError):
        tasks.tasks(specs, ["L9"])
