"""Guards of launches, settings and reports; small report operators."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import guards, reports

RUN = {"provider": "openai", "model": "m", "split": "eval", "unlocked": None, "arm": "first-shot", "hints": None, "prompt_file": None, "retries": 0, "price_in": None, "price_out": None}
SCHEMA = "n int, provider string, model string, split string, unlocked boolean, arm string, hints boolean, prompt_file string, retries int, price_in double, price_out double"


def test_launch(spark):
    cases = [
        ({}, []), ({"model": None}, ["a model provider needs a model"]), ({"provider": "parser", "model": None}, []), ({"arm": "hint", "hints": True, "prompt_file": "f"}, ["hints and a prompt file exclude each other"]),
        ({"price_in": 1.0}, ["both prices or none"]), ({"split": "test"}, ["the test split is locked"]), ({"split": "test", "unlocked": True}, []), ({"split": "replication", "unlocked": False}, ["the replication split is locked"]),
        ({"arm": "odd"}, ["unknown arm"]), ({"arm": None}, ["unknown arm"]), ({"arm": "hint"}, ["the arm requires a hint"]), ({"hints": True}, ["the arm does not allow a hint"]), ({"arm": "feedback"}, ["the arm requires retries"]),
        ({"retries": 2}, ["the arm does not allow retries"]), ({"arm": "feedback", "retries": 2}, []), ({"arm": "feedback", "retries": 2, "provider": "parser"}, ["retries need a model provider"]),
    ]
    df = spark.createDataFrame([(n, *{**RUN, **change}.values()) for n, (change, _) in enumerate(cases)], SCHEMA)
    got = {r.n: r.problems for r in guards.launch(df).collect()}
    assert [got[n] for n in range(len(cases))] == [want for _, want in cases]


SETTINGS = {"temperature": 0.7, "max_tokens": 2048, "rollouts": 8, "thinking": False}


def test_settings(spark):
    extra = json.dumps({"chat_template_kwargs": {"enable_thinking": False}})
    rows = [("a", 0.7, 2048, 8, extra, "hint"), ("b", 0.0, 2048, 8, None, "first-shot")]
    df = spark.createDataFrame(rows, "run_id string, temperature double, max_tokens int, rollouts int, extra_body string, arm string")
    got = {r.run_id: r.problems for r in guards.screening_settings(df, SETTINGS).collect()}
    assert got == {"a": [], "b": ["temperature is not 0.7", "thinking is not False", "the arm is not hint"]}


def test_payloads(spark):
    envs = [{"name": "x", "args": {"hints": True, "reward": "binary"}}, {"name": "y", "args": {"hints": True, "reward": "continuous"}}]
    good = {"temperature": 0.7, "max_tokens": 2048, "rollouts_per_example": 8, "enable_thinking": False, "environments": envs}
    body = lambda **change: json.dumps({"request": {"json": {**good, **change}}})
    df = spark.createDataFrame([("a", body()), ("b", body(max_tokens=5, environments=[])), ("c", "HTTP 429"), ("d", None)], "name string, payload string")
    got = {r.name: r.problems for r in guards.payload_settings(df, SETTINGS, ["x"]).collect()}
    assert got["a"] == [] and got["b"] == ["max_tokens is not 2048", "environment x is not hints and binary reward"] and got["c"][0] == got["d"][0] == "unreadable"
    both = {r.name: r.problems for r in guards.payload_settings(df, SETTINGS, ["x", "y"]).collect()}
    assert both["a"] == ["environment y is not hints and binary reward"]


def test_replay_gate(spark):
    schema = "ok boolean, library string, error string, reference double, failure_binary double, failure double, rollout_reward double, rollout_error string, levels array<struct<n:int,matches:int,wall_s:double>>"
    rows = [(True, "system", None, 1.0, 0.0, 0.8, 1.0, None, [(1, 1, 0.1), (64, 64, 3.5)]), (False, "other", "x", 0.5, None, 0.7, 1.0, "late", [(8, 7, 0.5), (64, 64, 500.0)])]
    got = [r.problems for r in guards.replay_gate(spark.createDataFrame(rows, schema), "system").orderBy(F.desc("ok")).collect()]
    assert got[0] == [] and len(got[1]) == 6 and got[1][-1] == "n=8: 7 rewards match"


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b|c", 2.5, None), ("a", 1.0, 3)], "name string, share double, n int")
    assert reports.markdown(df, ["name"]) == "| name | share | n |\n| --- | --- | --- |\n| a | 1 | 3 |\n| b\\|c | 2.5 | – |\n"
    with pytest.raises(ValueError):
        reports.markdown(df, ["name"], most=1)
    reports.write_report(df, f"{tmp_path}/r", ["name"], "Shares")
    text = b"".join(p.read_bytes() for p in (tmp_path / "r/markdown").glob("part-*"))
    assert text.startswith(b"# Shares\n\n| name |") and b"\r" not in text
    assert [r.name for r in spark.read.json(f"{tmp_path}/r/json").orderBy("name").collect()] == ["a", "b|c"]
    with pytest.raises(Exception, match="exists"):
        reports.write_report(df, f"{tmp_path}/r", ["name"], "Shares")
    seen = reports.versions(spark.createDataFrame([("0.4.0",), ("0.5.0",), (None,), ("0.4.0",)], "scorer_version string"), ["scorer_version"]).first()
    assert seen.scorer_version == ["0.4.0", "0.5.0", "?"] and seen.mixed
