"""Guards: what must hold of runs, payloads and reports before anything is started or computed.

Each gives its rows with `problems`, an array of messages in the order of the rules; `selection.refuse_if_any` stops there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import selection

# Conditions (wants a hint, wants retries) of each registered arm, providers that call models, locked splits.
ARMS = {"first-shot": (False, False), "hint": (True, False), "feedback": (False, True)}
MODEL_PROVIDERS, LOCKED = ("openai", "anthropic"), ("test", "replication")
#: Most seconds that 64 answers at once may take, and what the known failure scores.
WALL_LIMIT, PARTIAL, NEAR = 120.0, 0.8, 1e-3


def launch(runs: DataFrame, arms: dict[str, tuple[bool, bool]] = ARMS) -> DataFrame:
    """runs (provider, model, split, unlocked, arm, hints, prompt_file, retries, price_in, price_out) with problems."""
    calls = F.col("provider").isin(*MODEL_PROVIDERS)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    filed = F.coalesce(F.col("prompt_file"), F.lit("")) != ""
    hinted, retried = yes("hints") | filed, F.coalesce(F.col("retries"), F.lit(0)) != 0
    known = F.col("arm").isin(*arms)
    wants = lambda i: F.coalesce(*(F.when(F.col("arm") == a, F.lit(w[i])) for a, w in arms.items()), F.lit(False))
    rules = {
        "a model provider needs a model": calls & (F.coalesce(F.col("model"), F.lit("")) == ""),
        "hints and a prompt file exclude each other": yes("hints") & filed,
        "both prices or none": F.col("price_in").isNull() != F.col("price_out").isNull(),
        **{f"the {s} split is locked": (F.col("split") == s) & ~yes("unlocked") for s in LOCKED},
        "unknown arm": ~F.coalesce(known, F.lit(False)),
        "the arm requires a hint": known & wants(0) & ~hinted,
        "the arm does not allow a hint": known & ~wants(0) & hinted,
        "the arm requires retries": known & wants(1) & ~retried,
        "the arm does not allow retries": known & ~wants(1) & retried,
        "retries need a model provider": retried & ~F.coalesce(calls, F.lit(False)),
    }
    return runs.withColumn("problems", selection.problems(rules))


def differing(settings: dict[str, object], got: dict[str, Column]) -> dict[str, Column]:
    return {f"{name} is not {value}": ~got[name].eqNullSafe(F.lit(value)) for name, value in settings.items()}


def screening_settings(metas: DataFrame, settings: dict[str, object], arm: str = "hint") -> DataFrame:
    """metas with problems: sampling settings that aren't the registered ones, or another arm."""
    thinking = F.get_json_object("extra_body", "$.chat_template_kwargs.enable_thinking").try_cast("boolean")
    got = {"temperature": F.col("temperature"), "max_tokens": F.col("max_tokens"), "rollouts": F.col("rollouts"), "thinking": thinking}
    return metas.withColumn("problems", selection.problems(differing(settings, got) | {f"the arm is not {arm}": ~F.col("arm").eqNullSafe(F.lit(arm))}))


def payload_settings(payloads: DataFrame, settings: dict[str, object], environments: Sequence[str]) -> DataFrame:
    """(name, problems) of saved training requests (name, payload as JSON): settings, and environments without hints or
    binary reward."""
    v = F.try_parse_json("payload")
    at = lambda path, kind: F.try_variant_get(v, f"$.request.json.{path}", kind)
    got = {"temperature": at("temperature", "double"), "max_tokens": at("max_tokens", "int"), "rollouts": at("rollouts_per_example", "int"), "thinking": at("enable_thinking", "boolean")}
    named = F.transform(F.coalesce(at("environments", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.struct(F.try_variant_get(e, "$.name", "string").alias("name"), F.try_variant_get(e, "$.args.hints", "boolean").alias("hints"), F.try_variant_get(e, "$.args.reward", "string").alias("reward")))
    good = lambda name: F.exists(named, lambda e: (e["name"] == name) & F.coalesce(e["hints"], F.lit(False)) & (F.coalesce(e["reward"], F.lit("")) == "binary"))
    rules = {"unreadable": v.isNull()} | differing(settings, got) | {f"environment {e} is not hints and binary reward": ~F.coalesce(good(e), F.lit(False)) for e in environments}
    return payloads.select("name", selection.problems(rules).alias("problems"))


def replay_gate(reports: DataFrame, source: str) -> DataFrame:
    """reports with problems: start-up from the expected library, known scores, equal rewards at each level, time of 64.

    reports: ok, library, error, reference, failure_binary, failure, rollout_reward, rollout_error, levels (array of
    structs n, matches, wall_s).
    """
    unequal = F.filter("levels", lambda x: x["matches"] != x["n"])
    slow = F.exists("levels", lambda x: (x["n"] == 64) & (x["wall_s"] > WALL_LIMIT))
    told = F.transform(unequal, lambda x: F.concat(F.lit("n="), x["n"].cast("string"), F.lit(": "), x["matches"].cast("string"), F.lit(" rewards match")))
    off = lambda c, value: F.coalesce(F.col(c) != value, F.lit(True))
    rules = {
        f"library is not {source}": ~F.coalesce(F.col("ok"), F.lit(False)) | ~F.col("library").eqNullSafe(F.lit(source)),
        "the reference answer did not score 1": off("reference", 1.0),
        "the known failure did not score as known": off("failure_binary", 0.0) | F.coalesce(F.abs(F.col("failure") - PARTIAL) > NEAR, F.lit(True)),
        "the rollout did not score 1 without error": off("rollout_reward", 1.0) | (F.coalesce(F.col("rollout_error"), F.lit("")) != ""),
        f"64 at once took more than {WALL_LIMIT} s": slow,
    }
    return reports.withColumn("problems", F.concat(selection.problems(rules), told))
