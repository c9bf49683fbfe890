"""Registered comparisons: conformity first, then paired estimates, intervals and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import selection, stats

# Fixed values of the registered design.
WORTHWHILE, DRAWS, SEED, TIERS, MOST_TRUNCATED = 0.10, 10_000, 20261001, ("L2", "L4"), 0.05
#: Fields of a run that must equal the registered ones.
PLAIN = ("model", "scorer_version", "temperature", "max_tokens", "rollouts", "split", "arm", "system_prompt_sha256")


def conformity(metas: DataFrame, answers: DataFrame, ends: DataFrame, expected: dict) -> DataFrame:
    """(run_id, problems): every departure of a run from the registration `expected`.

    expected: the fields of PLAIN that are registered, n_specs and tiers; split_sha256, hints (the arm must name its
    source) and thinking if they are registered. A missing field is a departure.
    """
    tiers = list(expected.get("tiers", TIERS))
    of_tier = lambda t: F.col("tier") == t
    counts = [c for i, t in enumerate(tiers) for c in (F.count_if(of_tier(t)).alias(f"n{i}"), F.count_distinct(F.when(of_tier(t), F.col("spec_id"))).alias(f"d{i}"))]
    per_run = answers.groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce("api_error", F.lit("")) != "").alias("api_errors"),
        F.count_distinct("served_model").alias("served_models"),
        F.count_if(F.coalesce("finish_reason", F.lit("")) == "length").alias("capped"),
        F.count_if(~F.coalesce(F.col("tier").isin(*tiers), F.lit(False))).alias("strays"),
        *counts,
    )
    end = ends.select("run_id", "status")
    rows = metas.join(per_run, "run_id", "left").join(end, "run_id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = {f"{name} is not {expected[name]}": ~F.col(name).eqNullSafe(F.lit(expected[name])) for name in PLAIN if name in expected}
    if "split_sha256" in expected:
        rules["not the locked split with the registered fingerprint"] = ~F.col("test_split.sha256").eqNullSafe(F.lit(expected["split_sha256"]))
    if expected.get("hints"):
        rules["the hints have no source"] = F.col("hints_source").isNull()
    if "thinking" in expected:
        flag = F.get_json_object("extra_body", "$.chat_template_kwargs.enable_thinking")
        rules[f"thinking is not {expected['thinking']}"] = ~flag.eqNullSafe(F.lit(str(expected["thinking"]).lower()))
    rules |= {
        "the run is not complete": ~F.col("status").eqNullSafe(F.lit("complete")),
        "too many answers are truncated": (number("n") > 0) & (number("capped") / F.nullif(F.col("n"), F.lit(0)) >= MOST_TRUNCATED),
        "there are API errors": number("api_errors") > 0,
        **{f"answers of tier {t} are missing or repeated": (number(f"n{i}") != expected["n_specs"]) | (number(f"d{i}") != expected["n_specs"]) for i, t in enumerate(tiers)},
        "there are unregistered tiers": number("strays") > 0,
        "several models were served": number("served_models") > 1,
        "retries were allowed": F.coalesce("feedback_retries", F.lit(0)) > 0,
    }
    return rows.select("run_id", selection.problems(rules).alias("problems"))


def outcomes(answers: DataFrame) -> DataFrame:
    """(tier, spec_id, passed) of an arm: 1 for a full reward."""
    return answers.select("tier", "spec_id", (F.col("reward") == 1.0).cast("int").alias("passed"))


def paired(base: DataFrame, adapter: DataFrame, tiers: Sequence[str] = TIERS) -> DataFrame:
    """(tier, spec_id, base, adapter, difference) on the intersection of keys."""
    arm = lambda df, name: df.filter(F.col("tier").isin(*tiers)).select("tier", "spec_id", F.col("passed").alias(name))
    both = arm(base, "base").join(arm(adapter, "adapter"), ["tier", "spec_id"])
    return both.withColumn("difference", F.col("adapter") - F.col("base"))


def gain(pairs: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """One row: point, low, high (cluster bootstrap over specs), arm rates, pairs, improved and worsened."""
    clusters = pairs.groupBy("spec_id").agg(F.collect_list(F.col("difference").cast("double")).alias("values")).withColumn("comparison", F.lit("gain"))
    ci = stats.seeded_interval(clusters, ["comparison"], "spec_id", "values", draws, seed)
    counts = pairs.agg(
        F.lit("gain").alias("comparison"), F.count("*").alias("pairs"), F.avg("base").alias("base_rate"), F.avg("adapter").alias("adapter_rate"),
        F.count_if(F.col("difference") > 0).alias("improved"), F.count_if(F.col("difference") < 0).alias("worsened"),
    )
    return ci.join(counts, "comparison").drop("comparison")


def verdict(row: DataFrame) -> DataFrame:
    """confirmed: the interval lies above 0; worthwhile: the point reaches the registered gain; regression: below 0."""
    return row.withColumns({"confirmed": F.col("low") > 0, "worthwhile": F.col("point") >= WORTHWHILE, "regression": F.col("high") < 0})


def compare(base: dict[str, DataFrame], adapter: dict[str, DataFrame], expected: dict, tiers: Sequence[str] = TIERS) -> DataFrame:
    """The verdict row; a run that departs from the registration is refused before any number is computed.

    base, adapter: {"metas", "answers", "ends"}.
    """
    for side, more in ((base, {}), (adapter, {"model": expected.get("adapter", expected.get("model"))})):
        selection.refuse_if_any(conformity(side["metas"], side["answers"], side["ends"], {**expected, **more}))
    return verdict(gain(paired(outcomes(base["answers"]), outcomes(adapter["answers"]), tiers)))


def differing_checks(recorded: DataFrame, replayed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, changed): the checks whose recorded and replayed verdicts differ, a missing one from any other."""
    a, b = recorded.select(*keys, F.col("checks").alias("_a")), replayed.select(*keys, F.col("checks").alias("_b"))
    names = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    value = lambda m, k: F.try_element_at(m, k)
    changed = F.filter(F.array_union(names("_a"), names("_b")), lambda k: ~value(F.col("_a"), k).eqNullSafe(value(F.col("_b"), k)))
    return a.join(b, list(keys), "full_outer").select(*keys, F.array_sort(changed).alias("changed")).filter(F.size("changed") > 0)


def shares(labels: DataFrame, by: Sequence[str], groups: dict[str, Sequence[str]]) -> DataFrame:
    """By group: the share of answers whose label is in each set, NaN where there are none."""
    share = lambda names: F.coalesce(F.avg(F.col("label").isin(*names).cast("double")), F.lit(float("nan")))
    return labels.groupBy(*by).agg(*(share(names).alias(name) for name, names in groups.items()))


def rollup_verdict(row: str, rules: dict[str, Column]) -> Column:
    """confirmed if all rules hold, incomplete if any has no data, else not confirmed."""
    flags = list(rules.values())
    unknown = F.exists(F.array(*flags), lambda x: x.isNull())
    return F.when(unknown, "incomplete").when(F.forall(F.array(*flags), lambda x: x), "confirmed").otherwise("not confirmed").alias(row)


def position(value: Column, low: Column, high: Column) -> Column:
    return F.when(value > high, "above").when(value < low, "below").otherwise("inside")


def confusion(labels: DataFrame, truth: str, found: str, ambiguous: str) -> DataFrame:
    """By check: how often truth and verdict hold it failed, from arrays of failed checks, ambiguous ones apart."""
    pick = lambda a, b: F.array_except(F.col(a), F.col(b))
    rows = labels.select(F.explode(F.array_distinct(F.concat(truth, found, ambiguous))).alias("check"), truth, found, ambiguous)
    has = lambda c: F.array_contains(F.col(c), F.col("check"))
    rows = rows.withColumn("unsure", has(ambiguous))
    return rows.groupBy("check").agg(
        F.count_if(~F.col("unsure") & has(truth) & has(found)).alias("both"),
        F.count_if(~F.col("unsure") & has(truth) & ~has(found)).alias("missed"),
        F.count_if(~F.col("unsure") & ~has(truth) & has(found)).alias("false_alarms"),
        F.count_if(F.col("unsure")).alias("ambiguous"),
    )
