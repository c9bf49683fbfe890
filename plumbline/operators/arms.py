"""Arms of one model (first answer, with hints, with feedback): registration, side by side, retries, predictions.

The prompts of the arms and the registered settings are parameters: they belong to an experiment, not to this library.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import selection, stats
from plumbline.operators.scoring import all_checks_pass

# Names of the arms, the last of which retries, and bounds of the predictions.
BASE, HINT, FEEDBACK = "first-shot", "hint", "feedback"
KNOWLEDGE_RATIO, API_RATIO, STACKED_RATIO, SHIFT = 0.5, 0.5, 0.75, 0.05
# The scorer's prefix of an error, and how many characters of the rest are compared.
PREFIX, CORE = r"^execution failed(?: \[[^\]]*\])?: ", 80


def arm_problems(metas: DataFrame, registered: dict, prompts: dict[str, str]) -> DataFrame:
    """(run_id, arm, problems): settings that aren't the registered ones, retries, another system prompt, an unknown arm.

    registered: setting -> value; prompts: arm -> its whole system prompt. A missing setting is a departure.
    """
    retries = F.coalesce("feedback_retries", F.lit(0))
    prompt = F.coalesce(*(F.when(F.col("arm") == arm, F.lit(text)) for arm, text in prompts.items()))
    rules = {f"{name} is not {value}": ~F.col(name).eqNullSafe(F.lit(value)) for name, value in registered.items()}
    rules["feedback retries are not the arm's"] = retries != F.when(F.col("arm") == FEEDBACK, 1).otherwise(0)
    rules["the system prompt is not the arm's"] = ~F.col("system_prompt").eqNullSafe(prompt)
    rules["the arm is not registered"] = ~F.coalesce(F.col("arm").isin(*prompts), F.lit(False))
    return metas.select("run_id", "arm", selection.problems(rules).alias("problems"))


def side_by_side(outcomes: DataFrame, labels: dict[str, Sequence[str]], arms: Sequence[str] = (BASE, HINT, FEEDBACK)) -> DataFrame:
    """(model, <arm>_<name>): the share of each arm's outcomes that are in each set of labels, null without that arm."""
    shares = {name: F.avg(F.col("label").isin(*among).cast("double")) for name, among in labels.items()}
    values = [share.alias(name) for name, share in shares.items()]
    if len(values) == 1:  # a pivot of one aggregate names its columns by the arm alone
        values.append(F.count(F.lit(1)).alias("n"))
    wide = outcomes.groupBy("model").pivot("arm", list(arms)).agg(*values)
    return wide.select("model", *(F.col(f"`{arm}_{name}`") for arm in arms for name in labels))


def retry_counts(answers: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Of the answers with earlier attempts: how many were retried, built, passed, and failed with the first one's error.

    answers: built, checks, error, attempts (array of structs with error). Errors are compared without the prefix that
    tells where they arose.
    """
    built = F.coalesce("built", F.lit(False))
    core = lambda error: F.substring(F.regexp_replace(F.coalesce(error, F.lit("")), PREFIX, ""), 1, CORE)
    again = ~built & (core(F.col("error")) == core(F.col("attempts")[0]["error"]))
    retried = answers.filter(F.size("attempts") > 0)
    return retried.groupBy(*by).agg(
        F.count("*").alias("retried"), F.count_if(built).alias("built"),
        F.count_if(all_checks_pass("checks")).alias("passed"), F.count_if(again).alias("same_error"),
    )


def shift(outcomes: DataFrame, arm: str, labels: Sequence[str], draws: int = 2000, seed: int = 0) -> DataFrame:
    """(model, point, low, high): the change of a share from the first arm to another, paired by (tier, spec).

    Specs are resampled, so that the tiers of a spec stay together.
    """
    of = lambda name, column: outcomes.filter(F.col("arm") == name).select("model", "tier", "spec_id", F.col("label").isin(*labels).cast("double").alias(column))
    both = of(BASE, "a").join(of(arm, "b"), ["model", "tier", "spec_id"]).withColumn("d", F.col("b") - F.col("a"))
    clusters = both.groupBy("model", "spec_id").agg(F.collect_list("d").alias("values"))  # at most one value a tier
    return stats.seeded_interval(clusters, ["model"], "spec_id", "values", draws, seed)


def predictions(outcomes: DataFrame, knowledge: Sequence[str], api: str, stacked: str, reasoning: Sequence[str], knowledge_models: Sequence[str], all_models: Sequence[str]) -> DataFrame:
    """(prediction, model, arm, held): held is null where an arm has no outcomes.

    P1: hints at least halve the failures of knowledge. P2: feedback at least halves API errors, while three quarters of
    the stacked ones stay. P3: neither arm moves a failure of reasoning by more than SHIFT.
    """
    sets = {"knowledge": list(knowledge), "api": [api], "stacked": [stacked], **{f"r{i}": [name] for i, name in enumerate(reasoning)}}
    spark = outcomes.sparkSession
    models = spark.createDataFrame([(m, m in knowledge_models) for m in dict.fromkeys([*knowledge_models, *all_models])], "model string, known boolean")
    wide = models.join(side_by_side(outcomes, sets), "model", "left")
    of = lambda arm, name: F.col(f"`{arm}_{name}`")
    still = lambda arm: F.forall(F.array(*(F.abs(of(arm, f"r{i}") - of(BASE, f"r{i}")) <= SHIFT for i in range(len(reasoning)))), lambda x: x)
    rules = [
        ("P1", HINT, of(HINT, "knowledge") <= KNOWLEDGE_RATIO * of(BASE, "knowledge"), F.col("known")),
        ("P2", FEEDBACK, (of(FEEDBACK, "api") <= API_RATIO * of(BASE, "api")) & (of(FEEDBACK, "stacked") >= STACKED_RATIO * of(BASE, "stacked")), F.col("known")),
        *(("P3", arm, still(arm), F.col("model").isin(*all_models)) for arm in (HINT, FEEDBACK)),
    ]
    tested = F.array(*(F.when(where, F.struct(F.lit(p).alias("prediction"), F.lit(arm).alias("arm"), held.alias("held"))) for p, arm, held, where in rules))
    return wide.select("model", F.explode(F.array_compact(tested)).alias("x")).select("x.prediction", "model", "x.arm", "x.held")


def outlook(tested: DataFrame) -> DataFrame:
    """(prediction, verdict): incomplete if a model has no data, confirmed if it held for all, else not confirmed."""
    verdict = F.when(F.bool_or(F.col("held").isNull()), "incomplete").when(F.bool_and("held"), "confirmed").otherwise("not confirmed")
    return tested.groupBy("prediction").agg(verdict.alias("verdict"))


def labelled(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """answers with `label`: "pass" where all checks hold, else the failure label of (run_id, tier, spec_id, rollout).

    A failed answer without a label is refused: the labels are then those of other runs.
    """
    keys = ["run_id", "tier", "spec_id", "rollout"]
    rows = answers.join(labels.select(*keys, F.col("label").alias("_label")), keys, "left")
    out = rows.withColumn("label", F.when(F.coalesce(all_checks_pass("checks"), F.lit(False)), "pass").otherwise(F.col("_label"))).drop("_label")
    if not out.filter(F.col("label").isNull()).isEmpty():
        raise selection.Refused("failed answers without a failure label")
    return out
