"""From run logs to a ranking: summaries, completeness, the latest clean run, exact coverage, headline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import selection, stats
from plumbline.operators.scoring import GATES, all_checks_pass
from plumbline.sources.runs import Runs

HEADLINE = ("L1", "L2", "L3", "L4")
# The checks of the requirements, by their recorded names.
CHECKS = (
    "R1:length", "R2:width", "R3:thickness", "R4a:hole_count", "R4b:hole_diameter", "R5:hole_pattern", "R6:material", "R7:edge_margin", "R8:z_datum", "R9:no_other_features",
)


def summary(runs: Runs) -> DataFrame:
    """One row per (run_id, tier): two-level means, rates, counts and cost, and maps of the pass rate of each check (null
    where other checks are known, but not this one) and of the failure rate of each gate among what was built.

    A cost counts as unknown where there was usage without a cost.
    """
    answers = runs.answers.withColumn("passed", (F.col("reward") >= 1.0).cast("double"))
    per_spec = answers.groupBy("run_id", "tier", "spec_id").agg(F.avg("reward").alias("r"), F.avg("passed").alias("p"))
    means = per_spec.groupBy("run_id", "tier").agg(F.count("*").alias("specs"), F.avg("r").alias("mean_reward"), F.avg("p").alias("pass_rate"))
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    built = F.coalesce("built", F.lit(False))
    pair = lambda names, rate: F.create_map(*(x for n in names for x in (F.lit(n), rate(n))))
    fails = lambda g: stats.rate(~F.coalesce(F.try_element_at("checks", F.lit(g)), F.lit(True)), built)
    counts = answers.groupBy("run_id", "tier").agg(
        F.count("*").alias("n"), F.median("reward").alias("median_reward"), F.avg(built.cast("double")).alias("built_rate"),
        stats.rate(F.coalesce("gates_passed", F.lit(False)), built).alias("gate_rate"), flag(F.col("timeout")).alias("timeouts"),
        flag(F.col("cut_off")).alias("truncated"), flag(F.col("is_loop")).alias("loops"), F.count_if(F.coalesce("api_error", F.lit("")) != "").alias("api_errors"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.count_if(F.col("cost_usd").isNull() & F.col("usage.completion_tokens").isNotNull()).alias("unknown_cost"),
        pair(CHECKS, lambda c: stats.check_rate("checks", c)).alias("per_check"), pair(GATES, fails).alias("per_gate_fail"),
    )
    out = means.join(counts, ["run_id", "tier"])
    return out.withColumn("flagged", F.col("truncated") + F.col("api_errors") > 0.05 * F.col("n"))


def completeness(runs: Runs) -> DataFrame:
    """(run_id, tier, problems): rows planned but missing, extra or repeated ones, and runs that didn't complete."""
    tiers = runs.metas.select("run_id", "planned", F.explode("planned.tiers").alias("tier"))
    specs = tiers.select("run_id", "tier", "planned", F.explode("planned.spec_ids").alias("spec_id"))
    planned = specs.select("run_id", "tier", "spec_id", F.explode(F.sequence(F.lit(0), F.col("planned.rollouts") - 1)).alias("rollout"))
    keys = ["run_id", "tier", "spec_id", "rollout"]
    off = selection.coverage(planned, runs.answers, keys).groupBy("run_id", "tier").agg(F.count_if(F.col("problem") == "missing").alias("missing"), F.count_if(F.col("problem") == "extra").alias("extra"))
    twice = selection.duplicates(runs.answers, keys).groupBy("run_id", "tier").agg(F.sum("excess").alias("repeated"))
    status = runs.ends.select("run_id", "status")
    rows = tiers.select("run_id", "tier").unionByName(runs.answers.select("run_id", "tier")).distinct()
    rows = rows.join(off, ["run_id", "tier"], "left").join(twice, ["run_id", "tier"], "left").join(status, "run_id", "left").fillna(0, ["missing", "extra", "repeated"])
    rules = {"missing answers": F.col("missing") > 0, "extra answers": F.col("extra") > 0, "repeated answers": F.col("repeated") > 0, "interrupted or still running": F.col("status").isNull(), "not complete": F.col("status") != "complete"}
    return rows.select("run_id", "tier", selection.problems(rules).alias("problems"))


def selected(runs: Runs, split: str = "eval") -> DataFrame:
    """The latest clean run of each (label, tier), else the latest, with its summary, problems and `superseded`."""
    metas = runs.metas.filter(F.col("split") == split).select("run_id", "label", "model", "arm")
    rows = summary(runs).join(metas, "run_id").join(completeness(runs), ["run_id", "tier"], "left")
    clean = (F.size("problems") == 0) & ~F.col("flagged")
    return selection.latest_clean(rows, ["label", "tier"], clean, "run_id")


def ranking(runs: Runs, expected: DataFrame, split: str = "eval", draws: int = 2000) -> DataFrame:
    """(model, headline, low, high, rank): the mean over specs of the mean over L1..L4 of passes.

    A model whose selected answers don't cover exactly the expected spec ids at each tier has no headline and no rank.
    """
    chosen = selected(runs, split).filter((F.col("arm") == "first-shot") & F.col("tier").isin(*HEADLINE)).select("run_id", "tier", "model")
    answers = runs.answers.join(chosen, ["run_id", "tier"])
    passed = answers.withColumn("p", all_checks_pass("checks").cast("double")).groupBy("model", "tier", "spec_id").agg(F.avg("p").alias("p"))
    models = passed.select("model").distinct()
    wanted = models.withColumn("_", F.lit(1)).join(expected.select("spec_id").withColumn("_", F.lit(1)), "_").drop("_").withColumn("tier", F.explode(F.array(*map(F.lit, HEADLINE))))
    off = selection.coverage(wanted, passed, ["model", "tier", "spec_id"]).select("model").distinct()
    per_spec = passed.join(off, "model", "left_anti").groupBy("model", "spec_id").agg(F.avg("p").alias("p"))
    headline = per_spec.groupBy("model").agg(F.avg("p").alias("headline"))
    ci = stats.interval(stats.cluster_draws(per_spec, ["model"], "spec_id", "p", draws, 0), ["model"], draws)
    rows = models.join(headline, "model", "left").join(ci, "model", "left")
    rank = F.when(F.col("headline").isNotNull(), F.row_number().over(Window.orderBy(F.desc_nulls_last("headline"), "model")))  # a row per model
    return rows.withColumn("rank", rank)
