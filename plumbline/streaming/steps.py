"""Step metrics of a stream, one set per micro-batch, with running totals that a replayed batch doesn't count twice.

Each batch's metrics are a file of their own, named by the batch; a replay overwrites its own and no other. Totals are a
running sum over the files, so nothing has to be read, changed and written back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Everything that was told, and what was trained on.
SUBSETS = ("all", "effective")


def metrics(answers: DataFrame, by: str = "source") -> DataFrame:
    """(scope, subset, answers, groups, tokens, reward, failed, share): over all sources ("agg") and each of them.

    answers: by, group_id, reward, tokens, failed, effective. share: of all answers of the subset.
    """
    return metrics_by(answers, [], by)


def metrics_by(answers: DataFrame, steps: list[str], by: str = "source") -> DataFrame:
    """The same for each step of a log that holds many."""
    scopes = F.explode(F.array(F.lit("agg"), F.col(by))).alias("scope")
    rows = answers.select(*steps, scopes, "group_id", "reward", "tokens", "failed", "effective")
    both = rows.withColumn("subset", F.explode(F.when(F.col("effective"), F.array(*map(F.lit, SUBSETS))).otherwise(F.array(F.lit("all")))))
    out = both.groupBy(*steps, "scope", "subset").agg(
        F.count("*").alias("answers"), F.count_distinct("group_id").alias("groups"), F.sum("tokens").alias("tokens"), F.avg("reward").alias("reward"),
        F.count_if(F.coalesce("failed", F.lit(False))).alias("failed"),
    )
    of = F.max(F.when(F.col("scope") == "agg", F.col("answers"))).over(Window.partitionBy(*steps, "subset"))
    return out.withColumn("share", F.col("answers") / of)


class StepMetrics:
    """A writer for foreachBatch."""

    def __init__(self, path: str, by: str = "source"):
        self.path, self.by = path, by

    def __call__(self, answers: DataFrame, batch: int) -> None:
        out = metrics(answers, self.by)
        out.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """All batches' metrics with total_answers, total_groups and total_tokens up to the batch, by scope and subset."""
    return running(spark.read.parquet(path))


def running(steps: DataFrame) -> DataFrame:
    """steps (batch, scope, subset, answers, groups, tokens, ...) with their running totals."""
    w = Window.partitionBy("scope", "subset").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumns({f"total_{c}": F.sum(c).over(w) for c in ("answers", "groups", "tokens")})
