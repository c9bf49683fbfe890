"""Costs of training steps: reconstruction from rates and counts, phases, decomposition, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(value: Column, what: str) -> Column:
    """The integer that a product of a rate and a count must be; anything else stops the query."""
    off = F.abs(value - F.round(value)) > 1e-7
    return F.when(off, F.raise_error(F.concat(F.lit(f"{what} is no whole number: "), value.cast("string"))).cast("long")).otherwise(F.round(value).cast("long"))


def steps(raw: DataFrame, environments: list[str]) -> DataFrame:
    """Per step: trained, solved, failed and discarded counts of each environment.

    raw: run, step, generated, trained, and by environment e: e_share, e_trained_share, e_solved_rate, input and output
    means e_input_mean, e_output_mean.
    """
    out = raw
    for e in environments:
        generated = whole(F.col(f"{e}_share") * F.col("generated"), f"{e} generated")
        trained = whole(F.col(f"{e}_trained_share") * F.col("trained"), f"{e} trained")
        out = out.withColumns({f"{e}_generated": generated, f"{e}_trained": trained})
        out = out.withColumn(f"{e}_solved", whole(F.col(f"{e}_solved_rate") * F.col(f"{e}_generated"), f"{e} solved"))
        out = out.withColumn(f"{e}_failed", F.col(f"{e}_generated") - F.col(f"{e}_solved"))
        unused = F.col(f"{e}_generated") - F.col(f"{e}_trained")
        out = out.withColumns({f"{e}_discard_input": unused * F.col(f"{e}_input_mean"), f"{e}_discard_output": unused * F.col(f"{e}_output_mean")})
    return out


def priced(rows: DataFrame, input_price: float, output_price: float, training_price: float, billed: Column | None = None) -> DataFrame:
    """list_inference, list_training and list_cost of token columns (prices by million); with billed, the allocation of it."""
    per = 1e6
    out = rows.withColumns(
        {
            "list_inference": (F.col("gen_input") * input_price + F.col("gen_output") * output_price) / per,
            "list_training": F.col("trained_tokens") * training_price / per,
        }
    ).withColumn("list_cost", F.col("list_inference") + F.col("list_training"))
    if billed is None:
        return out
    total = out.groupBy("run").agg((F.first(billed) / F.sum("list_cost")).alias("alpha"))
    return out.join(total, "run").withColumn("allocated_cost", F.col("alpha") * F.col("list_cost"))


def call_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column, provider_cost: Column) -> tuple[Column, Column]:
    """(cost, source): tokens at the given prices, else the provider's figure, else null."""
    own = (input_tokens * input_price + output_tokens * output_price) / 1e6
    return F.coalesce(own, provider_cost), F.when(own.isNotNull(), "price list").when(provider_cost.isNotNull(), "provider")


def phases(rows: DataFrame, bounds: DataFrame, sums: list[str], rates: dict[str, str], means: list[str]) -> DataFrame:
    """By phase (name, lo, hi; phases may overlap): sums, rates weighted by a count, plain means."""
    joined = rows.join(F.broadcast(bounds), (F.col("step") >= F.col("lo")) & (F.col("step") <= F.col("hi")))  # a few phases
    return joined.groupBy("phase").agg(
        F.count("*").alias("steps"),
        *(F.sum(c).alias(c) for c in sums),
        *((F.sum(F.col(r) * F.col(n)) / F.sum(n)).alias(r) for r, n in rates.items()),
        *(F.avg(c).alias(c) for c in means),
    )


def decomposition(before: DataFrame, after: DataFrame) -> DataFrame:
    """How volume, input length, output length and training length share the change of a step's cost, each change
    weighted by the mean of the other factors before and after. One row each: n, input_mean, output_mean, train_mean,
    input_price, output_price, training_price."""
    factors = ["n", "input_mean", "output_mean", "train_mean", "input_price", "output_price", "training_price"]
    b, a = before.select(*(F.col(c).alias(f"b_{c}") for c in factors)), after.select(*(F.col(c).alias(f"a_{c}") for c in factors))
    rows = b.crossJoin(F.broadcast(a))  # one row each
    unit = lambda s: sum((F.col(f"{s}_{m}_mean") * F.col(f"b_{p}_price") for m, p in (("input", "input"), ("output", "output"), ("train", "training"))), F.lit(0.0))
    mid_n = (F.col("a_n") + F.col("b_n")) / 2
    change = lambda m, p: mid_n * (F.col(f"a_{m}_mean") - F.col(f"b_{m}_mean")) * F.col(f"b_{p}_price")
    return rows.select(
        ((F.col("a_n") - F.col("b_n")) * (unit("a") + unit("b")) / 2).alias("volume"),
        change("input", "input").alias("input"),
        change("output", "output").alias("output"),
        change("train", "training").alias("training"),
    )


def forecast_error(rows: DataFrame, forecast: str, actual: str) -> DataFrame:
    e = F.col(forecast) - F.col(actual)
    return rows.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.min(e).alias("low"), F.max(e).alias("high"), F.avg(F.abs(e) / F.abs(F.col(actual))).alias("relative"))


def budget(steps_left: Column, useful: Column, cost_per_useful: Column, flat_share: Column, overhead: float, margin: float) -> Column:
    """Forecast spend: useful answers inflated by flat groups and overhead, with a safety margin."""
    return steps_left * useful / (1 - flat_share) * cost_per_useful * (1 + overhead) * (1 + margin)
