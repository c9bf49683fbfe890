"""Small reports over answers and catalogues: spreads, gates, cheapest models, first passing rows, lookups, estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import stats

# Characters of a token and tokens of the system prompt in the estimate of prompt lengths.
CHARS_PER_TOKEN, SYSTEM_TOKENS = 3.6, 70


def spread(answers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, low, high, zeros, values): a missing reward is 0; values: different ones to three places."""
    reward = F.coalesce("reward", F.lit(0.0))
    return answers.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(reward).alias("mean"), F.min(reward).alias("low"), F.max(reward).alias("high"),
        F.count_if(reward == 0).alias("zeros"), F.count_distinct(F.round(reward, 3)).alias("values"),
    )


def common_errors(answers: DataFrame, error: str = "error", k: int = 5, most: int = 200) -> DataFrame:
    """(error, n): the k most common errors, ties by their text, each cut to `most` characters after counting."""
    counts = answers.filter(F.coalesce(F.col(error), F.lit("")) != "").groupBy(F.col(error).alias("error")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "error").limit(k).select(F.substring("error", 1, most).alias("error"), "n")


def gate_failures(answers: DataFrame, by: Sequence[str], gates: Sequence[str], built: Column) -> DataFrame:
    """(by, gate, fail_rate): among the built answers, the share whose check `gate` is known to fail."""
    named = F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.coalesce(~F.try_element_at("checks", F.lit(g)), F.lit(False)).alias("fails")) for g in gates)))
    rows = answers.select(*by, built.alias("built"), named.alias("x")).select(*by, "built", "x.gate", "x.fails")
    return rows.groupBy(*by, "gate").agg(stats.rate(F.col("fails"), F.col("built")).alias("fail_rate"))


def first_passing(rows: DataFrame, tier: str, numbers: dict[str, int], passed: Column, order: Sequence[str]) -> DataFrame:
    """The first passing rows of each tier by `order`, as many as numbers says; other tiers have none."""
    if not numbers:
        return rows.limit(0)
    wanted = F.coalesce(*(F.when(F.col(tier) == t, F.lit(n)) for t, n in numbers.items()))
    ranked = rows.filter(passed & F.col(tier).isin(*numbers)).withColumn("_r", F.row_number().over(Window.partitionBy(tier).orderBy(*order)))
    # The largest number is a literal, so each task keeps only so many rows of a tier before they are shuffled.
    return ranked.filter(F.col("_r") <= max(numbers.values())).filter(F.col("_r") <= wanted).drop("_r")


def cheapest(models: DataFrame, calls: int, input_tokens: float, output_tokens: Column, k: int, most: float | None = None) -> DataFrame:
    """(model, cost): the k models at which `calls` calls cost least, ties by name; those above `most` are left out."""
    cost = calls * (input_tokens * F.col("input_price") + output_tokens * F.col("output_price"))
    rows = models.select("model", cost.alias("cost"))
    return (rows if most is None else rows.filter(F.col("cost") <= most)).orderBy("cost", "model").limit(k)


def prompt_tokens(prompts: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, tokens): the estimated mean number of input tokens of a call."""
    return prompts.groupBy(*by).agg((F.avg(F.char_length(text)) / CHARS_PER_TOKEN + SYSTEM_TOKENS).alias("tokens"))


def by_failure_share(labels: DataFrame, failed: Column) -> DataFrame:
    """(model, n, share): models by falling share of failures, ties by name."""
    return labels.groupBy("model").agg(F.count("*").alias("n"), F.avg(failed.cast("double")).alias("share")).orderBy(F.desc("share"), "model")


def later_wins(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """The union of lookups of the same columns; of rows with one key that of the last frame stays."""
    columns = frames[0].columns
    both = frames[0].withColumn("_at", F.lit(0))
    for i, other in enumerate(frames[1:], 1):
        both = both.unionByName(other.withColumn("_at", F.lit(i)))
    rest = [c for c in columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), "_at").alias("_row")).select(*(F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in columns))


def without_programs(rows: DataFrame, model: str, programs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(models, programs): deterministic programs are compared with, but not ranked among, the models."""
    is_program = F.coalesce(F.col(model).isin(*programs), F.lit(False))
    return rows.filter(~is_program), rows.filter(is_program)


def extents(parts: DataFrame, within: float = 1e-7) -> DataFrame:
    """(part, margin_x, margin_y, pitch_x, pitch_y, rectangular, symmetric) of the holes of each part.

    parts: part, x_min, x_max, y_min, y_max, holes (array of structs x, y). Margins are the least distances of a hole to
    an edge, pitches the holes' extents; rectangular: four holes, one at each corner of these; symmetric: each hole has
    its mirror image by both middle lines of the part. Positions `within` are the same. Without holes the numbers are null and the others false.
    """
    same = lambda a, b: F.abs(a - b) <= within
    x, y = F.col("holes.x"), F.col("holes.y")
    some = F.size("holes") > 0
    at = lambda values, edge: (F.array_min if edge == 0 else F.array_max)(values)
    once = lambda i, j: F.size(F.filter("holes", lambda h: same(h["x"], at(x, i)) & same(h["y"], at(y, j)))) == 1
    two_x, two_y = F.col("x_min") + F.col("x_max"), F.col("y_min") + F.col("y_max")
    has = lambda px, py: F.exists("holes", lambda o: same(o["x"], px) & same(o["y"], py))
    mirrored = F.forall("holes", lambda h: has(two_x - h["x"], h["y"]) & has(h["x"], two_y - h["y"]))
    margin = lambda lo, hi, v: F.when(some, F.least(F.array_min(v) - F.col(lo), F.col(hi) - F.array_max(v)))
    return parts.select(
        "part", margin("x_min", "x_max", x).alias("margin_x"), margin("y_min", "y_max", y).alias("margin_y"),
        F.when(some, F.array_max(x) - F.array_min(x)).alias("pitch_x"), F.when(some, F.array_max(y) - F.array_min(y)).alias("pitch_y"),
        ((F.size("holes") == 4) & once(0, 0) & once(0, 1) & once(1, 0) & once(1, 1)).alias("rectangular"), (some & mirrored).alias("symmetric"),
    )


def label_counts(labels: DataFrame, model: str = "model", tier: str = "tier", kind: str = "label") -> DataFrame:
    """(grain, model, tier, label, n): labels by model, by model and tier, and by kind over models, in one pass."""
    cube = labels.groupingSets([[F.col(model), F.col(kind)], [F.col(model), F.col(tier), F.col(kind)], [F.col(kind)]], F.col(model), F.col(tier), F.col(kind))
    out = cube.agg(F.grouping_id(model, tier, kind).alias("g"), F.count("*").alias("n"))
    grain = F.when(F.col("g") == 2, "model").when(F.col("g") == 0, "model and tier").otherwise("kind")
    return out.select(grain.alias("grain"), F.col(model).alias("model"), F.col(tier).alias("tier"), F.col(kind).alias("label"), "n")


def value_counts(rows: DataFrame, columns: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, name, value, n): how often each value of each column occurs, nulls as "none"."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(c.cast("string"), F.lit("none")).alias("value")) for n, c in columns.items()))).alias("p")
    return rows.select(*by, pairs).groupBy(*by, "p.name", "p.value").agg(F.count("*").alias("n"))


def versions(metas: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, a sorted list per column, mixed): the distinct versions, "?" for none; mixed if the first has several."""
    lists = [F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("?")))).alias(c) for c in columns]
    return metas.groupBy(*by).agg(*lists).withColumn("mixed", F.size(columns[0]) > 1)


def markdown(rows: DataFrame, order: Sequence[str], most: int = 1000) -> str:
    """A small report as a Markdown table with LF line ends; more than `most` rows are refused."""
    found = rows.orderBy(*order).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "–" if v is None else f"{v:g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["---"] * len(rows.columns), *([cell(v) for v in r] for r in found)]
    return "".join(f"| {' | '.join(line)} |\n" for line in lines)


def write_report(rows: DataFrame, path: str, order: Sequence[str], title: str) -> None:
    """A report as JSON lines and as Markdown below path; an existing one is not overwritten. Spark writes both, so path
    may be in any store that Spark writes."""
    rows.orderBy(*order).coalesce(1).write.mode("errorifexists").json(f"{path}/json")
    text = f"# {title}\n\n{markdown(rows, order)}"
    rows.sparkSession.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("errorifexists").option("lineSep", "\n").text(f"{path}/markdown")
