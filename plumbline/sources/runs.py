"""Sources and sinks of run logs: JSONL files that mix metadata, answers and end records."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import degenerate
from plumbline.operators.selection import Refused

ANSWER = """tier string, spec_id string, rollout int, seed int, reward double, built boolean, error string, api_error string,
checks map<string,boolean>, gates_passed boolean, timeout boolean, finish_reason string, truncated boolean, degenerate boolean,
retries int, cost_usd double, cost_source string, provider string, served_model string, completion_chars int, gen_seconds double,
prompt string, completion string, usage struct<completion_tokens:long>,
attempts array<struct<completion:string,error:string,reward:double,cost_usd:double,finish_reason:string>>, previous_reward double"""
META = """run_id string, provider string, model string, temperature double, max_tokens int, base_seed int, rollouts int, split string,
sample_seed long, scorer_version string, package_version string, git_commit string, planned struct<tiers:array<string>,spec_ids:array<string>,rollouts:int,total:int>,
system_prompt string, arm string, feedback_retries int, system_prompt_sha256 string, budget_usd double, rescored_from_version string,
test_split struct<seed:long,sha256:string>, hints_source string, extra_body string"""
END = "status string, written int, planned int, spent_usd double, unknown_cost_calls int, truncated int, degenerate int"


#: Parts of a run that `write_run` lays down, one folder each.
PARTS = ("meta", "answers", "end")


@dataclass
class Runs:
    """metas and ends have one row per run."""

    metas: DataFrame
    answers: DataFrame
    ends: DataFrame


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, at, line, keys) of every line that isn't blank; at orders the lines of a file.

    A file is read in blocks; within one, Spark numbers the lines in their order. A run that was written in parts counts
    as one file, of which the metadata come first and the end last.
    """
    part = F.regexp_extract("_metadata.file_path", f"/part=({'|'.join(PARTS)})/[^/]+$", 1)
    raw = spark.read.option("recursiveFileLookup", True).text(paths).select(
        F.regexp_replace("_metadata.file_path", f"/part=({'|'.join(PARTS)})/[^/]+$", "").alias("file"),
        F.struct(F.when(part == "end", 2).when(part == "answers", 1).otherwise(0).alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
        F.col("value").alias("line"),
    )
    return raw.filter("trim(line) <> ''").withColumn("keys", F.json_object_keys("line"))


def scan(spark: SparkSession, paths: str | Sequence[str], last: bool = False) -> Runs:
    """Runs by the keys that each line has: metadata, end records and answers; blank lines are skipped.

    Answers belong to the run that they name, or else to that of the metadata before them in their file; an end belongs
    to the metadata before it, and the last one of a run counts. A run id that two metadata lines have is refused, since
    its answers would be counted twice. With `last`, a file is one run whatever it says: its last metadata and its last
    end count, and all of its answers.
    """
    keys = lines(spark, paths)
    has = lambda k: F.coalesce(F.array_contains("keys", k), F.lit(False))
    metas = keys.filter(has("meta")).select("file", "at", F.from_json(F.get_json_object("line", "$.meta"), META).alias("m"))
    if last:
        metas = metas.groupBy("file").agg(F.max_by("m", "at").alias("m")).select("file", "m.*", F.lit(None).alias("_from"), F.lit(None).alias("_to"))
    else:
        metas = metas.select("file", "m.*", F.col("at").alias("_from"), F.lead("at").over(Window.partitionBy("file").orderBy("at")).alias("_to"))
        twice = metas.groupBy("run_id").agg(F.count("*").alias("n")).filter("n > 1").limit(3).collect()
        if twice:
            raise Refused(f"run ids in several files or lines: {', '.join(str(r['run_id']) for r in twice)}")
    of = metas.select(F.col("file").alias("_file"), F.col("run_id").alias("_run"), F.col("max_tokens").alias("run_max_tokens"), "_from", "_to")
    here = F.col("file") == F.col("_file")
    if not last:
        here &= (F.col("at") > F.col("_from")) & (F.col("_to").isNull() | (F.col("at") < F.col("_to")))
    answers = keys.filter(has("tier") & ~has("meta") & ~has("end")).select("file", "at", "keys", F.from_json("line", f"run_id string, {ANSWER}").alias("a"))
    answers = answers.select("file", "at", F.col("keys").alias("present"), "a.*").join(of, here, "left")
    owner = F.col("_run") if last else F.coalesce("run_id", "_run")
    answers = answers.withColumn("run_id", owner).drop("_file", "_run", "_from", "_to", "at")
    if not last:  # an answer that names another run has that run's limits
        limits = metas.select("run_id", F.col("max_tokens").alias("_limit"))
        answers = answers.join(limits, "run_id", "left").withColumn("run_max_tokens", F.coalesce("_limit", "run_max_tokens")).drop("_limit")
    ends = keys.filter(has("end") & ~has("meta")).select("file", "at", F.from_json(F.get_json_object("line", "$.end"), END).alias("e")).join(of, here)
    ends = ends.groupBy(F.col("_run").alias("run_id")).agg(F.max_by(F.struct("file", "e"), "at").alias("l")).select("run_id", "l.file", "l.e.*")
    return Runs(with_defaults(metas.drop("_from", "_to")), normalised(answers), ends)


def with_defaults(metas: DataFrame) -> DataFrame:
    """Missing arm and split get their defaults; label is the model, with the arm if it isn't the first shot."""
    arm = F.coalesce("arm", F.lit("first-shot"))
    return metas.withColumns({"arm": arm, "split": F.coalesce("split", F.lit("eval")), "label": F.when(arm == "first-shot", F.col("model")).otherwise(F.concat("model", F.lit(" ["), arm, F.lit("]")))})


def normalised(answers: DataFrame) -> DataFrame:
    """Fields that older logs lack, from those that they have. A key that is present with null isn't a missing key."""
    has = lambda k: F.array_contains("present", k)
    gates = F.map_filter("checks", lambda k, v: ~k.rlike("^R[0-9]"))
    cut = F.when(has("finish_reason"), F.coalesce("truncated", F.lit(False))).otherwise(F.coalesce(F.col("usage.completion_tokens") >= F.col("run_max_tokens"), F.lit(False)))
    loop = F.when(has("degenerate"), F.coalesce("degenerate", F.lit(False))).otherwise(degenerate(F.col("completion")))
    ok = F.when(has("gates_passed"), F.coalesce("gates_passed", F.lit(False))).otherwise(F.coalesce((F.size(gates) > 0) & F.forall(F.map_values(gates), lambda x: x), F.lit(False)))
    out = answers.withColumns({"rollout": F.coalesce("rollout", F.lit(0)), "timeout": F.coalesce("timeout", F.lit(False)), "truncated": cut, "degenerate": loop, "gates_passed": ok})
    return out.withColumns({"is_loop": F.col("truncated") & F.col("degenerate"), "cut_off": F.col("truncated") & ~F.col("degenerate")}).drop("present")


def write_run(meta: dict, answers: DataFrame, path: str, status: str = "complete") -> None:
    """A run as text below path: its metadata, its answers, and, whatever happens to them, an end record.

    A run that exists is never overwritten. Tasks commit their answers together, so a failed job leaves none and the end
    says "interrupted"; where the driver is killed there is no end, and readers find the run interrupted or running.
    """
    spark = answers.sparkSession
    line = lambda **x: spark.createDataFrame([(json.dumps(x),)], "value string").coalesce(1).write.mode("errorifexists")
    line(meta=meta).text(f"{path}/part=meta")
    said = "interrupted"
    try:
        answers.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(f"{path}/part=answers")
        said = status
    finally:
        line(end={"status": said, **(totals(spark, path) if said == status else {"written": 0})}).text(f"{path}/part=end")


def totals(spark: SparkSession, path: str) -> dict:
    """What an end record says of the answers that were written."""
    rows = spark.read.text(f"{path}/part=answers").select(F.from_json("value", "cost_usd double, api_error string, truncated boolean, degenerate boolean").alias("a")).select("a.*")
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    row = rows.agg(
        F.count("*").alias("written"), F.coalesce(F.round(F.sum("cost_usd"), 6), F.lit(0.0)).alias("spent_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost_calls"), flag(F.col("truncated")).alias("truncated"), flag(F.col("degenerate")).alias("degenerate"),
    ).first()
    return row.asDict()


def rescored(answers: DataFrame, scores: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Answers with new rewards; those without a score (unknown specs) stay as they are, told by `known`."""
    new = scores.select(*keys, F.col("reward").alias("_new"))
    joined = answers.join(new, list(keys), "left").withColumn("known", F.col("_new").isNotNull())
    return joined.withColumns({"previous_reward": F.when(F.col("known"), F.col("reward")).otherwise(F.col("previous_reward")), "reward": F.coalesce("_new", "reward"), "scorer_version": F.lit(version)}).drop("_new")


def write_rescored(answers: DataFrame, path: str, force: bool = False) -> None:
    """By scorer version; what exists is skipped unless forced."""
    answers.write.partitionBy("scorer_version").mode("overwrite" if force else "ignore").parquet(path)


def histograms(spark: SparkSession, path: str) -> DataFrame:
    """(file, metric, low, high, count, corrupt): step distributions, tolerant of files that hold an error text."""
    schema = "bins struct<rewards:array<struct<bin:string,count:int>>,advantages:array<struct<bin:string,count:int>>>, _corrupt_record string"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("file", F.col("_metadata.file_path"))
    raw = raw.withColumn("corrupt", F.col("_corrupt_record").isNotNull() | F.col("bins").isNull())
    sides = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"bins.{m}").alias("b")) for m in ("rewards", "advantages")))
    rows = raw.select("file", "corrupt", F.explode(sides).alias("s")).select("file", "corrupt", "s.metric", F.explode_outer("s.b").alias("b"))
    bound = lambda i: F.try_to_number(F.nullif(F.regexp_extract("b.bin", r"^(-?[0-9.]+)-(-?[0-9.]+)$", i), F.lit("")), F.lit("S9999999.999999")).cast("double")
    return rows.select("file", "metric", bound(1).alias("low"), bound(2).alias("high"), F.col("b.count").alias("count"), "corrupt")


def verify_manifest(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """manifest (file, sha256) with `state`: as stored, CRLF (equal after line ends are made CRLF), mismatch or missing.

    file is the path below root.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    name = F.substring_index("path", f"{top}/", -1)
    crlf = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "\r\n", "\n"), "\n", "\r\n")
    hashes = files.select(name.alias("file"), F.sha2("content", 256).alias("stored"), F.sha2(F.encode(crlf, "UTF-8"), 256).alias("crlf"))
    state = F.when(F.col("stored").isNull(), "missing").when(F.col("stored") == F.col("sha256"), "as stored").when(F.col("crlf") == F.col("sha256"), "CRLF").otherwise("mismatch")
    return manifest.join(hashes, "file", "left").withColumn("state", state).drop("stored", "crlf")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Models of a saved price list that can be used: text only, priced (one of both prices may be 0), no free, batch or
    hidden variants. Prices that are no numbers, or negative as of routers, leave a model out; a missing one is 0."""
    schema = "data array<struct<id:string,context_length:long,architecture:struct<output_modalities:array<string>>,pricing:struct<prompt:string,completion:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("data").alias("d")).select("d.*")
    price = lambda c: F.coalesce(F.col(f"pricing.{c}"), F.lit("0")).try_cast("double") * 1e6
    rows = rows.withColumns({"input_per_mtok": price("prompt"), "output_per_mtok": price("completion")})
    out = F.col("architecture.output_modalities")
    text_only = F.coalesce(F.size(out) <= 0, F.lit(True)) | F.forall(out, lambda x: x == "text")
    hidden = F.col("id").rlike(":(free|batch)$") | F.col("id").startswith("~")
    p, q = F.col("input_per_mtok"), F.col("output_per_mtok")
    return rows.filter(F.coalesce(text_only, F.lit(True)) & ~hidden & (p >= 0) & (q >= 0) & (p + q > 0)).select("id", "context_length", "input_per_mtok", "output_per_mtok")



def broken_links(spark: SparkSession, root: str) -> DataFrame:
    """(file, link) of relative Markdown links whose target isn't below root."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root).select(F.col("_metadata.file_path").alias("file"), "value")
    links = texts.select("file", F.explode(F.regexp_extract_all("value", F.lit(r"\]\(([^)#\s]+)(?:#[^)]*)?\)"), F.lit(1))).alias("link")).filter(~F.col("link").rlike("^[a-z]+:"))
    base = F.regexp_replace("file", "[^/]+$", "")
    joined = links.withColumn("path", F.concat(base, F.regexp_replace("link", r"^\./", "")))
    # "a/../" falls out, as often as links go up.
    for _ in range(8):
        joined = joined.withColumn("path", F.regexp_replace("path", r"/[^/]+/\.\./", "/"))
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return joined.join(there, "path", "left_anti").select("file", "link")


def slug(model: Column) -> Column:
    return F.regexp_replace(F.lower(model), "[^a-z0-9]+", "-")


def safe_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "-", text)
