"""Queries: arms side by side, replication counts, scorer agreement, training logs, small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import numbers
from plumbline.operators import arms, guards, replication, reports, training, validation
from plumbline.plans.registry import register, table

HIGH = ("1-URGENT", "2-HIGH")


def outcomes(spark, d):
    """Orders as outcomes: the customer is the spec, the priority the tier, a high price a pass."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("spec_id"), F.col("o_orderpriority").alias("tier"), (F.col("o_totalprice") > 100000).cast("int").alias("passed"), "o_orderdate")


@register(
    """WITH o AS (SELECT o_custkey, CASE WHEN year(o_orderdate) < 1998 THEN 'original' ELSE 'replication' END AS experiment, o_totalprice > 100000 AS p FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')), s AS (SELECT experiment, o_custkey, bool_and(p) AS a FROM o GROUP BY ALL)
    SELECT coalesce(experiment, 'pooled') AS experiment, count_if(a)::BIGINT AS passes, count(*) AS specs FROM s GROUP BY GROUPING SETS ((experiment), ())"""
)
def both_pass_pooled(spark, d):
    rows, early = outcomes(spark, d), F.year("o_orderdate") < 1998
    return replication.pooled({"original": rows.filter(early), "replication": rows.filter(~early)}, HIGH).drop("lower")


@register("SELECT n, count(*) AS clusters FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def counts_of_counts(spark, d):
    return replication.counts_of_counts(table(spark, d, "orders"), "o_custkey")


@register(
    """SELECT c_mktsegment AS model, """
    + ", ".join(f"avg(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0 ELSE 0 END) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}_high\", avg(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0 END) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}_low\"" for s in "FOP")
    + """ FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"""
)
def arms_side_by_side(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("model"))
    rows = table(spark, d, "orders").join(customers, "o_custkey").select("model", F.col("o_orderstatus").alias("arm"), F.col("o_orderpriority").alias("label"))
    return arms.side_by_side(rows, {"high": HIGH, "low": ["5-LOW"]}, ("F", "O", "P"))


RATES = """count_if(toxic = 1)::BIGINT AS wrong, count_if(toxic <> 1)::BIGINT AS "right", count_if(toxic = 1 AND quality = 1)::BIGINT AS false_credit,
    count_if(toxic <> 1 AND quality <> 1)::BIGINT AS false_rejection, count_if((quality = 1) = (toxic <> 1))::BIGINT AS agreed, count(*) AS n,
    count_if(toxic = 1 AND quality = 1) / greatest(count_if(toxic = 1), 1) AS false_credit_rate, count_if(toxic <> 1 AND quality <> 1) / greatest(count_if(toxic <> 1), 1) AS false_rejection_rate,
    count_if((quality = 1) = (toxic <> 1)) / greatest(count(*), 1) AS agreement_rate"""


def judged(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")


@register(f"SELECT source, {RATES} FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def credit_rates(spark, d):
    wrong, credited = F.col("toxic") == 1, F.col("quality") == 1
    return validation.credit_rates(judged(spark, d), wrong, credited, credited == ~wrong, ["source"])


@register("SELECT source, (quality = 1) = (toxic <> 1) AS agree, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def agreement_by_family(spark, d):
    return validation.by_family(judged(spark, d), "source", (F.col("quality") == 1) == (F.col("toxic") != 1))


@register(
    """SELECT count_if(quality = 1 AND n_chars >= 200)::BIGINT AS pass_nominal, count_if(quality = 1 AND n_chars < 200)::BIGINT AS pass_not_nominal, count_if(quality <> 1 AND n_chars >= 200)::BIGINT AS failure_nominal,
    count_if(quality <> 1 AND n_chars < 200)::BIGINT AS failure_not_nominal FROM labels JOIN documents USING (doc_id)"""
)
def verdict_quadrants(spark, d):
    scores = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"))
    return validation.quadrants(scores, table(spark, d, "documents").select("doc_id", (F.col("n_chars") >= 200).alias("nominal")), ["doc_id"])


@register(
    """WITH u AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 10 ELSE 1 END AS size FROM events),
    t AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS total FROM u), w AS (SELECT *, total // 50 AS windows FROM t),
    l AS (SELECT *, coalesce(lag(windows) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS b FROM w) SELECT user_id, event_id, total, windows FROM l WHERE windows > b"""
)
def zero_output_warnings(spark, d):
    units = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", 10).otherwise(1).alias("size"))
    return training.zero_output_warnings(units, ["user_id"], ["event_id"], "size", 50)


@register(
    """WITH s AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity = 50),
    g AS (SELECT *, o_orderkey NOT IN (SELECT l_orderkey FROM s) AND o_orderkey NOT IN (SELECT l_orderkey FROM b) AS gone FROM orders),
    c AS (SELECT o_orderpriority, count(*) AS attempts, count_if(gone) AS discarded, count_if(gone AND o_orderstatus = 'P') AS stale, count_if(gone AND o_orderstatus = 'O') AS errored FROM g GROUP BY 1)
    SELECT o_orderpriority, attempts, discarded::BIGINT AS discarded, stale::BIGINT AS stale, errored::BIGINT AS errored, (discarded - stale - errored)::BIGINT AS no_signal FROM c"""
)
def discard_accounting(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    episodes = orders.select("o_orderpriority", F.col("o_orderkey").alias("episode_id"), (F.col("o_orderstatus") == "P").alias("cancelled"), (F.col("o_orderstatus") == "O").alias("failed"))
    ids = episodes.select("o_orderpriority", "episode_id")
    of = lambda where: ids.join(lines.filter(where).select(F.col("l_orderkey").alias("episode_id")).distinct(), "episode_id").select("o_orderpriority", "episode_id")
    none = episodes.select("o_orderpriority").distinct().select("o_orderpriority", *(F.lit(0).cast("long").alias(c) for c in ("failures", "cancelled_attempts", "stale_attempts")))
    return training.discards(episodes, of("l_returnflag = 'R'"), of("l_quantity = 50"), none, ["o_orderpriority"])


@register(
    """SELECT CASE WHEN l_discount * 10 <= 0.25 THEN 'hard' WHEN l_discount * 10 <= 0.75 THEN 'normal' WHEN l_discount * 10 <= 1.0 THEN 'easy' END AS pool, count(*) AS n FROM lineitem GROUP BY 1"""
)
def difficulty_pools(spark, d):
    return table(spark, d, "lineitem").groupBy(training.pool_of(F.col("l_discount") * 10).alias("pool")).agg(F.count("*").alias("n"))


@register(
    """SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7|' || o_orderkey)) AS r FROM orders)
    WHERE r <= CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 50 WHEN '3-MEDIUM' THEN 50 END"""
)
def weighted_source_mix(spark, d):
    shares = {"1-URGENT": 0.5, "2-HIGH": 0.25, "3-MEDIUM": 0.25}
    return training.mixed(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", shares, 200, F.col("o_orderkey"), 7)


@register(
    """WITH o AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'N' AS mask, l_discount AS a, CASE WHEN l_returnflag <> 'N' AND l_discount = 0 THEN 0.0 WHEN l_returnflag <> 'N' THEN 1.0 ELSE 0.0 END AS w FROM lineitem)
    SELECT l_orderkey, sum(w) AS weight, NOT bool_or(mask AND a = 0) OR bool_or(mask AND w <> 0) AS trainable FROM o GROUP BY 1"""
)
def pruned_advantages(spark, d):
    token = F.struct("l_linenumber", (F.col("l_returnflag") != "N").alias("mask"), F.col("l_discount").alias("advantage"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(token)).alias("t"))  # an order's lines
    none = F.lit(None).cast("array<double>")
    given = F.transform("t", lambda t: F.when(t["mask"], 1.0).otherwise(0.0))
    samples = rows.select("l_orderkey", F.col("t.mask").alias("mask"), F.col("t.advantage").alias("advantages"), given.alias("rl_weights"), none.alias("ce_weights"), none.alias("ref_kl_weights"))
    return training.pruned(samples).select("l_orderkey", F.aggregate("rl_weights", F.lit(0.0), lambda a, b: a + b).alias("weight"), "trainable")


@register("SELECT event_type, count(*) AS n, avg(coalesce(value, 0)) AS mean, min(coalesce(value, 0)) AS low, max(coalesce(value, 0)) AS high, count_if(coalesce(value, 0) = 0)::BIGINT AS zeros, count(DISTINCT round(coalesce(value, 0), 3)) AS \"values\" FROM events GROUP BY 1")
def spread_report(spark, d):
    return reports.spread(table(spark, d, "events").withColumnRenamed("value", "reward"), ["event_type"])


@register("SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem WHERE l_quantity > 10 AND l_returnflag <> 'N') WHERE r <= CASE l_returnflag WHEN 'R' THEN 4 ELSE 12 END")
def first_passing_rows(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return reports.first_passing(rows, "l_returnflag", {"R": 4, "A": 12}, F.col("l_quantity") > 10, ["l_orderkey", "l_linenumber"]).drop("l_quantity")


@register("SELECT p_partkey AS model, 60 * (500 * p_retailprice + p_size * 2.0) AS cost FROM part ORDER BY 2, 1 LIMIT 10")
def cheapest_models(spark, d):
    models = table(spark, d, "part").select(F.col("p_partkey").alias("model"), F.col("p_retailprice").alias("input_price"), F.lit(2.0).alias("output_price"), "p_size")
    return reports.cheapest(models, 60, 500, F.col("p_size"), 10)


@register("SELECT source, avg(length(text)) / 3.6 + 70 AS tokens FROM documents GROUP BY 1")
def prompt_token_estimate(spark, d):
    return reports.prompt_tokens(table(spark, d, "documents"), "text", ["source"])


@register("SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NULL THEN a.name ELSE b.name END AS name FROM (SELECT c_nationkey AS k, min(c_name) AS name FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, min(s_name) AS name FROM supplier GROUP BY 1) b ON a.k = b.k")
def later_wins_union(spark, d):
    of = lambda t, p: table(spark, d, t).groupBy(F.col(f"{p}_nationkey").alias("k")).agg(F.min(f"{p}_name").alias("name"))
    return reports.later_wins([of("customer", "c"), of("supplier", "s")], ["k"])


@register("SELECT l_returnflag, l_linestatus, gate, count_if(gate = l_linestatus AND l_quantity > 25 AND l_tax > 0.04) / greatest(count_if(l_tax > 0.04), 1) AS fail_rate FROM lineitem, (SELECT unnest(['O', 'F']) AS gate) GROUP BY ALL")
def gate_failures(spark, d):
    """Each answer has one of both gates; the other one is never known to fail."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.create_map("l_linestatus", F.col("l_quantity") <= 25).alias("checks"), (F.col("l_tax") > 0.04).alias("built"))
    return reports.gate_failures(rows, ["l_returnflag", "l_linestatus"], ["O", "F"], F.col("built"))


@register(
    """WITH c AS (SELECT event_type, count(*) AS n, count_if(value < 50)::BIGINT AS caught, count_if(value < 25)::BIGINT AS expected_failed FROM events GROUP BY 1)
    SELECT event_type, n, caught, expected_failed, CASE WHEN expected_failed > 0 THEN array_to_string(list_sort([event_type || '=' || expected_failed, 'low=' || expected_failed]), ',') ELSE '' END AS failed FROM c"""
)
def sensitivity(spark, d):
    low = F.when(F.col("value") < 25, F.array(F.lit("low"), F.col("event_type"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "events").select("event_type", (F.col("value") >= 50).cast("int").alias("reward"), low.alias("failed"))
    return validation.sensitivity(rows, ["event_type"], F.col("reward"), F.lit("low"), "failed").withColumn("failed", F.array_join(F.array_sort(F.transform(F.map_entries("failed"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ","))


@register("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS run_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS started, greatest(round_even(value * 2, 0) / 2, 0.5) AS snapped FROM events")
def run_stamps(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", numbers.run_id(ts).alias("run_id"), numbers.iso(ts).alias("started"), numbers.snapped(F.col("value")).alias("snapped"))


@register(
    """SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'kind' WHEN grouping(o_orderpriority) = 1 THEN 'model' ELSE 'model and tier' END AS grain, c_mktsegment AS model, o_orderpriority AS tier, o_orderstatus AS label, count(*) AS n
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY GROUPING SETS ((c_mktsegment, o_orderstatus), (c_mktsegment, o_orderpriority, o_orderstatus), (o_orderstatus))"""
)
def label_counts(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("model"))
    rows = table(spark, d, "orders").join(customers, "o_custkey").select("model", F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("label"))
    return reports.label_counts(rows)


@register(
    """SELECT l_returnflag, name, value, count(*) AS n FROM (SELECT l_returnflag, unnest(['status', 'tax', 'large']) AS name, unnest([l_linestatus, (l_tax * 100)::INT::VARCHAR, CASE WHEN l_quantity > 25 THEN 'true' WHEN l_quantity > 5 THEN 'false' ELSE 'none' END]) AS value FROM lineitem) GROUP BY ALL"""
)
def value_counts(spark, d):
    large = F.when(F.col("l_quantity") > 25, True).when(F.col("l_quantity") > 5, False)
    return reports.value_counts(table(spark, d, "lineitem"), {"status": F.col("l_linestatus"), "tax": F.round(F.col("l_tax") * 100).cast("int"), "large": large}, ["l_returnflag"])


@register("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses, count(DISTINCT o_orderstatus) > 1 AS mixed FROM orders GROUP BY 1")
def mixed_versions(spark, d):
    out = reports.versions(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "statuses"), ["statuses"], ["o_custkey"])
    return out.withColumn("statuses", F.array_join("statuses", ","))


@register(
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus IN ('F', 'O') AND o_custkey % 50 = 0 THEN 'a model provider needs a model' END, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'hints and a prompt file exclude each other' END,
      CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 5 > 0 THEN 'the test split is locked' END, CASE WHEN (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND o_orderstatus <> 'P' THEN 'the arm does not allow a hint' END,
      CASE WHEN NOT (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND o_orderstatus = 'P' THEN 'the arm requires a hint' END], lambda x: x IS NOT NULL), '; ') AS problems FROM orders"""
)
def launch_guards(spark, d):
    """Orders as runs that are to be launched."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    runs = table(spark, d, "orders").select(
        "o_orderkey", F.when(status == "P", "baseline").otherwise("openai").alias("provider"), F.when(F.col("o_custkey") % 50 != 0, "m").alias("model"), F.when(F.col("o_orderpriority") == "1-URGENT", "test").otherwise("eval").alias("split"),
        (key % 5 == 0).alias("unlocked"), F.when(status == "P", "hint").otherwise("first-shot").alias("arm"), (key % 2 == 0).alias("hints"), F.when(key % 3 == 0, "file").alias("prompt_file"), F.lit(0).alias("retries"),
        F.lit(1.0).alias("price_in"), F.lit(2.0).alias("price_out"),
    )
    return guards.launch(runs).select("o_orderkey", F.array_join("problems", "; ").alias("problems"))
