"""Queries: means, percentiles, group signals, resampling, roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import ranks, stats
from plumbline.plans.registry import register, table


@register(
    """SELECT c_mktsegment, count(*) AS n, round(avg(m), 4) AS mean_value FROM (
    SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey) JOIN customer ON c_custkey = o_custkey
    GROUP BY c_mktsegment"""
)
def two_level_mean(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = stats.two_level_mean(rows, ["c_mktsegment"], ["o_custkey"], F.col("o_totalprice"), "mean_value")
    return out.withColumn("mean_value", F.round("mean_value", 4))


@register("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS advantage FROM lineitem""")
def group_relative_advantage(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return stats.advantages(rows, ["l_orderkey"], "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("advantage", 6).alias("advantage"))


@register(
    """WITH e AS (SELECT event_type, user_id, CASE WHEN value > 50 THEN 1.0 WHEN event_id % 3 < 2 THEN 0.5 ELSE 0.0 END AS r FROM events),
    a AS (SELECT *, abs(r - avg(r) OVER (PARTITION BY event_type, user_id)) AS adv FROM e),
    g AS (SELECT event_type, user_id, count(*) AS n, min(r) AS lo, max(r) AS hi, stddev_pop(r) AS s, avg(adv) AS m FROM a GROUP BY ALL HAVING count(*) > 1)
    SELECT event_type, count(*) AS groups, array_to_string(list_sort(list(DISTINCT n)), ',') AS sizes, round(avg(CASE WHEN lo = hi AND lo < 1 AND hi > 0 THEN 1.0 ELSE 0 END), 6) AS same_partial, round(avg(CASE WHEN lo = hi AND lo >= 1 THEN 1.0 ELSE 0 END), 6) AS all_solved,
    round(avg(CASE WHEN lo = hi AND hi <= 0 THEN 1.0 ELSE 0 END), 6) AS all_zero, round(1 - avg(CASE WHEN lo = hi THEN 1.0 ELSE 0 END), 6) AS signal,
    round(avg(s), 6) AS mean_std, round(avg(m), 6) AS mean_abs_advantage FROM g GROUP BY event_type"""
)
def flat_group_signal(spark, d):
    rows = table(spark, d, "events").select("event_type", "user_id", F.when(F.col("value") > 50, 1.0).when(F.col("event_id") % 3 < 2, 0.5).otherwise(0.0).alias("r"))
    out = stats.group_signal(rows, ["event_type"], ["user_id"], "r")
    names = ["all_solved", "all_zero", "same_partial", "signal", "mean_std", "mean_abs_advantage"]
    return out.select("event_type", "groups", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"), *(F.round(n, 6).alias(n) for n in names))


@register(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice - (l_quantity / greatest(max(l_quantity) OVER w, 1) + l_tax / greatest(max(l_tax) OVER w, 1)) / 2 AS x
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x - avg(x) OVER (PARTITION BY l_orderkey) + 1e-9, 6) AS advantage FROM s"""
)
def length_penalised_advantage(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_tax")
    out = stats.length_penalised(rows, ["l_orderkey"], "l_extendedprice", "l_quantity", "l_tax")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("advantage") + 1e-9, 6).alias("advantage"))


@register(
    """SELECT event_type, round(sum(h) / sum(n), 6) AS all_pass, round(avg(CASE WHEN h > 0 THEN 1.0 ELSE 0 END), 6) AS pass_at_k
    FROM (SELECT event_type, user_id, count(*) FILTER (WHERE value > 80) AS h, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type"""
)
def pass_at_k(spark, d):
    out = stats.pass_at_k(table(spark, d, "events"), ["event_type"], ["user_id"], F.col("value") > 80)
    return out.select("event_type", F.round("all_pass", 6).alias("all_pass"), F.round("pass_at_k", 6).alias("pass_at_k"))


@register(
    """SELECT l_returnflag, l_extendedprice AS p90 FROM (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r,
    count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL) WHERE r = least(n, CAST(floor(n * 0.9::DOUBLE) AS BIGINT) + 1)"""
)
def index_percentile(spark, d):
    return ranks.index_percentile_by(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9, "p90")


@register("SELECT lang, median(n_chars) AS median_chars, count(n_chars) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY lang")
def median_by_group(spark, d):
    return ranks.median_by(table(spark, d, "documents"), ["lang"], "n_chars", "median_chars")


CLUSTERS = "SELECT c_mktsegment, o_custkey, avg(o_totalprice) AS m FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL"
DRAWS = """c AS (SELECT c_mktsegment, m, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_custkey) - 1 AS idx FROM k),
    n AS (SELECT c_mktsegment, count(*) AS n FROM k GROUP BY ALL),
    p AS (SELECT c_mktsegment, n, draw, unnest(range({size})) AS pick FROM n, (SELECT unnest(range({draws})) AS draw)),
    x AS (SELECT c_mktsegment, draw, ('0x' || substr(md5(concat_ws('|', {seed}, draw, pick)), 1, 8))::BIGINT % n AS idx FROM p),
    b AS (SELECT c_mktsegment, draw, avg(m) AS mean FROM x JOIN c USING (c_mktsegment, idx) GROUP BY ALL)"""


def segment_clusters(spark, d):
    """Means of customers; those without a segment meet no pick in SQL."""
    customers = table(spark, d, "customer").filter("c_mktsegment is not null")
    rows = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment", "o_custkey").agg(F.avg("o_totalprice").alias("m"))


@register(
    f"""WITH k AS ({CLUSTERS}), {DRAWS.format(size="n", draws=100, seed=20261001)}
    SELECT c_mktsegment, round(list_sort(list(mean))[3], 4) AS low, round(list_sort(list(mean))[97], 4) AS high FROM b GROUP BY ALL"""
)
def cluster_bootstrap_ci(spark, d):
    draws = stats.cluster_draws(segment_clusters(spark, d), ["c_mktsegment"], "o_custkey", "m", 100, 20261001)
    out = stats.interval(draws, ["c_mktsegment"], 100)
    return out.select("c_mktsegment", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@register(
    f"""WITH k AS ({CLUSTERS}), {DRAWS.format(size="n", draws=100, seed=20261004)},
    d AS (SELECT a.c_mktsegment AS left_segment, z.c_mktsegment AS right_segment, draw, a.mean - z.mean AS diff FROM b a JOIN b z USING (draw) WHERE a.c_mktsegment < z.c_mktsegment)
    SELECT left_segment, right_segment, round(list_sort(list(diff))[3], 4) AS low, round(list_sort(list(diff))[97], 4) AS high FROM d GROUP BY ALL"""
)
def two_sample_bootstrap(spark, d):
    draws = stats.cluster_draws(segment_clusters(spark, d), ["c_mktsegment"], "o_custkey", "m", 100, 20261004)
    each = draws.groupBy("draw").agg(F.collect_list(F.struct("c_mktsegment", "mean")).alias("all"))  # a row per segment
    pairs = each.select("draw", "all", F.explode("all").alias("a")).select("draw", "a", F.explode("all").alias("z"))
    diff = pairs.select(F.col("a.c_mktsegment").alias("left_segment"), F.col("z.c_mktsegment").alias("right_segment"), (F.col("a.mean") - F.col("z.mean")).alias("mean")).filter("left_segment < right_segment")
    out = stats.interval(diff, ["left_segment", "right_segment"], 100)
    return out.select("left_segment", "right_segment", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@register(
    f"""WITH k AS ({CLUSTERS}), {DRAWS.format(size="15", draws=200, seed=7)}
    SELECT c_mktsegment, round(list_sort(list(mean))[6], 4) AS low, round(list_sort(list(mean))[195], 4) AS high FROM b GROUP BY ALL"""
)
def predictive_interval(spark, d):
    draws = stats.cluster_draws(segment_clusters(spark, d), ["c_mktsegment"], "o_custkey", "m", 200, 7, size=15)
    out = stats.interval(draws, ["c_mktsegment"], 200)
    return out.select("c_mktsegment", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@register()
def cluster_bootstrap_parity(spark, d):
    nations = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    clusters = nations.groupBy("c_mktsegment", "c_nationkey").agg(F.avg("o_totalprice").alias("m")).groupBy("c_mktsegment", "c_nationkey").agg(F.collect_list("m").alias("values"))
    return stats.seeded_interval(clusters, ["c_mktsegment"], "c_nationkey", "values", draws=2000)


@register(
    """SELECT coalesce(o_orderstatus, 'All') AS status, coalesce(o_orderpriority, 'All') AS priority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price
    FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"""
)
def rollup_tier_all(spark, d):
    rows = table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    return rows.select(F.coalesce("o_orderstatus", F.lit("All")).alias("status"), F.coalesce("o_orderpriority", F.lit("All")).alias("priority"), "n", "mean_price")


@register(
    """WITH s AS (SELECT unnest(CASE WHEN value > 50 THEN ['all', 'effective'] ELSE ['all'] END) AS subset, event_type, value FROM events)
    SELECT subset, coalesce(event_type, 'agg') AS env, count(*) AS n, round(avg(value), 6) AS mean_value FROM s GROUP BY GROUPING SETS ((subset), (subset, event_type))"""
)
def metric_matrix_sets(spark, d):
    rows = table(spark, d, "events").select(F.explode(F.when(F.col("value") > 50, F.array(F.lit("all"), F.lit("effective"))).otherwise(F.array(F.lit("all")))).alias("subset"), "event_type", "value")
    out = rows.groupingSets([["subset"], ["subset", "event_type"]], "subset", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return out.select("subset", F.coalesce("event_type", F.lit("agg")).alias("env"), "n", "mean_value")


TYPES = ["click", "view", "purchase", "signup", "logout", "error"]


@register("SELECT user_id % 10 AS bucket, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY ALL")
def label_pivot(spark, d):
    rows = table(spark, d, "events").withColumn("bucket", F.col("user_id") % 10)
    return rows.groupBy("bucket").agg(*(F.count_if(F.col("event_type") == t).alias(t) for t in TYPES))


@register(
    """WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT event_type, sum(n) AS total FROM c GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (ORDER BY total DESC, event_type) AS r FROM t),
    u AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS m FROM c)
    SELECT event_type, CAST(total AS BIGINT) AS total, string_agg(user_id::VARCHAR, ',' ORDER BY m) AS top_users FROM k JOIN u USING (event_type) WHERE r <= 3 AND m <= 3 GROUP BY ALL"""
)
def top_k_with_top_m(spark, d):
    counts = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    kinds = counts.groupBy("event_type").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "event_type").limit(3)
    ranked = counts.withColumn("m", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))).filter("m <= 3")
    rows = ranked.join(kinds, "event_type").groupBy("event_type", "total").agg(F.array_sort(F.collect_list(F.struct("m", "user_id"))).alias("u"))
    return rows.select("event_type", "total", F.array_join(F.transform("u", lambda x: x["user_id"].cast("string")), ",").alias("top_users"))


GROUPS = {"click": "use", "view": "use", "purchase": "outcome", "signup": "outcome"}


@register(
    """SELECT g, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (
    SELECT CASE event_type WHEN 'click' THEN 'use' WHEN 'view' THEN 'use' WHEN 'purchase' THEN 'outcome' WHEN 'signup' THEN 'outcome' ELSE 'other' END AS g FROM events) GROUP BY g"""
)
def failure_group_share(spark, d):
    events = table(spark, d, "events")
    mapping = spark.createDataFrame(list(GROUPS.items()), "event_type string, g string")
    counts = events.groupBy("event_type").agg(F.count("*").alias("n")).join(mapping, "event_type", "left").groupBy(F.coalesce("g", F.lit("other")).alias("g")).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("g", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@register("SELECT CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def histogram_bins(spark, d):
    return table(spark, d, "events").filter("value is not null").groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"))


PHASES = [("early", "1992-01-01", "1994-12-31"), ("middle", "1994-01-01", "1996-12-31"), ("all", "1992-01-01", "1998-12-31")]
PHASE_SQL = "(VALUES " + ", ".join(f"('{p}', DATE '{a}', DATE '{b}')" for p, a, b in PHASES) + ") AS p(phase, lo, hi)"


def in_phases(spark, d):
    phases = spark.createDataFrame(PHASES, "phase string, lo string, hi string").select("phase", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").join(F.broadcast(phases), (day >= F.col("lo")) & (day <= F.col("hi")))  # three rows


@register(f"SELECT phase, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN {PHASE_SQL} ON o_orderdate::DATE BETWEEN lo AND hi GROUP BY ALL")
def phase_rollup(spark, d):
    return in_phases(spark, d).groupBy("phase").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_discount, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY ALL")
def weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("weighted_discount"), F.round(F.avg("l_discount"), 6).alias("mean_discount")
    )


@register(
    f"""WITH f AS (SELECT phase, o_totalprice - avg(o_totalprice) OVER (PARTITION BY phase) AS e FROM orders JOIN {PHASE_SQL} ON o_orderdate::DATE BETWEEN lo AND hi)
    SELECT phase, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(min(e), 4) AS low, round(max(e), 4) AS high FROM f GROUP BY ALL"""
)
def forecast_error(spark, d):
    rows = in_phases(spark, d)
    means = rows.groupBy("phase").agg(F.avg("o_totalprice").alias("m"))
    e = rows.join(F.broadcast(means), "phase").withColumn("e", F.col("o_totalprice") - F.col("m"))  # three rows
    return e.groupBy("phase").agg(F.round(F.avg(F.abs("e")), 4).alias("mae"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 4).alias("rmse"), F.round(F.min("e"), 4).alias("low"), F.round(F.max("e"), 4).alias("high"))


@register(
    """SELECT d.lang, count(*) AS labelled, round(avg(quality), 6) AS quality_rate, round(avg(toxic), 6) AS toxic_rate, count(DISTINCT quality) AS qualities
    FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang"""
)
def rates_by_group(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("labelled"), F.round(F.avg("quality"), 6).alias("quality_rate"), F.round(F.avg("toxic"), 6).alias("toxic_rate"), F.count_distinct("quality").alias("qualities"))


@register("SELECT user_id, event_type AS top_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r = 1")
def most_common_label(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = counts.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("top_type"), (-F.col("b.n")).alias("n"))


@register(
    """WITH s AS (SELECT l_shipmode_key AS k, c FROM (SELECT l_linenumber AS l_shipmode_key, sum(l_quantity) AS c FROM lineitem GROUP BY ALL))
    SELECT k, round(c / sum(c) OVER (), 6) AS share, round(sum(c) OVER (ORDER BY k), 2) AS running FROM s"""
)
def running_share(spark, d):
    sums = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("c"))
    return sums.select("k", F.round(F.col("c") / F.sum("c").over(Window.partitionBy()), 6).alias("share"), F.round(F.sum("c").over(Window.orderBy("k")), 2).alias("running"))  # a row per line number
