"""Queries: latest clean rows, coverage, budgets, cuts, intervals, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import geometry, selection
from plumbline.plans.registry import register, table


@register(
    """SELECT o_custkey, o_orderkey, o_orderstatus, superseded FROM (SELECT o_custkey, o_orderkey, o_orderstatus,
    row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'F') DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) - 1 AS superseded FROM orders) WHERE r = 1"""
)
def latest_clean_row(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return selection.latest_clean(rows, ["o_custkey"], F.col("o_orderstatus") != "F", "o_orderkey")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@register(
    f"""WITH p AS (SELECT c_custkey AS custkey, unnest({list(PRIORITIES)}) AS priority FROM customer), q AS (SELECT DISTINCT o_custkey AS custkey, o_orderpriority AS priority FROM orders)
    SELECT *, 'missing' AS problem FROM (SELECT * FROM p EXCEPT SELECT * FROM q) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM q EXCEPT SELECT * FROM p)"""
)
def coverage_missing_extra(spark, d):
    """Every customer should have ordered at every priority."""
    planned = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.explode(F.array(*map(F.lit, PRIORITIES))).alias("priority"))
    seen = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"))
    return selection.coverage(planned, seen, ["custkey", "priority"])


@register(
    """SELECT DISTINCT p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 0
    INTERSECT SELECT DISTINCT p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 1"""
)
def param_tuple_disjoint(spark, d):
    keys = ["p_brand", "p_type", "p_size"]
    split = lambda k: table(spark, d, "part").filter(F.col("p_partkey") % 2 == k).select(*keys).distinct()
    return split(0).join(split(1), keys, "left_semi")


@register("SELECT doc_id, quality, toxic, lang FROM labels JOIN documents USING (doc_id)")
def must_match_left_join(spark, d):
    return selection.must_match(table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"])


AMBIGUOUS = "SELECT l_partkey, l_suppkey, count(*) > 1 AS ambiguous, CASE WHEN count(*) = 1 THEN any_value(l_quantity) END AS l_quantity FROM lineitem GROUP BY ALL"


@register(AMBIGUOUS)
def ambiguous_key_join(spark, d):
    """Asked with every key of lineitem."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return selection.with_ambiguity(rows.select("l_partkey", "l_suppkey").distinct(), rows, ["l_partkey", "l_suppkey"])


@register("SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) > 1 AS ambiguous, CASE WHEN count(*) = 1 THEN any_value(o_totalprice) END AS o_totalprice FROM orders GROUP BY ALL")
def ambiguous_key_join_all(spark, d):
    """Orders asked with every customer's priorities and states."""
    keys = ["o_custkey", "o_orderpriority", "o_orderstatus"]
    rows = table(spark, d, "orders").select(*keys, "o_totalprice")
    return selection.with_ambiguity(rows.select(*keys).distinct(), rows, keys)


@register("SELECT l_partkey, l_suppkey, count(*) - 1 AS excess FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return selection.duplicates(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@register(
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 300000 THEN 'price over the limit' END, CASE WHEN o_orderstatus = 'P' THEN 'not finished' END,
    CASE WHEN o_orderdate < DATE '1995-06-01' THEN 'too early' END], lambda x: x IS NOT NULL), '; ') AS problems FROM orders"""
)
def conformity_problems(spark, d):
    rules = {"price over the limit": F.col("o_totalprice") > 300000, "not finished": F.col("o_orderstatus") == "P", "too early": F.col("o_orderdate") < F.lit("1995-06-01").cast("date")}
    return table(spark, d, "orders").select("o_orderkey", F.array_join(selection.problems(rules), "; ").alias("problems"))


@register(
    """WITH e AS (SELECT *, coalesce(sum(value) OVER w, 0) AS s, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, max(CASE WHEN s + CASE WHEN n > 0 THEN s / n ELSE 0 END > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM e)
    SELECT event_id, user_id, value FROM f WHERE x = 0"""
)
def running_budget_stop(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return selection.running_stop(rows, ["user_id"], ["ts", "event_id"], "value", 1000.0).select("event_id", "user_id", "value")


@register(
    """WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS e FROM events), i AS (SELECT *, sum(1 - e) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e),
    k AS (SELECT *, sum(e) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS streak FROM i),
    a AS (SELECT *, coalesce(max(CASE WHEN streak >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM k)
    SELECT event_id, user_id, event_type FROM a WHERE x = 0"""
)
def consecutive_error_abort(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return selection.abort_after(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 2).select("event_id", "user_id", "event_type")


@register("SELECT event_id, user_id, value, previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE value < previous OR value IS NULL OR NOT isfinite(value)")
def monotonic_check(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return selection.not_monotonic(rows, ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "value", "previous")


@register("SELECT doc_id, source, n_chars FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS t FROM documents) WHERE t - n_chars < 50000")
def token_batch_cut(spark, d):
    return selection.batch_cut(table(spark, d, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 50000)


@register(
    """WITH r AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) AS k, count(*) OVER () AS n FROM part),
    s AS (SELECT *, CASE WHEN k <= 10 THEN 'smallest' WHEN k > n - 10 THEN 'largest' WHEN (k - 11) % 7 = 0 AND (k - 11) // 7 < 40 THEN 'middle' END AS stratum FROM r)
    SELECT p_partkey, p_size, k AS rank, stratum FROM s WHERE stratum IS NOT NULL"""
)
def stratified_split(spark, d):
    return selection.stratified_split(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size", "p_partkey"], 10, 7, 40).select("p_partkey", "p_size", F.col("rank").cast("long").alias("rank"), "stratum")


@register("SELECT doc_id, source FROM documents ORDER BY md5(concat_ws('|', 11, doc_id)) LIMIT 50")
def hash_sample(spark, d):
    return selection.hash_sample(table(spark, d, "documents").select("doc_id", "source"), F.col("doc_id"), 50, 11)


@register(
    """WITH e AS (SELECT user_id, epoch_us(ts) / 1000000 AS lo, epoch_us(ts) / 1000000 + value * 60 AS hi FROM events),
    i AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 30 THEN 1 ELSE 0 END AS x FROM e),
    g AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM i), m AS (SELECT user_id, g, min(lo) AS l, max(hi) AS h FROM g GROUP BY ALL)
    SELECT user_id, round(sum(h - l), 3) AS covered, round(min(l), 3) AS first_low, round(max(h), 3) AS last_high, count(*) AS segments FROM m GROUP BY user_id"""
)
def interval_union(spark, d):
    low = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    rows = table(spark, d, "events").select("user_id", low.alias("lo"), (low + F.col("value") * 60).alias("hi"))
    out = selection.interval_union(rows, ["user_id"], "lo", "hi", 30.0)
    return out.select("user_id", *(F.round(c, 3).alias(c) for c in ("covered", "first_low", "last_high")), "segments")


@register(
    """SELECT user_id, count(*) AS overlaps FROM (SELECT user_id, event_id, epoch_us(ts) / 1000000 AS lo, epoch_us(ts) / 1000000 + value * 60 AS hi FROM events) a
    JOIN (SELECT user_id AS u, event_id AS i, epoch_us(ts) / 1000000 AS l FROM events) b ON user_id = u AND event_id <> i AND l > lo AND l <= hi GROUP BY user_id"""
)
def pairwise_overlap(spark, d):
    """Pairs of a user's intervals of which one starts inside the other, by a range frame instead of all pairs."""
    low = F.unix_micros(F.col("ts").cast("timestamp"))
    starts = table(spark, d, "events").select("user_id", low.alias("at"), F.lit(0).alias("kind"))
    ends = table(spark, d, "events").select("user_id", F.floor(low + F.col("value") * 60000000 + 0.5).alias("at"), F.lit(1).alias("kind"), low.alias("from"))
    w = Window.partitionBy("user_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # Starts up to an interval's end, less those up to its own start.
    seen = ends.unionByName(starts.withColumn("from", F.lit(None).cast("long"))).withColumn("n", F.sum(1 - F.col("kind")).over(w))
    at_start = seen.filter("kind = 0").groupBy("user_id", F.col("at").alias("from")).agg(F.max("n").alias("n0"))
    pairs = seen.filter("kind = 1").join(at_start, ["user_id", "from"]).groupBy("user_id").agg(F.sum(F.col("n") - F.col("n0")).alias("overlaps"))
    return pairs.filter("overlaps > 0")


@register("SELECT n_regionkey, sha256('[' || string_agg('[' || n_nationkey || ',\"' || n_name || '\"]', ',' ORDER BY n_nationkey) || ']') AS fingerprint FROM nation GROUP BY ALL")
def ordered_fingerprint(spark, d):
    line = F.concat(F.lit("["), F.col("n_nationkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit('"]'))
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("rows"))
    return rows.select("n_regionkey", F.sha2(F.concat(F.lit("["), F.array_join(F.transform("rows", lambda x: x["line"]), ","), F.lit("]")), 256).alias("fingerprint"))


@register(
    """WITH c AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS id, l_extendedprice * 7 % 1000 AS x, l_extendedprice * 13 % 700 AS y, 1 + l_quantity * l_quantity / 200 AS d FROM lineitem)
    SELECT a.l_suppkey, count(*) AS nested, sum(a.id + b.id)::BIGINT AS ids FROM c a JOIN c b ON a.l_suppkey = b.l_suppkey AND a.id < b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < greatest(a.d, b.d) / 2
      AND NOT (sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1e-7 AND abs(a.d - b.d) <= 1e-9) GROUP BY 1"""
)
def nested_circles(spark, d):
    """Of each supplier's lines as circles: pairs of which one holds the other's centre."""
    id_, price, size = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_quantity")
    circles = table(spark, d, "lineitem").select("l_suppkey", id_.alias("id"), (price * 7 % 1000).alias("x"), (price * 13 % 700).alias("y"), (1 + size * size / 200).alias("d"))
    return geometry.nested(circles, ["l_suppkey"], "id").groupBy("l_suppkey").agg(F.count("*").alias("nested"), F.sum(F.col("id_a") + F.col("id_b")).alias("ids"))
