"""Queries: paired differences, confusion, tolerance and nearest matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import matching, selection
from plumbline.plans.registry import register, table


@register(
    """WITH r AS (SELECT l_suppkey, year(l_shipdate) AS y, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS x FROM lineitem GROUP BY ALL)
    SELECT a.l_suppkey, round(a.x, 6) AS base, round(b.x, 6) AS adapter, round(b.x - a.x, 6) AS difference FROM r a JOIN r b USING (l_suppkey) WHERE a.y = 1996 AND b.y = 1997"""
)
def paired_difference(spark, d):
    rates = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("x"))
    arm = lambda y, name: rates.filter(F.col("y") == y).select("l_suppkey", F.col("x").alias(name))
    both = arm(1996, "base").join(arm(1997, "adapter"), "l_suppkey")
    return both.select("l_suppkey", F.round("base", 6).alias("base"), F.round("adapter", 6).alias("adapter"), F.round(F.col("adapter") - F.col("base"), 6).alias("difference"))


@register(
    """SELECT quality, n_chars >= 200 AS predicted, count(*) AS n, round(avg(toxic), 6) AS toxic_rate FROM labels JOIN documents USING (doc_id) GROUP BY ALL"""
)
def confusion_by_class(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy("quality", (F.col("n_chars") >= 200).alias("predicted")).agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 6).alias("toxic_rate"))


GRID = 25


@register(f"SELECT p_partkey, p_retailprice, g AS at FROM part, (SELECT unnest(range(0, 4000, {GRID}))::DOUBLE AS g) WHERE abs(p_retailprice - g) <= 3 + 1e-6")
def theta_tolerance_match(spark, d):
    grid = spark.range(0, 4000, GRID).select(F.col("id").cast("double").alias("at"))
    return selection.banded_join(table(spark, d, "part").select("p_partkey", "p_retailprice"), grid, "p_retailprice", "at", 3.0, 1e-6)


@register(
    """SELECT p_partkey, s_suppkey AS nearest, round(gap, 4) AS gap FROM (SELECT p_partkey, s_suppkey, abs(p_retailprice - s_acctbal) AS gap,
    row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_retailprice - s_acctbal), s_suppkey) AS r FROM part, supplier) WHERE r = 1"""
)
def nearest_match(spark, d):
    points = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return matching.nearest(points, table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "p_partkey", "p_retailprice", "s_suppkey", "s_acctbal").select("p_partkey", F.col("s_suppkey").alias("nearest"), F.round("gap", 4).alias("gap"))


@register()
def bipartite_matching(spark, d):
    """Largest one-to-one assignment of an order's lines to its slots, by quantity near multiples of ten."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity")).alias("points"))
    slots = F.array(*(F.lit(float(x)) for x in (10, 20, 30, 40)))
    options = rows.select("l_orderkey", matching.near(slots, F.col("points"), 6.0).alias("options"))
    return matching.largest_matchings(options, "options").select("l_orderkey", "matched")


@register(
    """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY ALL),
    d AS (SELECT vec_id, label, sqrt(sum((x - m) * (x - m))) AS dist FROM v JOIN c USING (label, i) GROUP BY ALL) SELECT vec_id, label, round(dist, 4) AS distance, dist <= 6 AS within FROM d"""
)
def vector_distance_match(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    centre = rows.groupBy("label", "i").agg(F.avg("x").alias("m"))
    dist = rows.join(centre, ["label", "i"]).groupBy("vec_id", "label").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("m"), 2))).alias("dist"))
    return dist.select("vec_id", "label", F.round("dist", 4).alias("distance"), (F.col("dist") <= 6).alias("within"))


@register(
    """WITH a AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders GROUP BY ALL)
    SELECT f || '' || o AS pattern, count(*) AS n FROM a GROUP BY ALL"""
)
def joint_pass_pattern(spark, d):
    has = lambda s: F.max((F.col("o_orderstatus") == s).cast("int"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(has("F").alias("f"), has("O").alias("o"))
    return rows.groupBy(F.concat_ws("", "f", "o").alias("pattern")).agg(F.count("*").alias("n"))


@register(
    """WITH a AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_custkey, coalesce(x.n, 0) AS before, coalesce(z.n, 0) AS after FROM (SELECT * FROM a WHERE y = 1996) x FULL JOIN (SELECT * FROM a WHERE y = 1997) z USING (o_custkey)
    WHERE x.n IS DISTINCT FROM z.n"""
)
def full_outer_differences(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    side = lambda y, name: counts.filter(F.col("y") == y).select("o_custkey", F.col("n").alias(name))
    both = side(1996, "before").join(side(1997, "after"), "o_custkey", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    return both.select("o_custkey", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


@register(
    """WITH s AS (SELECT user_id, max(epoch_us(ts)) OVER (PARTITION BY user_id) - epoch_us(ts) AS age, event_type FROM events)
    SELECT event_type, count(*) FILTER (WHERE age <= 86400000000) AS fresh, count(*) FILTER (WHERE age > 86400000000) AS stale FROM s GROUP BY ALL"""
)
def staleness_split(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    age = F.max(at).over(Window.partitionBy("user_id")) - at
    return table(spark, d, "events").withColumn("age", age).groupBy("event_type").agg(F.count_if(F.col("age") <= 86400000000).alias("fresh"), F.count_if(F.col("age") > 86400000000).alias("stale"))
