"""Order statistics, numbering, resampling and shuffles against plain Python."""

import hashlib
import math
import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.functions import numbers, text
from plumbline.operators import ranks, stats
from plumbline.plans import registry


def values(seed):
    rng = random.Random(seed)
    rows = [("ties", float(rng.randrange(3))) for _ in range(500)] + [("skew", math.exp(rng.gauss(0, 9)) * rng.choice((-1, 1))) for _ in range(777)]
    rows += [("same", 4.0)] * 300 + [("one", -1.0), ("two", 1.0), ("two", 2.0), ("null", None), (None, 5.0), (None, 7.0), (None, None)] + [("edge", 0.0)] * 299 + [("edge", 1.0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("enough, q", [(5, 0.0), (5, 0.5), (20, 0.9), (5, 0.999), (100_000, 0.25)])
def test_percentiles_of_large_groups(spark, enough, q):
    rows = values(int(q * 100))
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    got = {r.g: r.p for r in ranks.index_percentile_by(df, ["g"], "v", q, "p", enough).collect()}
    assert got == {g: sorted(v)[min(len(v) - 1, int(q * len(v)))] for g, v in groups.items()}
    medians = {r.g: (r.n, r.m) for r in ranks.median_by(df, ["g"], "v", "m", enough).collect()}
    assert medians == {g: (len(v), statistics.median(v)) for g, v in groups.items()}
    assert ranks.median_by(df.limit(0), ["g"], "v", "m").count() == 0


def test_numbered_in_parts(spark):
    rows = [("a", i * 7 % 1009) for i in range(1009)] + [("b", i) for i in range(3)] + [("c", 9)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(4)
    out = ranks.numbered(df, ["g"], "v", "place", parts=20).collect()
    assert sorted((r.g, r.v, r.place) for r in out) == sorted([("a", i, i) for i in range(1009)] + [("b", i, i) for i in range(3)] + [("c", 9, 0)])


def test_both_ways_of_resampling_agree(spark):
    rows = [(g, i * 3, float((i * i) % 17)) for g, n in (("a", 40), ("b", 7), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, spec long, v double").repartition(3)
    for size in (None, 5):
        few, many = ({(r.g, r.draw): round(r["mean"], 9) for r in stats.cluster_draws(df, ["g"], "spec", "v", 30, 3, size=size, together=k).collect()} for k in (1000, 10))
        assert few == many and len(few) == 90


@pytest.mark.parametrize("prefix, low, high", [(b"", 0, 10), (b"20261001|99|", 1234560, 1234999), (b"x" * 45, 4294967290, 4294967300)])
def test_hashes_of_many_numbers(prefix, low, high):
    assert numbers.md5_heads(prefix, low, high).tolist() == [int(hashlib.md5(prefix + str(i).encode()).hexdigest()[:8], 16) for i in range(low, high)]
    with pytest.raises(ValueError):
        numbers.md5_heads(prefix, 5, 11)


@pytest.mark.parametrize("held", [stats.HELD, 400, 7])
def test_draws_of_all_clusters(spark, held):
    """Groups with names as order, nulls and a null group, held whole or in parts; picks are no rows of a plan."""
    rng = random.Random(4)
    rows = [(g, f"s{i:05d}", None if rng.random() < 0.1 else rng.gauss(5, 2)) for g, n in (("a", 1500), ("b", 130), ("c", 1), (None, 12)) for i in range(n)] + [("d", "s", None)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, spec string, v double").repartition(5)
    out = stats.whole_draws(df, ["g"], "spec", "v", 40, 9, held=held)
    want = {}
    for g in {g for g, *_ in rows}:
        values = [v for _, v in sorted((s, v) for x, s, v in rows if x == g)]
        for draw in range(40):
            took = [values[int(hashlib.md5(f"9|{draw}|{i}".encode()).hexdigest()[:8], 16) % len(values)] for i in range(len(values))]
            known = [v for v in took if v is not None]
            want[g, draw] = round(sum(known) / len(known), 9) if known else None
    got = out.collect()
    assert {(r.g, r.draw): r["mean"] if r["mean"] is None else round(r["mean"], 9) for r in got} == want and len(got) == len(want)
    plan = stats.cluster_draws(df, ["g"], "spec", "v", 40, 9, together=10)._jdf.queryExecution().toString()
    assert "md5" not in plan and "explode(sequence(0, 39" not in plan
    assert stats.whole_draws(df.limit(0), ["g"], "spec", "v", 40, 9, held=held).count() == 0


@pytest.mark.parametrize("name", ["cluster_bootstrap_ci", "two_sample_bootstrap", "predictive_interval"])
def test_bootstraps_without_some_values(spark, tmp_path, name):
    """Customers without a segment, prices and keys that are null: the same as in SQL."""
    rng = random.Random(name)
    customers = [(i, rng.choice(("A", "B", "C", None))) for i in range(400)]
    orders = [(i, rng.choice((None, rng.randrange(500))), None if rng.random() < 0.2 else round(rng.uniform(1, 999), 2)) for i in range(900)]
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    duck = duckdb.connect()
    for t in ("customer", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(duck.execute(registry.ORACLE_SQL[name]).fetchall())


def test_two_samples_share_their_draws(spark):
    """Every pair of segments meets in the same draws, which are made once."""
    plan = registry.QUERIES["two_sample_bootstrap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [_bucket") == 1  # what tells the tasks of the draws


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 200, 5003])
def test_permutations(spark, n):
    df = spark.range(n)
    a, b, other = ({r.id: r.place for r in ranks.shuffled(x, "id", s).collect()} for x, s in ((df, 7), (df.repartition(3), 7), (df, 8)))
    assert sorted(a.values()) == list(range(n)) and a == b
    assert n < 17 or (a != other and sum(a[i] == i for i in a) < n / 4 + 3)
    if n == 5003:  # neighbours don't stay together
        assert sum(abs(a[i] - a[i + 1]) < 100 for i in range(n - 1)) < n / 10


def test_short_numbers(spark):
    xs = [0.0, 80.0, 6.5, 1e7, 1e-4, 1e-5, 123456.0, 1234567.0, 999999.5, 0.1 + 0.2, -2.50, -1e-7, 1e100, 123.456789, 0.00012345678, float("nan"), float("inf"), float("-inf"), 100.0, 1e5, 1e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r.s for r in df.select(text.short_number(F.col("x")).alias("s")).collect()] == [f"{x:g}" for x in xs]


def test_lines_six_times(spark):
    lines = ["line number one", "another line", "third line of it"]
    five, six = "\n".join((lines * 5 + ["x" * 30, "y" * 80])), "\n".join(lines * 5 + ["z" * 100, lines[1]])
    df = spark.createDataFrame([(five,), (six,), (None,), ("",)], "t string")
    assert [r.d for r in df.select(text.degenerate(F.col("t")).alias("d")).collect()] == [False, True, False, False]
