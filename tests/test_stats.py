import pytest
from pyspark.sql import functions as F

from plumbline.operators import ranks, stats


def signal_16(spark):
    rows = [("a", 1.0)] * 4 + [("b", 0.0)] * 4 + [("c", 5 / 9)] * 4 + [("d", x) for x in (1.0, 1.0, 0.0, 0.0)]
    return spark.createDataFrame([("L1", s, r) for s, r in rows], "tier string, spec string, reward double")


def test_group_signal(spark):
    df = signal_16(spark)
    row = stats.group_signal(df, ["tier"], ["spec"], "reward").first()
    assert (row.groups, row.signal, row.all_solved, row.all_zero, row.same_partial) == (4, 0.25, 0.25, 0.25, 0.25)
    assert row.mean_std == pytest.approx(0.125) and row.mean_abs_advantage == pytest.approx(0.125)
    assert row.sizes == [4]
    again = stats.group_signal(df.repartition(7), ["tier"], ["spec"], "reward").first()
    assert again.signal == row.signal


def test_pass_at_k(spark):
    row = stats.pass_at_k(signal_16(spark), ["tier"], ["spec"], F.col("reward") == 1.0).first()
    assert (row.all_pass, row.pass_at_k) == (6 / 16, 0.5)


def test_two_level_mean_is_not_flat(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", "a", 1.0), ("m", "a", 1.0), ("m", "b", 0.0)], "model string, spec string, r double")
    assert stats.two_level_mean(df, ["model"], ["spec"], F.col("r"), "x").first().x == 0.5


def test_index_percentile(spark):
    df = spark.range(10).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))
    assert df.groupBy("g").agg(stats.index_percentile(F.collect_list("v"), 0.95).alias("p")).first().p == 9
    assert ranks.index_percentile_by(df, ["g"], "v", 0.5, "p").first().p == 5


def test_check_rate_null_only_where_the_check_is_unknown(spark):
    df = spark.createDataFrame([(1, {"R1": True}), (1, {}), (2, {}), (2, {})], "g int, checks map<string,boolean>")
    got = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(stats.check_rate("checks", "R1").alias("a"), stats.check_rate("checks", "R9").alias("b")).collect()}
    assert got == {1: (0.5, None), 2: (0.0, 0.0)}


def test_intervals(spark):
    clusters = spark.createDataFrame([("x", f"s{i:02d}", float(i % 2)) for i in range(20)], "arm string, spec string, v double")
    draws = stats.cluster_draws(clusters, ["arm"], "spec", "v", 200, 3)
    row = stats.interval(draws, ["arm"], 200).first()
    assert 0 < row.low < 0.5 < row.high < 1
    parity = clusters.groupBy("arm", "spec").agg(F.collect_list("v").alias("values"))
    a = stats.seeded_interval(parity, ["arm"], "spec", "values", 500).first()
    b = stats.seeded_interval(parity.repartition(5), ["arm"], "spec", "values", 500).first()
    assert a == b and a.point == 0.5


def test_exact_lower_bound():
    assert stats.exact_lower_bound(0, 10) == 0
    assert stats.exact_lower_bound(60, 60) == pytest.approx(0.025 ** (1 / 60), abs=1e-9)
