import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import matching, selection
from plumbline.plans import registry


def test_latest_clean_beats_newer_dirty(spark):
    df = spark.createDataFrame([("m", "1", True), ("m", "2", False), ("n", "1", False), ("n", "2", False)], "label string, run string, clean boolean")
    got = {r.label: (r.run, r.superseded) for r in selection.latest_clean(df, ["label"], F.col("clean"), "run").collect()}
    assert got == {"m": ("1", 1), "n": ("2", 1)}


def test_coverage_and_duplicates(spark):
    planned = spark.createDataFrame([(1,), (2,)], "k int")
    seen = spark.createDataFrame([(2,), (3,), (3,)], "k int")
    assert sorted((r.k, r.problem) for r in selection.coverage(planned, seen, ["k"]).collect()) == [(1, "missing"), (3, "extra")]
    assert [(r.k, r.excess) for r in selection.duplicates(seen, ["k"]).collect()] == [(3, 1)]
    assert selection.same_set(planned, planned, ["k"]) and not selection.same_set(planned, seen, ["k"])


def test_must_match_refuses(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, label string")
    with pytest.raises(selection.Refused):
        selection.must_match(left, right, ["k"])


def test_ambiguous_keys_give_no_evidence(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, text string")
    got = {r.k: (r.ambiguous, r.text) for r in selection.with_ambiguity(left, right, ["k"]).collect()}
    assert got == {1: (False, "a"), 2: (True, None), 3: (False, None)}


def test_interval_union(spark):
    df = spark.createDataFrame([(1, 0.0, 3.0), (1, 2.0, 4.0), (1, 4.00005, 5.0), (1, 8.0, 10.0)], "p int, lo double, hi double")
    row = selection.interval_union(df, ["p"], "lo", "hi", 1e-4).first()
    assert (row.covered, row.segments, row.first_low, row.last_high) == (7.0, 2, 0.0, 10.0)


def test_cuts(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate((4.0, 4.0, 4.0, 4.0))], "g int, i int, c double")
    assert selection.running_stop(df, ["g"], ["i"], "c", 10.0).count() == 2  # 8 + 4 > 10 stops the third
    assert selection.batch_cut(df, ["g"], ["i"], "c", 8.0).count() == 2
    e = spark.createDataFrame([(1, i, x) for i, x in enumerate("eeoeee ooo".replace(" ", ""))], "g int, i int, x string")
    assert selection.abort_after(e, ["g"], ["i"], F.col("x") == "e", 3).count() == 6


def test_budget_stop_of_peers_and_of_rows_without_an_order(spark, tmp_path):
    """As in SQL: rows of the same ts and event_id stop together, and rows without a ts come last."""
    day = lambda n: None if n is None else f"2024-01-{n:02d} 00:00:00"
    rows = [(1, 1, 10, 300.0), (1, 1, 10, 300.0), (1, 1, 10, 300.0), (2, 2, 10, 1.0)]  # 600 + 300 at the third: all go on, the next doesn't
    rows += [(3, 1, 11, 600.0)] * 2 + [(4, 2, 11, 1.0)]  # 600 + 600 at the second: neither is kept
    rows += [(5, None, 12, 900.0), (6, 1, 12, 100.0), (7, 2, 12, 100.0), (None, 3, 12, 100.0), (8, 3, 12, None)]
    rows += [(9, 1, 13, float("nan")), (10, 2, 13, 1.0), (11, 1, None, 500.0), (12, 2, None, 500.0)]
    df = spark.createDataFrame([(e, day(t), u, v) for e, t, u, v in rows], "event_id long, ts string, user_id long, value double").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[:2]) + (repr(r[2]),)
    got = sorted(map(tuple, registry.QUERIES["running_budget_stop"](spark, str(tmp_path)).collect()), key=key)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(duck.execute(registry.ORACLE_SQL["running_budget_stop"]).fetchall(), key=key)
    assert repr(got) == repr(want)
    assert sorted(r[0] or 0 for r in got) == [0, 1, 1, 1, 5, 6, 7, 8, 9, 11, 12]


def test_stratified_split_and_global_rank(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("area"))
    got = selection.global_rank(df.repartition(5), ["area", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 101)) and [(r.area, r.id) for r in got] == sorted((r.area, r.id) for r in got)
    kinds = selection.stratified_split(df, ["area", "id"], 10, 8, 5).groupBy("stratum").count().collect()
    assert {r.stratum: r["count"] for r in kinds} == {"smallest": 10, "largest": 10, "middle": 5}


def test_nearest_and_matching(spark):
    points = spark.createDataFrame([(i, float(v)) for i, v in enumerate((0.0, 4.9, 5.0, 99.0))], "k long, v double")
    grid = spark.createDataFrame([(10, 0.0), (11, 10.0), (12, 10.0)], "g long, at double")
    got = {r.k: (r.g, r.gap) for r in matching.nearest(points, grid, "k", "v", "g", "at").collect()}
    assert got == {0: (10, 0.0), 1: (10, 4.9), 2: (10, 5.0), 3: (11, 89.0)}
    rows = spark.createDataFrame([([[0, 1], [0], [1]],), ([[0], [1], []],), ([],)], "options array<array<int>>")
    assert [r.matched for r in matching.largest_matchings(rows, "options").collect()] == [2, 2, 0]


@pytest.mark.parametrize(("value", "inside"), [(6.6, True), (6.600001, False), (6.4, True), (6.399999, False)])
def test_tolerance_edges(spark, value, inside):
    points = spark.createDataFrame([(1, value)], "k int, v double")
    grid = spark.createDataFrame([(6.5,)], "at double")
    assert (selection.banded_join(points, grid, "v", "at", 0.1).count() == 1) is inside
