import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import neighbours, quality, warc
from plumbline.llm.common import shared_dir

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


# --- neighbours -----------------------------------------------------------------------------------------------------


def brute_neighbours(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q, i in enumerate(ids):
        if i % 50 == 0:
            s = x @ x[q]
            others = [j for j in range(len(ids)) if ids[j] != i]
            out[int(i)] = [int(ids[j]) for j in sorted(others, key=lambda j: (-round(s[j], 12), ids[j]))[:k]]
    return out


def found(df, **kw):
    out = {}
    for r in neighbours.search(df, lambda i: i % 50 == 0, **kw).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_all_leaves_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    for i in range(100, 160):
        rows[i] = (i, rows[100][1])  # a group of equal vectors, with a query in it
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = found(df, recall=1.0, leaf_rows=16, sample=200, bin_rows=50)
    assert {q: [v for _, v, _ in x] for q, x in got.items()} == brute_neighbours(rows, 5)
    assert all(x[0][0] == 1 and -1 <= x[0][2] <= 1 + 1e-12 for x in got.values())


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [2.0, 0.0]), (7, [0.0, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (50, [0.0, 0.0]), (6, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("clash")).withColumn("leaf", F.lit(1))
    assert found(df) == {0: [(1, 6, 1.0), (2, 7, 0.0)]}
    assert found(df.filter("vec_id < 0")) == {}


@needs_tables
def test_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    true = brute_neighbours([(r.vec_id, list(r.embedding)) for r in df.collect()], 5)
    got = found(df)
    hits = sum(len({v for _, v, _ in got[q]} & set(true[q])) for q in true)
    assert hits >= 0.9 * 5 * len(true)


# --- WARC -----------------------------------------------------------------------------------------------------------


def test_revisits(spark, tmp_path):
    big, other = "é" * 600, "<p>WARC/1.1\r\n\r\n</p>" * 60
    rows = [(1, "http://a/ b", big), (2, None, big), (7, "http://c", big), (3, "u", "small"), (4, "u", "small"), (5, "u", other), (6, "u\r\nX: y", other), (8, "u", None), (9, "u", ""), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "u", "y" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).repartition(3)
    path = f"{shared_dir(spark)}/warc-test"
    warc.write(warc.resolve(df), path, records_per_file=2)
    got = sorted(tuple(r) for r in warc.read_back(spark, path).collect())
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert got == sorted(c.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.OP9_SQL})").fetchall())
    assert {r[0]: r[4] for r in got if r[3] == "revisit"} == {1: 7, 2: 7, 5: 6}
    path = f"{shared_dir(spark)}/warc-empty"
    warc.write(warc.resolve(df.filter("page_id < 0")), path)
    assert warc.read_back(spark, path).count() == 0


@pytest.mark.parametrize("layout", range(4))
def test_repeated_page_ids(spark, layout):
    """Ids that repeat with other payloads, null ids, payloads that hold what divides records, long ones."""
    p, q = "P" * 1500, "Q" * 1200
    cut = f"<p>{warc.BETWEEN}</p>" * 90
    rows = [(7, p), (7, q), (3, p), (3, q), (9, cut), (8, cut), (None, cut), (None, "n" * 1000), (None, "n" * 1000), (1, None), (2, warc.BETWEEN), (4, "x" * 3_000_000 + warc.BETWEEN), (5, "é" * 700), (5, "é" * 700), (4, "é" * 700)]
    rng = np.random.default_rng(layout)
    df = spark.createDataFrame([(*rows[i], "http://a b/", "x", 1) for i in rng.permutation(len(rows))], "page_id long, html string, url string, sha1 string, original int").repartition(1 + layout)
    path = f"{shared_dir(spark)}/warc-layout-{layout}"
    warc.write(warc.resolve(df), path, records_per_file=[3, 100, 2, 5][layout])
    got = sorted((tuple(r) for r in warc.read_back(spark, path).collect()), key=repr)
    c = duckdb.connect()
    c.register("pages", df.toPandas().astype({"page_id": "Int64"}))
    assert got == sorted(c.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.OP9_SQL})").fetchall(), key=repr)


def test_lost_response(spark):
    df = spark.createDataFrame([(1, "P" * 1500, "u"), (2, "P" * 1500, "u")], "page_id long, html string, url string")
    path = f"{shared_dir(spark)}/warc-lost"
    warc.write(warc.resolve(df).filter("original is not null"), path)
    with pytest.raises(Exception, match="no response"):
        warc.read_back(spark, path).collect()


# --- quality --------------------------------------------------------------------------------------------------------


@needs_tables
def test_held_out_accuracy(spark):
    rows = quality.op8_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = rows.filter("held_out").join(labels, "doc_id").toPandas()
    assert len(held) > 30 and (held.predicted == held.quality).mean() >= 0.95
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_scores_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(9, 1, 0), (13, 1, 0), (15, 0, 0), (18, 0, 1), (999, 1, 0), (12, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, lambda i: F.lit(True))
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    kept = quality.score(docs, model, keep=True)
    assert kept.columns == [*docs.columns, "score_"]  # docs has a score of its own
    none = quality.train(docs, labels.filter("quality = 1"), lambda i: F.lit(True))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_ranking_learns_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > 0).astype(int)
    model = quality.fit(x, y, 5000, 1e-3, 1)
    assert ((model.score(x, 0.3) >= 0.3) == y).mean() > 0.93
