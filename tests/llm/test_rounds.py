"""Centroid clustering, periodic runs and packing against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import centroids, packing, squares

# --- centroids ------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dimension):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) and abs(x) < 131072 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for j, g in groups.items():
            cents[j] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    done = [(i, *near(v)) for i, v in kept]
    total = defaultdict(int)
    for _, d, j in done:
        total[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, total[j], sum(total.values()), sha[j]) for i, d, j in done), key=repr)


def clustered(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, apex string").repartition(3)
    return sorted((tuple(r) for r in centroids.clusters(df, **kw).collect()), key=repr)


def test_clusters_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) + 3 * (i % 5)).tolist()) for i in range(200)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (300, None), (301, []), (302, [1.0] * 5), (303, [None, *[1.0] * 5]), (304, [float("nan"), *[1.0] * 5]), (305, [float("inf"), *[1.0] * 5]), (306, [131072.0, *[0.0] * 5]), (307, [131071.9, *[-131071.9] * 5])]
    rows += [(400 + i, rows[3][1]) for i in range(60)]
    assert clustered(spark, rows, dimension=6) == brute_clusters(rows, 8, 10, 6)


@pytest.mark.parametrize("n", [0, 1, 3, 9])
def test_few_vectors(spark, n):
    rows = [(i, [float(i // 2), 0.5, -0.25]) for i in range(n)]  # equal pairs, ties
    assert clustered(spark, rows, dimension=3, rounds=3) == brute_clusters(rows, 8, 3, 3)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for scale in (3, 1000, 1 << 26):
        x = rng.integers(-scale, scale, (300, 12))
        simplex = centroids.Simplex(np.concatenate([x[:9], x[3:5], [x[0] + x[1] - x[2]]]))
        assert len(simplex.pivots) == 9  # repeated and dependent ones left out
        c = x[100:130]
        true = centroids.squared(x, c)
        assert (true == ((x[:, None] - c) ** 2).sum(2)).all()
        a, b = simplex.apexes(x), simplex.apexes(c)
        lower = np.sqrt(((a[:, None, :] - b) ** 2).sum(2))
        assert (lower <= np.sqrt(true) + 1e-4 * np.sqrt((a * a).sum(1)).max()).all()
        open_ = centroids.near_enough(a, b)
        assert open_[np.arange(len(x)), true.argmin(1)].all() and not open_.all()


# --- periodic runs --------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def test_runs_of_random_words():
    rng = np.random.default_rng(1)
    for _ in range(300):
        texts = []
        for _ in range(int(rng.integers(1, 6))):
            parts = [np.tile(rng.integers(0, 3, rng.integers(1, 12)), rng.integers(1, 8)) for _ in range(int(rng.integers(0, 8)))]
            texts.append(np.concatenate([np.zeros(0, np.int64), *parts]))
        offsets = np.cumsum([0, *map(len, texts)])
        found = squares.runs_by_text(np.concatenate(texts), offsets)
        assert [[tuple(r) for r in f.tolist()] for f in found] == [brute_runs(t.tolist()) for t in texts]


@pytest.mark.parametrize("words, runs", [([0] * 100_000, [[0, 100_000, 1]]), ([0, 1, 2] * 40_000 + [0], [[0, 120_001, 3]]), ([bin(i).count("1") % 2 for i in range(1 << 15)], []), (list(range(5000)) * 4, [[0, 20_000, 5000]]), (list(range(5000)) * 4 + [1], [[0, 20_000, 5000]]), ([1] * 5, []), ([1] * 6, [[0, 6, 1]])])
def test_runs_of_long_words(words, runs):
    found = squares.runs_by_text(np.array(words, np.int64), np.array([0, len(words)]))
    assert found[0].tolist() == runs


def brute_row(doc_id, text):
    w = words_of(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    top = min(((s - e, s, q) for s, e, q in runs), default=None)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    return doc_id, len(runs), *first, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_periodic_runs(spark, docs, empty, tmp_path):
    more = [(i, f"one two three four five six seven {i} " * 3 + "a b " * (i % 9) + "\x1c \x0b é é é é é é é", "en", "s", 1, 1, 2, 3, 4.0, "x") for i in range(100, 160)]
    more += [(None, "x x x x x x x", "en", "s", 1, 1, 2, 3, 4.0, "x"), (None, None, None, None, None, None, None, None, None, None)]
    rows = docs.union(spark.createDataFrame(more, docs.schema))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = squares.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = [brute_row(r.doc_id, r.text) for r in rows.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r.n_runs > 0 for r in got) > 50
    assert squares.periodic_runs(empty).count() == 0


# --- packing --------------------------------------------------------------------------------------------------------


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


@pytest.mark.parametrize("seed, capacity, n", [(0, 1024, 700), (1, 100, 2000), (2, 64, 50), (3, 10, 1), (4, 50, 0), (5, 30, 5000)])
def test_plan(seed, capacity, n):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(1 + rng.gamma(2, capacity / 5, n).astype(int), capacity)
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan, bound = packing.planned(counts)
    held = np.zeros_like(counts)
    for config, times in plan.items():
        assert sum(length * k for length, k in config) <= capacity
        for length, k in config:
            held[length] += k * times
    assert (held == counts).all()
    used = sum(plan.values())
    assert bound <= used + 1e-6 and used <= best_fit_decreasing(lengths.tolist(), capacity) * 1.01 + 1 and -(-lengths.sum() // capacity) <= used


def test_thirds_and_halves():
    """Best fit decreasing wastes room here: 6 sequences of 10 hold 4+3+3 twice and 5+5 once, planned as such."""
    counts = np.zeros(11, np.int64)
    counts[[4, 3, 5]] = 2000, 4000, 200
    assert sum(packing.planned(counts)[0].values()) == 2100


def test_knapsack_is_exact():
    price = np.array([0, 0, 3.0, 4, 0, 9, 0, 0, 0])
    best, _ = packing.knapsack(price)
    assert best.tolist() == [0, 0, 3, 4, 6, 9, 9, 12, 13]


def test_cut():
    for n in (1, 5, 9, 10, 11, 20, 21, 35):
        spans = packing.cut(n, 10)
        assert spans[0][0] == 0 and sum(length for _, length in spans) == n
        assert all(length == 10 for _, length in spans[1:]) and all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [(50, " " * 300_000 + "a", "en", "s", 1, 1, 2, 3, 4.0, "x"), (51, "<|endoftext|> it's 12ª 　 x" * 3, "en", "s", 1, 1, 2, 3, 4.0, "x"), (None, "no id", "en", "s", 1, 1, 2, 3, 4.0, "x"), (2**60 + 1, "id", "en", "s", 1, 1, 2, 3, 4.0, "x")]
    rows = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("number", F.lit(1)).withColumn("task", F.lit("x"))
    got = packing.packed(rows).toPandas().astype({"doc_id": "Int64"})
    want = []
    for r in rows.collect():
        ids = [*tokens.encode(r.text or "", add_special_tokens=False).ids, 2]
        want += [(r.doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    read = packing.packed(rows).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, read), key=repr) == sorted(want, key=repr)
    for _, sequence in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (sequence.offset == sequence.length.cumsum().shift(fill_value=0)).all() and sequence.length.sum() <= 1024
    assert got.sequence_id.nunique() <= best_fit_decreasing(got.length.tolist(), 1024)
    assert packing.packed(empty).count() == 0
