"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of distinct vectors (`sample`, first by hash); every vector is then given to its
leaf. A query's leaves come from a priority queue over the tree's nodes, nearest centre first, and are visited in rounds
of growing width. After each round a query stops if its worst kept score reaches a bound; bounds and the last width are
calibrated on `probes` vectors, whose true neighbours are found among all vectors in blocks, so that the recall is at
least `recall` (1 widens to all leaves).

Equal vectors are searched once: each distinct vector keeps its smallest ids, as many as a result can hold. Leaves are
packed into bins of about `bin_rows` vectors (a larger leaf is split over several), queries are dealt to the bins that
hold their leaves, and a bin with many queries is copied for blocks of them; no task holds more than one bin and one
block. Scores are exact cosines of the original vectors in double precision.

Vectors that are null, zero, empty, of another length than most, or that hold a null or non-finite component take no
part. Rows that repeat an id and its vector count once; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored


@dataclass
class Tree:
    """centres of all nodes but the root; children[node] are rows of it; leaf[node] is the leaf number or -1."""

    centres: np.ndarray
    children: list[list[int]]
    top: list[int]
    leaf: np.ndarray
    n_leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each (normalised) row, by greedy descent."""
        out = np.zeros(len(x), np.int64)
        if not self.top:
            return out
        stack = [(np.arange(len(x)), self.top)]
        while stack:
            rows, nodes = stack.pop()
            best = np.asarray(nodes)[np.argmax(x[rows] @ self.centres[nodes].T, axis=1)]
            for node in np.unique(best).tolist():
                mine = rows[best == node]
                if self.children[node]:
                    stack.append((mine, self.children[node]))
                else:
                    out[mine] = self.leaf[node]
        return out

    def best_bins(self, x: np.ndarray, width: int) -> list[list[int]]:
        """The first `width` leaves of each row, nearest pending node first."""
        if not self.top:
            return [[0] for _ in x]
        found = []
        for near in -(x @ self.centres.T):
            near = near.tolist()
            queue = [(near[c], c) for c in self.top]
            heapq.heapify(queue)
            leaves: list[int] = []
            while queue and len(leaves) < width:
                _, node = heapq.heappop(queue)
                if self.children[node]:
                    for c in self.children[node]:
                        heapq.heappush(queue, (near[c], c))
                else:
                    leaves.append(int(self.leaf[node]))
            found.append(leaves)
        return found


def grow(x: np.ndarray, branch: int, leaf_rows: int, seed: int = 5) -> Tree:
    """Hierarchical spherical k-means of normalised rows."""
    rng = np.random.default_rng(seed)
    centres: list[np.ndarray] = []
    children: list[list[int]] = []

    def split(rows: np.ndarray) -> list[int]:
        if len(rows) <= leaf_rows:
            return []
        part = x[rows]
        c = part[rng.choice(len(part), branch, replace=False)]
        for _ in range(8):
            mine = np.argmax(part @ c.T, axis=1)
            c = np.array([part[mine == k].sum(0) if (mine == k).any() else part[rng.integers(len(part))] for k in range(branch)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
        mine = np.argmax(part @ c.T, axis=1)
        used = np.unique(mine).tolist()
        if len(used) < 2:
            return []
        nodes = []
        for k in used:
            nodes.append(len(centres))
            centres.append(c[k])
            children.append([])
        for node, k in zip(nodes, used, strict=True):
            children[node] = split(rows[mine == k])
        return nodes

    top = split(np.arange(len(x)))
    leaf, n = np.full(len(centres), -1), 0
    for node, kids in enumerate(children):
        if not kids:
            leaf[node], n = n, n + 1
    return Tree(np.array(centres).reshape(len(centres), x.shape[1] if x.ndim == 2 else 0), children, top, leaf, max(n, 1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows_of(column, dim: int) -> np.ndarray:
    """float64 rows of a column of binary vectors."""
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row, in an order of additions that doesn't depend on what else is in the block."""
    q, c = q / np.abs(q).max(axis=1, keepdims=True), c / np.abs(c).max(axis=1, keepdims=True)
    return np.add.reduce(q * c, axis=1) / np.sqrt(np.add.reduce(q * q, axis=1) * np.add.reduce(c * c, axis=1))


def top_of(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, score) of each row's k best of c: by score, ties to the smaller of ids."""
    rough = unit(q) @ unit(c).T
    take = min(len(c), k)
    kth = np.partition(rough, len(c) - take, axis=1)[:, len(c) - take]
    a, b = np.nonzero(rough >= kth[:, None] - 1e-9)  # all that may be among the k best once they are scored exactly
    score = cosines(q[a], c[b])
    order = np.lexsort([ids[b], -score, a])
    a, b, score = a[order], b[order], score[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    return a[rank < k], b[rank < k], score[rank < k]


def distinct_vectors(df: DataFrame, id_col: str, vec_col: str, keep: int) -> tuple[DataFrame, DataFrame, int]:
    """((vec_id, key) of all usable rows, (key, vector binary, ids) of distinct vectors with their `keep` smallest ids,
    length of the vectors). Both tables are stored."""
    v = F.col(vec_col).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null").filter(F.coalesce(usable, F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = lengths[0]["n"] if lengths else 1
    rows = rows.filter(F.size("v") == dim).withColumn("key", F.concat_ws(":", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in flat], pa.binary()), batch.column(2)], names=["vec_id", "vector", "key"])

    packed, _ = stored(rows.select("vec_id", "v", "key").mapInArrow(pack, "vec_id long, vector binary, key string"), "vectors")
    # Keeping the smallest ids of a vector twice, first by a salt, never brings all copies of one vector together.
    distinct = packed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    for by in (["key", "salt"], ["key"]):
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
        ids = packed.columns + ["salt"]
        distinct = distinct.select(*ids).withColumn("nth", nth).filter(F.col("nth") <= 2 * keep)
    entries = distinct.groupBy("key").agg(F.first("vector").alias("vector"), F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep).alias("ids"))
    return packed.select("vec_id", "key"), stored(entries, "entries")[0], dim


def search(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, recall: float = 0.97, sample: int = 20_000, branch: int = 8, leaf_rows: int = 48, probes: int = 128, bin_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id satisfies is_query."""
    spark = df.sparkSession
    keep = k + 1
    all_rows, entries, dim = distinct_vectors(df, id_col, vec_col, keep)

    # The tree, from a bounded sample.
    picked = entries.orderBy(F.xxhash64("key", F.lit(3)), "key").limit(sample).select("key", "vector").toArrow()
    drawn = rows_of(picked.column("vector").to_pylist(), dim)
    tree = grow(unit(drawn) if len(drawn) else drawn, branch, leaf_rows)
    shared = spark.sparkContext.broadcast(tree)  # at most 2 * sample centres

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.assign(unit(rows_of(batch.column(1).to_pylist(), dim)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    indexed, _ = stored(entries.mapInArrow(to_leaf, "key string, vector binary, ids array<long>, leaf long"), "index")

    # Bins of whole leaves; a leaf of more than bin_rows vectors gets bins of its own.
    count = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().toArrow().to_pylist()}
    first, parts, at, room = np.zeros(tree.n_leaves, np.int64), np.ones(tree.n_leaves, np.int64), 0, bin_rows
    for leaf in range(tree.n_leaves):
        n = count.get(leaf, 0)
        if n > room and room < bin_rows:
            at, room = at + 1, bin_rows
        first[leaf], parts[leaf] = at, max(1, -(-n // bin_rows))
        if parts[leaf] > 1:
            at, room = at + int(parts[leaf]), bin_rows
        else:
            room -= n
    bins = spark.sparkContext.broadcast((first, parts))

    # Calibration: the true neighbours of the probes among all vectors, block by block.
    probe_rows = drawn[:probes]
    probe_keys = picked.column("key").to_pylist()[:probes]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = rows_of(batch.column(1).to_pylist(), dim)
                ids = np.array([x[0] for x in batch.column(2).to_pylist()])
                a, b, s = top_of(probe_rows, c, ids, keep)
                leaf = batch.column(3).to_numpy()
                same = np.array(batch.column(0).to_pylist(), object)[b] == np.array(probe_keys, object)[a]
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(s), pa.array(leaf[b]), pa.array(same.astype(bool))], names=["probe", "score", "leaf", "same"])

    widths, bounds = [tree.n_leaves], [-np.inf]
    if len(probe_rows):
        nearest = Window.partitionBy("probe").orderBy(F.desc("score"))
        true = indexed.mapInArrow(exact, "probe long, score double, leaf long, same boolean").filter("not same").withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= k).toArrow().to_pandas()
        order = [{leaf: i for i, leaf in enumerate(leaves)} for leaves in tree.best_bins(unit(probe_rows), tree.n_leaves)]
        true["place"] = [order[p][leaf] for p, leaf in zip(true.probe, true.leaf, strict=True)]
        widths, bounds = calibrated(true, tree.n_leaves, k, recall)

    queries = all_rows.filter(is_query(F.col("vec_id"))).distinct()
    asked, _ = stored(indexed.join(queries.select("key").distinct(), "key", "left_semi").select("key", "vector"), "queries")
    best = None
    todo, done = asked, 0
    for width, bound in zip(widths, bounds, strict=True):
        found = visit(todo, indexed, shared, bins, dim, done, width, keep, bin_rows)
        if best is not None:
            found = found.unionByName(best)
        nearest = Window.partitionBy("key").orderBy(F.desc("score"), "first_id")
        best, _ = stored(found.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= keep).drop("nth"), f"best{width}")
        if width == widths[-1]:
            break
        full = best.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("worst")).filter((F.col("n") >= keep) & (F.col("worst") >= float(bound)))
        todo, done = asked.join(full, "key", "left_anti"), width
    # A query's own row goes; it's among the first of its vector's ids, or not among the best at all.
    hits = best.select("key", "score", F.explode("ids").alias("vec_id"))
    rows = queries.select(F.col("vec_id").alias("query_id"), "key").join(hits, "key").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrated(true: pd.DataFrame, n_leaves: int, k: int, recall: float) -> tuple[list[int], list[float]]:
    """(widths, bounds): a query stops after a width if its worst kept score is at least the bound.

    true: probe, score and place (of the neighbour's leaf in the probe's visiting order) of the true neighbours.
    """
    places = np.sort(true.place.to_numpy())
    if not len(places):
        return [n_leaves], [-np.inf]
    last = int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) + 1
    last = min(n_leaves, last + last // 10 + 1)
    widths, bounds = [], []
    for width in sorted({max(1, n_leaves // 32), max(1, n_leaves // 8)}):
        if width >= last:
            break
        groups = true.assign(hit=true.place < width).groupby("probe")
        per = pd.DataFrame({"hits": groups.hit.mean(), "worst": groups.score.min()}).sort_values("worst", ascending=False)
        running = per.hits.expanding().mean()
        good = np.flatnonzero(running.to_numpy() >= (1 + recall) / 2)
        bound = float(per.worst.iloc[good[-1]]) if len(good) else np.inf
        if np.isfinite(bound):
            widths.append(width)
            bounds.append(bound)
    return [*widths, last], [*bounds, -np.inf]


def visit(queries: DataFrame, indexed: DataFrame, shared, bins, dim: int, done: int, width: int, keep: int, bin_rows: int) -> DataFrame:
    """The best of the leaves done..width of each query, bin by bin."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = bins.value
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            vectors = batch.column(1).to_pylist()
            if not vectors:
                continue
            for key, vector, leaves in zip(batch.column(0).to_pylist(), vectors, shared.value.best_bins(unit(rows_of(vectors, dim)), width), strict=True):
                by_bin: dict[int, list[int]] = {}
                for leaf in leaves[done:]:
                    for b in range(first[leaf], first[leaf] + parts[leaf]):
                        by_bin.setdefault(int(b), []).append(leaf)
                for b, mine in by_bin.items():
                    for column, value in zip(out, (b, key, vector, mine), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["bin", "key", "vector", "leaves"])

    dealt = queries.mapInArrow(deal, "bin long, key string, vector binary, leaves array<long>")
    # Blocks of queries, so that no bin meets more than about bin_rows at once.
    dealt, _ = stored(dealt, "dealt")
    blocks = dealt.groupBy("bin").agg(F.ceil(F.count("*") / bin_rows).cast("long").alias("blocks"))
    left = dealt.join(blocks, "bin").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))).drop("blocks")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = bins.value
        for batch in batches:
            leaf = batch.column(3).to_numpy()
            salt = np.array([hash(i[0]) for i in batch.column(2).to_pylist()], np.int64) if batch.num_rows else leaf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first[leaf] + np.mod(salt, parts[leaf]))], names=[*batch.schema.names, "bin"])

    right = indexed.mapInArrow(place, "key string, vector binary, ids array<long>, leaf long, bin long")
    right = right.join(blocks, "bin").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "score", "first_id", "ids"]
        if not len(q) or not len(c):
            return pd.DataFrame({n: [] for n in names})
        qs, cs, leaf = rows_of(q.vector, dim), rows_of(c.vector, dim), c.leaf.to_numpy()
        first_id = np.array([i[0] for i in c.ids])
        frames = []
        wanted: dict[tuple, list[int]] = {}
        for i, leaves in enumerate(q.leaves):
            wanted.setdefault(tuple(sorted(leaves)), []).append(i)
        for leaves, rows in wanted.items():
            inside = np.flatnonzero(np.isin(leaf, leaves))
            if len(inside):
                for start in range(0, len(rows), 512):
                    mine = np.array(rows[start : start + 512])
                    a, b, s = top_of(qs[mine], cs[inside], first_id[inside], keep)
                    b = inside[b]
                    frames.append(pd.DataFrame({"key": q.key.to_numpy()[mine[a]], "score": s, "first_id": first_id[b], "ids": c.ids.to_numpy()[b]}))
        return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({n: [] for n in names})

    pairs = left.groupBy("bin", "block").cogroup(right.groupBy("bin", "block"))
    return pairs.applyInPandas(compare, "key string, score double, first_id long, ids array<long>")


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    found = search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
