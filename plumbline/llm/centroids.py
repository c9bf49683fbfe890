"""Centroid clustering in exact integers, with centroids filtered by N-simplex projection.

Some vectors serve as pivots. Distances to n pivots, cached once a vector, make it the apex of a simplex over them: n - 1
coordinates in the pivots' span and a height above it. For two apexes, the distance with the difference of heights is a
lower bound of the true distance and that with their sum an upper one. In each round a vector's centroids whose lower
bound exceeds its least upper bound drop out; the others are compared exactly, in integers.

Rounds are jobs over a stored table of vectors with their apexes. Each task sums its vectors by centroid, so a shuffle
holds one row per task and centroid, and the driver one row per centroid.

Vectors that are null, of another dimension, hold a null or non-finite component or one of 131,072 or more in size (whose
squared distances needn't fit into a long) take no part. Rows that repeat an id count each; the first centroids are then
told apart by their components, and null ids come last. Fewer rows than centroids: each is one. Extra columns are
ignored. An empty table gives no rows. cluster_inertia and inertia are null where they don't fit into a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Shelf

#: Components are below this in size, so a squared distance of some hundred components fits into a long.
LARGEST = 131_072.0
#: Share of squared distances that rounding may cost a bound; see Simplex.
SLACK = 1e-4


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows (n, d) to integer rows (k, d)."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) * x.shape[1] ** 0.5 < 1 << 25:
        x, c = x.astype(np.float64), c.astype(np.float64)  # every sum stays below 2**53, where doubles are exact
        return ((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


class Simplex:
    """The base simplex of some pivots.

    Pivots that lie nearly in the span of those before them are left out, so that the triangular system has a condition
    below 10,000; rounding then changes coordinates by some 1e-11 of a vector's distance to the first pivot, heights by
    1e-5 of it at most, which SLACK exceeds.
    """

    def __init__(self, pivots: np.ndarray):
        self.pivots, self.base = pivots[:1], np.zeros((0, 0))
        for p in pivots[1:]:
            more = np.concatenate([self.pivots, p[None]])
            edges = (more[1:] - more[0]).astype(np.float64)
            base = np.linalg.qr(edges.T, mode="r").T if len(edges) <= edges.shape[1] else None
            if base is not None and np.abs(np.diag(base)).min() > 0 and np.linalg.cond(base) < 1e4:
                self.pivots, self.base = more, base

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """(coordinates in the span, height) of each row of x, from its distances to the pivots."""
        to = squared(x, self.pivots)
        far = squared(self.pivots[1:], self.pivots[:1])[:, 0]
        inner = (to[:, :1] + far - to[:, 1:]).astype(np.float64) / 2
        flat = np.linalg.solve(self.base, inner.T).T if len(far) else inner
        height = np.sqrt(np.maximum(to[:, 0] - (flat * flat).sum(1), 0))
        return np.concatenate([flat, height[:, None]], axis=1)


def near_enough(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For apexes of vectors and centroids: whether a centroid may be a vector's nearest."""
    flat = (a[:, :-1] ** 2).sum(1)[:, None] + (c[:, :-1] ** 2).sum(1) - 2 * (a[:, :-1] @ c[:, :-1].T)
    lower, upper = flat + (a[:, -1:] - c[:, -1]) ** 2, flat + (a[:, -1:] + c[:, -1]) ** 2
    scale = (a * a).sum(1)[:, None] + (c * c).sum(1)
    return lower - SLACK * scale <= (upper + SLACK * scale).min(1)[:, None]


def nearest(x: np.ndarray, a: np.ndarray, centroids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; the smaller number among equally near ones."""
    best, least = np.zeros(len(x), np.int32), np.full(len(x), np.iinfo(np.int64).max)
    for k, open_ in enumerate(near_enough(a, c).T):
        rows = np.flatnonzero(open_)
        d = squared(x[rows], centroids[k : k + 1])[:, 0]
        nearer = d < least[rows]
        best[rows[nearer]], least[rows[nearer]] = k, d[nearer]
    return best, least


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def whole_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """(vec_id, grid): floor(1024 * x) of the components of vectors that take part."""
    x = F.col("embedding")
    fits = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < LARGEST, F.lit(False)))
    grid = F.transform(x, lambda v: F.floor(v.cast("double") * 1024))
    return vectors.filter((F.size(x) == dimension) & fits).select(F.col("vec_id").cast("long").alias("vec_id"), grid.alias("grid"))


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, pivots: int = 16, dimension: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    The first centroids are the k vectors with the smallest sha256 of "seed:vec_id"; pivots come from the 4 * pivots
    smallest ones, without repetition.
    """
    spark, shelf = vectors.sparkSession, Shelf(vectors.sparkSession)
    grids = whole_vectors(vectors, dimension)
    order = (F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("grid"))
    first = np.array([r.grid for r in grids.orderBy(*order).limit(max(k, 4 * pivots)).collect()], np.int64).reshape(-1, dimension)
    centroids = first[:k]
    names = list(dict.fromkeys(map(tuple, first.tolist())))[:pivots]
    simplex = Simplex(np.array(names, np.int64)) if names else None

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dimension)
            if len(x):
                a = simplex.apexes(x)
                apexes = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), apexes], names=["vec_id", "grid", "apex"])

    rows = shelf.put(grids.mapInArrow(projected, "vec_id long, grid array<long>, apex array<double>"), "apexes")
    totals = [f"s{i}" for i in range(dimension)]

    def assigned(batch: pa.RecordBatch, centroids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = matrix(batch.column(1), dimension)
        return x, *nearest(x, matrix(batch.column(2), c.shape[1]), centroids, c)

    def summed(centroids: np.ndarray, c: np.ndarray):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dimension), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x, best, _ = assigned(batch, centroids, c)
                    count += np.bincount(best, minlength=len(centroids))
                    for j in range(len(centroids)):
                        total[j] += x[best == j].sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids)), pa.int32()), pa.array(count), *map(pa.array, total.T)], names=["cluster", "n", *totals])

        return sums

    schema = ", ".join(["cluster int, n long", *(f"{s} long" for s in totals)])
    for _ in range(rounds if len(centroids) else 0):
        sums = rows.mapInArrow(summed(centroids, simplex.apexes(centroids)), schema)
        exact = sums.groupBy("cluster").agg(*(F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in ["n", *totals])).filter("n > 0")
        centroids = centroids.copy()
        for r in exact.collect():
            centroids[r.cluster] = [int(r[s]) // int(r.n) for s in totals]
    c = simplex.apexes(centroids) if len(centroids) else None

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, best, distance = assigned(batch, centroids, c)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    out = shelf.put(rows.mapInArrow(last, "vec_id long, cluster int, distance long"), "assigned")
    shelf.keep(out)
    inertia = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fit = lambda n: n if n < 1 << 63 else None
    told = [(j, fit(n), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, n in inertia.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds from eight seeds."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds, one after the other."""
    ctes = [
        """v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x) AND abs(x::DOUBLE) < 131072)) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), x) - 1 AS j, x AS c FROM v ORDER BY j LIMIT {k})",
    ]
    for i in range(rounds + 1):
        exact = "list_sum(list_transform(range(1, 65), lambda i: ((v.x[i] - c.c[i]) * (v.x[i] - c.c[i]))::HUGEINT))"
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, min([d, j]) AS m FROM (SELECT v.r, c.j::HUGEINT AS j, {exact} AS d FROM v, c{i} c) GROUP BY r)")
        if i < rounds:
            ctes.append(f"s{i} AS (SELECT m[2] AS j, p, sum(y) AS s, count(*) AS n FROM (SELECT r, m, unnest(x) AS y, generate_subscripts(x, 1) AS p FROM v JOIN a{i} USING (r)) GROUP BY ALL)")
            floor = "((s - (((s % n) + n) % n)) // n)::BIGINT"
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT j, list({floor} ORDER BY p) AS c FROM s{i} GROUP BY j) n ON n.j = c.j)")
    last = f"""SELECT vec_id, m[2]::INT AS cluster, m[1]::BIGINT AS distance, (sum(m[1]) OVER (PARTITION BY m[2]))::BIGINT AS cluster_inertia, (sum(m[1]) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (r) JOIN c{rounds} c ON c.j = m[2]"""
    return f"WITH {', '.join(ctes)} {last}"
