"""Centroid clustering with integer vectors, pruned by a pivot table (LAESA).

Every vector's distances to a few fixed pivots are computed once and stored beside it. In each
round the driver sends the centroids and their own distances to the pivots (``k`` rows, a
parameter). By the triangle inequality ``|d(x, p) - d(c, p)| <= d(x, c)``, so the largest
difference over the pivots bounds a centroid's distance from below: the centroid with the least
bound gets its exact distance first, and only centroids whose bound does not exceed it get theirs.
Exact distances are squared ones in integers; bounds are lowered by more than their rounding, so
neither the nearest centroid nor a tie is ever pruned. Tasks send one row of counts and component
sums each, which Spark adds by position.

The pivots are spread out over ``PIVOT_SAMPLE`` vectors (the least by a hash of their row), each
the farthest from those before it. They change how much is pruned, never a result.

Defined results: vectors that are null, of another length than ``dims``, or hold a null or
non-finite component take no part, nor do those with a scaled component of 2**27 or more, whose
squared distances may not fit a long. Rows that repeat a vec_id count each. A null vec_id takes
part but comes last among the starting centroids. Fewer vectors than ``k`` give fewer centroids;
ties go to the smaller centroid; an empty centroid stays where it was; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialize
from parlance.llm.vectors import matrix, scaled, summed, whole

#: Pivots, and the vectors they are chosen from.
PIVOTS, PIVOT_SAMPLE = 16, 1024
BOUND = float(1 << 27)
#: Numbers of a block of exact distances held at a time.
_BLOCK = 1 << 22


def integer_vectors(table: DataFrame, scale: int = 64, dims: int = 64, id_col: str = "vec_id",
                    vector: str = "embedding") -> DataFrame:
    """``id, x array<int>`` of the rows that take part."""
    v = F.col(vector)
    return table.where((F.size(v) == dims) & whole(v, scale, BOUND)).select(
        F.col(id_col).cast("long").alias("id"), scaled(v, scale).cast("array<int>").alias("x"))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a.astype(np.int64) - b.astype(np.int64)
    return np.einsum("ij,ij->i", d, d)


def to_points(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of every row to every point, as doubles."""
    return np.stack([np.sqrt(squares(x, p[None, :]).astype(np.float64)) for p in points], axis=1)


def nearest(x: np.ndarray, near: np.ndarray, c: np.ndarray, c_near: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each row's nearest centroid, its exact squared distance, and how many exact distances it
    took. ``near``, ``c_near``: distances to the pivots."""
    low = np.zeros((len(x), len(c)))
    for p in range(c_near.shape[1]):
        t, u = near[:, p, None], c_near[None, :, p]
        np.maximum(low, np.abs(t - u) - 1e-12 * (t + u), out=low)
    low *= low * (1 - 1e-12)
    each, first = np.arange(len(x)), low.argmin(1)
    best = squares(x, c[first])
    alive = low <= best[:, None]
    alive[each, first] = False
    exact = np.full(low.shape, np.iinfo(np.int64).max)
    exact[each, first] = best
    row, col = np.nonzero(alive)
    step = max(1, _BLOCK // x.shape[1])
    for i in range(0, len(row), step):
        r, k = row[i:i + step], col[i:i + step]
        exact[r, k] = squares(x[r], c[k])
    to = exact.argmin(1)
    return to, exact[each, to], alive.sum(1) + 1


def spread_pivots(x: np.ndarray, pivots: int) -> np.ndarray:
    """Rows far from one another: each the farthest from those before it."""
    at, far = [0], squares(x, x[:1])
    while len(at) < pivots and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, squares(x, x[at[-1]][None, :]))
    return x[at]


def pivot_table(vectors: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """``id, x, near`` written once, and the pivots."""
    some = vectors.select("x", F.xxhash64("id", "x").alias("h")).orderBy("h", "x").limit(PIVOT_SAMPLE).collect()
    points = spread_pivots(np.array([r["x"] for r in some], np.int64), pivots) if some else np.zeros((0, 1), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = to_points(matrix(b), points)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(list(near), pa.list_(pa.float64()))],
                                                 ["id", "x", "near"])
    return materialize(vectors.mapInArrow(run, "id long, x array<int>, near array<double>"), "pivot-table"), points


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the least hex sha256 of ``<seed>:<id>``, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    got = vectors.select(h.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r["x"] for r in got], np.int64)


def moved(table: DataFrame, points: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact ``floor(sum / count)`` of the vectors nearest to each."""
    k, dims = c.shape
    c_near = to_points(c, points)

    def partial(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b).astype(np.int64)
        to, _, _ = nearest(x, matrix(b, "near"), c, c_near)
        sums = np.zeros((k, dims + 1), np.int64)
        np.add.at(sums, to, np.column_stack([np.ones(len(x), np.int64), x]))
        return sums.ravel()

    sums = summed(table, partial, "long").reshape(k, dims + 1)
    return np.array([[s // row[0] for s in row[1:]] if row[0] else old for row, old in zip(sums, c.tolist())], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance, n_exact`` of every vector (written) and the final centroids."""
    v = materialize(vectors, "integer-vectors")
    c = first_centroids(v, k, seed)
    if not len(c):
        return v.sparkSession.createDataFrame([], "id long, cluster int, distance long, n_exact int"), c
    table, points = pivot_table(v, pivots)
    for _ in range(rounds):
        c = moved(table, points, c)
    c_near = to_points(c, points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                to, d, n = nearest(matrix(b), matrix(b, "near"), c, c_near)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(to, pa.int32()), pa.array(d), pa.array(n, pa.int32())],
                                                 ["id", "cluster", "distance", "n_exact"])
    return materialize(table.mapInArrow(run, "id long, cluster int, distance long, n_exact int"), "clusters"), c


def report(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1") -> DataFrame:
    """Per vector: its cluster, distance, both inertias, and the digest of its centroid."""
    found, c = cluster(vectors, k, rounds, seed)
    sums = {r["cluster"]: int(r["s"]) for r in
            found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(i, Decimal(s), hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i, s in sums.items()]
    spark, total = vectors.sparkSession, sum(sums.values())
    # one row a centroid
    facts = F.broadcast(spark.createDataFrame(rows, "cluster int, s decimal(38,0), centroid_sha256 string"))
    long = lambda v: F.expr(f"try_cast({v} AS BIGINT)")
    return found.join(facts, "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", long("s").alias("cluster_inertia"),
        long(f"CAST('{total}' AS DECIMAL(38,0))").alias("inertia"), "centroid_sha256", "n_exact")
