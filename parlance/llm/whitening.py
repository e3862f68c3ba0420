"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers ``x``; the fit list holds each distinct one once. Its covariance ``V`` is
never formed: a pass over the fit list gives ``V Q = (x - S/n)' ((x - S/n) Q) / n`` for a block ``Q``
of a few columns, centred before it is multiplied, and the driver holds matrices of ``dims`` by
``block`` at most. One round

1. damps the unwanted part ``[low, theta_m]`` of the spectrum by a Chebyshev polynomial of ``V``, by
   its three-term recurrence, one pass a degree (``low`` from a short Lanczos run, ``theta_m`` the
   least Ritz value of the block);
2. orthonormalises the block (QR), passes once more and solves the small Rayleigh-Ritz problem;
3. certifies the wanted pairs by their residuals ``|V q - theta q|``, each at most ``TOL * theta_1``;
   an eigenvector is then right to its residual over the gap to the next eigenvalue.

Rounds end when all wanted pairs are certified; ``ROUNDS`` without that is an error, not a result.

Defined results: vectors that are null, hold a null or non-finite component, or one whose scaled
value is 2**62 or more, take no part, nor do vectors of another length than the most common one
(the longer among equally common). Repeated rows and rows with a null vec_id each get their rows,
and count once in the fit. A component along which the fit list does not vary (an eigenvalue not
above ``RANK`` times the trace) can't be scaled to unit variance and is left out; so one distinct
vector gives no rows, nor does an empty table. Components with equal eigenvalues may be any basis.
A ``deviation`` that no long holds is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialize
from parlance.llm.vectors import matrix, scaled, summed, whole

#: Columns of the block beside the wanted ones, degree of the filter, steps of the Lanczos run.
EXTRA, DEGREE, LANCZOS = 28, 10, 12
TOL, RANK, ROUNDS = 1e-13, 1e-12, 60


@dataclass
class Fit:
    """What whitening needs: count and sums of the fit list, components and their eigenvalues."""
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int


def integer_vectors(table: DataFrame, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, x array<long>`` of the rows that take part, written."""
    v = F.col(vector)
    rows = materialize(table.where(whole(v, scale, 2.0 ** 62)).select(
        F.col(id_col).cast("long").alias("id"), scaled(v, scale).alias("x")), "integer-rows")
    size = rows.groupBy(F.size("x").alias("s")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("s")).limit(1).collect()
    return rows.where(F.size("x") == (size[0]["s"] if size else 0))


def centre(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """``x - S/n`` in double precision: whole part in integers, then the fraction."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - base).astype(np.float64) - rest


def lowest(apply: Callable[[np.ndarray], np.ndarray], dims: int, steps: int, rng: np.random.Generator) -> float:
    """An estimate from below of the least eigenvalue, by a short Lanczos run; 0 at least."""
    q = rng.standard_normal((dims, 1))
    basis, diag, off = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, dims)):
        w = apply(basis[-1])
        diag.append((basis[-1].T @ w).item())
        for _ in range(2):
            for b in basis:
                w = w - b * (b.T @ w)
        off.append(np.linalg.norm(w).item())
        if off[-1] <= 1e-12 * max(diag):
            break
        basis.append(w / off[-1])
    k = len(diag)
    values, vectors = np.linalg.eigh(np.diag(diag) + np.diag(off[:k - 1], 1) + np.diag(off[:k - 1], -1))
    return max(0.0, values[0] - abs(off[k - 1] * vectors[-1, 0]))


def filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, high: float,
             top: float, degree: int) -> np.ndarray:
    """Scaled Chebyshev polynomial of the operator times ``q``; small on ``[low, high]``, 1 at
    ``top``. ``vq``: the operator times ``q``."""
    half, mid = (high - low) / 2, (high + low) / 2
    s = first = half / (top - mid)
    x, y = q, (vq - mid * q) * (s / half)
    for _ in range(degree - 1):
        nxt = 1 / (2 / first - s)
        x, y = y, (apply(y) - mid * y) * (2 * nxt / half) - s * nxt * x
        s = nxt
    return y


def leading(apply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Certified leading eigenpairs of a positive semidefinite operator: vectors, values, and the
    largest residual over the first eigenvalue."""
    rng, wanted = np.random.default_rng(seed), min(wanted, dims)
    q = np.linalg.qr(rng.standard_normal((dims, min(dims, wanted + EXTRA))))[0]
    low = None
    for _ in range(ROUNDS):
        vq = apply(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = values[0]
        if top <= 0:
            return q[:, :0], values[:0], 0.0
        residual = (np.linalg.norm(vq - q * values, axis=0)[:wanted].max() / top).item()
        if residual <= TOL:
            return q[:, :wanted], values[:wanted], residual
        if low is None:
            low = lowest(apply, dims, LANCZOS, rng)
        high = max(values[-1], 0.0)
        floor = low if high - low > 1e-6 * top else 0.0
        if high - floor <= 1e-9 * top:  # the rest is flat or zero: a plain power step
            q = vq
        else:
            q = filtered(apply, q, vq, floor, high, top, DEGREE)
        q = np.linalg.qr(q)[0]
    raise RuntimeError(f"components not certified after {ROUNDS} rounds: residual {residual:.2e}")


def fit(vectors: DataFrame, components: int = 4) -> tuple[Fit, DataFrame] | None:
    """Leading components of the distinct ``x`` of ``vectors``, and that fit list (written); None
    without vectors."""
    distinct = materialize(vectors.select("x").distinct(), "fit-list")

    def halves(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b)  # two halves, so that no task's sum leaves a long
        return np.concatenate([[len(x)], (x >> 31).sum(0), (x & 0x7FFFFFFF).sum(0)])

    got = summed(distinct, halves, "long")
    if got is None:
        return None
    n, dims = got[0], (len(got) - 1) // 2
    sums = [(a << 31) + b for a, b in zip(got[1:dims + 1], got[dims + 1:])]
    centred, passes = centre(n, sums), 1
    trace = summed(distinct, lambda b: np.array([np.square(centred(matrix(b))).sum()]), "double")[0] / n

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def partial(b: pa.RecordBatch) -> np.ndarray:
            y = centred(matrix(b))
            return (y.T @ (y @ q)).ravel()
        return summed(distinct, partial, "double").reshape(q.shape) / n

    if trace <= 0:
        vectors_, values, residual = np.zeros((dims, 0)), np.zeros(0), 0.0
    else:
        vectors_, values, residual = leading(apply, dims, components)
        some = values > RANK * trace
        vectors_, values = vectors_[:, some], values[some]
    return Fit(n, sums, vectors_, values, float(trace), residual, passes), distinct


def identity_error(distinct: DataFrame, f: Fit) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    centred, p, k = centre(f.n, f.sums), f.components / np.sqrt(f.values), len(f.values)

    def partial(b: pa.RecordBatch) -> np.ndarray:
        w = centred(matrix(b)) @ p
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    got = summed(distinct, partial, "double") / f.n
    cov = got[k:].reshape(k, k) - np.outer(got[:k], got[:k])
    return float(np.abs(cov - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact ``sum((n x - S)^2)`` of every row; in longs where they are sure to hold it."""
    reach = float(n) * float(max(abs(int(x.max())), abs(int(x.min())))) + float(max(map(abs, sums)))
    kind = np.int64 if x.shape[1] * reach * reach < 2.0 ** 62 else object
    d = n * x.astype(kind) - np.array(sums, kind)
    return [v if v < 1 << 63 else None for v in (d * d).sum(1).tolist()]


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """Per vector and component: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``, with ``residual`` and ``passes`` of the iteration."""
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double, residual double, passes int")
    got = fit(vectors, components)
    if got is None or not len(got[0].values):
        return vectors.sparkSession.createDataFrame([], schema)
    f, distinct = got
    error = identity_error(distinct, f)
    centred, p, k = centre(f.n, f.sums), f.components / np.sqrt(f.values), len(f.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b)
                rows = np.repeat(np.arange(len(x)), k)
                size = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                     pa.array(np.full(size, f.n)), pa.array(deviations(x, f.n, f.sums), pa.int64()).take(pa.array(rows)),
                     pa.array((centred(x) @ p).ravel()), pa.array(np.tile(f.values / f.trace, len(x))),
                     pa.array(np.full(size, error)), pa.array(np.full(size, f.residual)),
                     pa.array(np.full(size, f.passes), pa.int32())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual", "passes"])
    return vectors.mapInArrow(run, schema)
