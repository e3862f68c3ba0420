"""op11 and op13 against brute force, and on odd rows."""

import hashlib
import math

import numpy as np
import pytest

from parlance.llm import centroids, whitening
from parlance.llm.vectors import scaled, whole

VEC = "vec_id long, embedding array<float>, id long, x string, near int, cluster string, n int, component int"


@pytest.fixture()
def vecs(llm):
    """Rows of ``embeddings`` with extra columns whose names the operators use inside."""
    def make(rows):
        return llm.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], 1, "x", 2, "c", 3, 4)
                                    for i, v in rows], VEC)
    return make


def blobs(n, dims, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    mid = rng.standard_normal((6, dims))
    return (mid[rng.integers(0, 6, n)] + spread * rng.standard_normal((n, dims))).astype(np.float32)


def odd(dims):
    """Nulls, wrong lengths, non-finite components, repeated rows, ties, extremes, null ids."""
    one = [0.25] * dims
    return [(None, one), (None, [-0.25] * dims), (901, None), (902, []), (903, [1.0] * (dims - 1)), (904, one[:-1] + [None]),
            (905, one[:-1] + [math.nan]), (906, one[:-1] + [math.inf]), (907, one), (907, one), (908, [0.0] * dims),
            (909, [-0.0] * dims), (910, [-1e6] * dims), (911, [1e6] + [0.0] * (dims - 1)), (-5, [-1 / 64] * dims)]


def brute_clusters(rows, k=16, rounds=3):
    keep = [(i, [math.floor(64 * c) for c in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(keep, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, p)), j) for j, p in enumerate(c)) for _, v in keep]
    for _ in range(rounds):
        to = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, t) in zip(keep, to) if t == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    to = assign()
    inertia = {j: sum(d for d, t in to if t == j) for j in range(len(c))}
    return sorted(((-1 if i is None else i), t, d, inertia[t], sum(inertia.values()),
                   hashlib.sha256(",".join(map(str, c[t])).encode()).hexdigest()) for (i, _), (d, t) in zip(keep, to))


def found(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in df.collect())


def test_clusters_equal_brute_force(vecs):
    rows = [(i, v.tolist()) for i, v in enumerate(blobs(300, 64, 1))] + odd(64)
    assert found(centroids.report(centroids.integer_vectors(vecs(rows)))) == brute_clusters(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(3, [0.5] * 64), (3, [0.5] * 64), (None, [0.5] * 64)]])
def test_few_vectors(vecs, rows):
    assert found(centroids.report(centroids.integer_vectors(vecs(rows)))) == brute_clusters(rows)


def test_nearest_prunes_and_keeps_ties():
    rng = np.random.default_rng(3)
    x = np.floor(64 * blobs(400, 16, 2)).astype(np.int64)
    c = np.concatenate([x[:12], x[:4], x[100:108] + 1])  # equal centroids tie
    p = centroids.spread_pivots(x[rng.permutation(400)[:64]], 8)
    to, d, n = centroids.nearest(x, centroids.to_points(x, p), c, centroids.to_points(c, p))
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (to == full.argmin(1)).all() and (d == full.min(1)).all()
    assert n.mean() < len(c) / 2 and n.min() >= 1


def test_pivots_change_no_result(vecs):
    rows = [(i, v.tolist()) for i, v in enumerate(blobs(120, 64, 5, 0.5))]
    got = [sorted(tuple(r)[:3] for r in centroids.cluster(centroids.integer_vectors(vecs(rows)), pivots=p)[0].collect())
           for p in (1, 16)]
    assert got[0] == got[1]


def test_distances_stay_exact_at_the_bound():
    far = np.full((1, 64), (1 << 27) - 1, np.int64)
    assert centroids.squares(far, -far)[0] == 64 * (2 * ((1 << 27) - 1)) ** 2


def test_scaling_and_filter(vecs):
    df = vecs([(1, [0.3, -0.3, -0.0]), (2, [math.nan]), (3, [None]), (4, None), (5, [-math.inf]), (6, [])])
    got = {r.vec_id: (r.ok, r.v) for r in df.select("vec_id", whole(df.embedding, 256, 2.0 ** 62).alias("ok"),
                                                  scaled(df.embedding, 256).alias("v")).where("vec_id not in (2, 3, 5)").collect()}
    assert got[1] == (True, [math.floor(256 * float(np.float32(0.3))), math.floor(-256 * float(np.float32(0.3))), 0])
    assert got[4][0] is False and got[6] == (True, [])
    assert df.where(whole(df.embedding, 256, 2.0 ** 62)).count() == 2


def brute_whitening(rows, components=4):
    keep = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in keep]
    dims = max(set(sizes), key=lambda s: (sizes.count(s), s))
    keep = [(i, v) for i, v in keep if len(v) == dims]
    fit = np.array(sorted({tuple(v) for _, v in keep}), object)
    n, s = len(fit), fit.sum(0)
    y = np.array((n * fit - s) / n, np.float64)
    e, q = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:components]
    out = {}
    for i, v in keep:
        d = n * np.array(v, object) - s
        w = np.array(d / n, np.float64) @ q[:, order] / np.sqrt(e[order])
        out.setdefault(i, []).append((int((d * d).sum()), np.abs(w)))
    return n, e[order] / e.sum(), out


@pytest.mark.parametrize("dims,n", [(64, 300), (40, 500), (8, 60)])
def test_whitening_equals_brute_force(vecs, dims, n):
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((n, dims)) @ np.diag(1 + 0.2 * rng.random(dims))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))] + [r for r in odd(dims) if r[0] not in (910, 911)]
    count, explained, want = brute_whitening(rows)
    got = whitening.whiten(whitening.integer_vectors(vecs(rows))).collect()
    assert len(got) == 4 * sum(map(len, want.values()))
    for r in got:
        some = [w for w in want[r.vec_id] if w[0] == r.deviation]
        assert some and r.n == count and r.identity_error < 1e-10 and r.residual <= whitening.TOL
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-10
        assert min(abs(abs(r.whitened) - w[1][r.component - 1]) for w in some) < 1e-8


def test_one_sign_for_all_rows(vecs):
    rows = [(i, v.tolist()) for i, v in enumerate(blobs(200, 16, 9, 1.0))]
    got = whitening.whiten(whitening.integer_vectors(vecs(rows))).collect()
    w = np.array([[r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == k] for k in (1, 2, 3, 4)])
    assert np.abs(w @ w.T / 200 - np.eye(4)).max() < 1e-10 and np.abs(w.mean(1)).max() < 1e-10


def test_flat_directions_and_equal_eigenvalues(vecs):
    line = [(i, [float(i), 1.0, 0.0, -2.0 * i, 5.0, 7.0]) for i in range(50)]
    got = whitening.whiten(whitening.integer_vectors(vecs(line))).collect()
    assert {r.component for r in got} == {1} and len(got) == 50 and abs(got[0].explained - 1) < 1e-12
    cross = [(2 * j + (s > 0), [s * (i == j) for i in range(48)]) for j in range(48) for s in (1.0, -1.0)]
    flat = whitening.whiten(whitening.integer_vectors(vecs(cross))).collect()
    assert len(flat) == 4 * 96 and max(r.identity_error for r in flat) < 1e-10
    assert whitening.whiten(whitening.integer_vectors(vecs([(1, [1.0, 2.0]), (2, [1.0, 2.0])]))).count() == 0
    assert whitening.whiten(whitening.integer_vectors(vecs([]))).count() == 0
    assert whitening.whiten(whitening.integer_vectors(vecs([(1, None), (2, []), (3, [math.nan])]))).count() == 0


def test_close_eigenvalues_are_certified():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((96, 96)))[0]
    for values in (1 + 1e-3 * np.arange(96), np.r_[np.ones(90), 2 + 1e-6 * np.arange(6)], np.r_[np.zeros(95), 1.0],
                   np.geomspace(1e-12, 1e6, 96), np.ones(96)):
        v = (q * values) @ q.T
        vec, val, res = whitening.leading(lambda b, v=v: v @ b, 96, 4)
        want = np.sort(values)[::-1][:4]
        assert res <= whitening.TOL and np.abs(val - want).max() <= 1e-12 * want[0]
        assert np.linalg.norm(v @ vec - vec * val, axis=0).max() <= 2 * whitening.TOL * want[0]


def test_deviations_are_exact():
    x = np.array([[3, -4], [1 << 40, -(1 << 40)]], np.int64)
    sums = [10, -(1 << 41)]
    want = [sum((7 * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    assert whitening.deviations(x, 7, sums) == [w if w < 1 << 63 else None for w in want]
    assert whitening.deviations(x[:1], 7, [1, 2]) == [(21 - 1) ** 2 + (-28 - 2) ** 2]
