"""Approximate nearest neighbours by inner product: NN-descent graph and greedy graph search.

The graph keeps ``degree`` neighbours of every vector. It starts from random-projection leaves
and is improved in rounds of Spark joins: a vector's neighbours (forward and a sample of reverse
ones) meet in the vector's block, are compared with one another, and what is nearer than a
neighbour's worst is sent to that neighbour. A block holds ``BLOCK`` vectors and receives each
neighbour's vector once, so no task grows with the input. Search walks the graph from each
query's own neighbours and from the best of the ``HUBS`` longest vectors, which all queries are
compared with: a long vector may have a large product with a query at any angle, and no cosine list
leads to it. Every step joins unvisited nodes of all queries, half of them the best by product and
half by cosine, to their neighbour lists, and the block of a query scores them. A query remembers
the ``POOL`` best by either measure.

Building uses unit-length vectors in eight bits (nearness of the graph: cosine); the scores
returned are inner products of the original vectors in double precision.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with
a null id, take no part; rows that repeat a vec_id count once (the least vector); vectors of other
lengths than the most common one take no part; fewer candidates than ``k`` give fewer rows; ties
go to the smaller vec_id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialize

DEGREE, ROUNDS, TREES, LEAF, BLOCK = 48, 4, 6, 300, 2000
#: Per node and round: forward and reverse neighbours that are compared with one another.
SAMPLE = 32
#: Best pairs that one meeting sends to one neighbour, and that a block sends to one vector.
SEND, SEND_BLOCK = 6, 12
#: Longest vectors that every query starts from, and nodes a query remembers by each measure. The
#: driver holds ``HUBS`` vectors in bytes, whatever the table's size.
HUBS, POOL = 4096, 256


def meet(own: np.ndarray, fresh: np.ndarray, vec: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, ...]:
    """One block's meetings. ``own`` (rows of indices into ``vec``, -1: none), ``fresh`` (which
    of them are new). Returns ``(a, b, score)`` with score above ``worst[a]``."""
    out_a, out_b, out_s = [], [], []
    for row, new in zip(own, fresh):
        ok = row >= 0
        i, f = row[ok], new[ok]
        if len(i) < 2 or not f.any():
            continue
        s = vec[i] @ vec[i].T
        s[~(f[:, None] | f[None, :]) | (s <= worst[i][:, None])] = -2
        np.fill_diagonal(s, -2)
        t = min(SEND, len(i) - 1)
        top = np.argpartition(-s, t - 1, axis=1)[:, :t]
        best = np.take_along_axis(s, top, 1)
        hit = best > -2
        out_a.append(np.repeat(i, hit.sum(1)))
        out_b.append(i[top[hit]])
        out_s.append(best[hit])
    if not out_a:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.float32)
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_s)


def best_of(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` largest distinct ``b`` of each ``a``, sorted by ``a`` and falling score."""
    o = np.lexsort((b, -s, a))
    a, b, s = a[o], b[o], s[o]
    _, first = np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_index=True)
    keep = np.sort(first)
    a, b, s = a[keep], b[keep], s[keep]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    return a[rank < k], b[rank < k], s[rank < k]


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v array<double>`` of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = table.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"), bad.alias("bad"), F.exists(v, lambda x: x != 0).alias("some"))
    d = d.where(~F.col("bad") & F.col("some")).groupBy("id").agg(F.min("v").alias("v"))
    size = d.groupBy(F.size("v").alias("s")).agg(F.count("id").alias("c")).orderBy(F.desc("c"), "s").limit(1).collect()
    return d.where(F.size("v") == (size[0]["s"] if size else 0))


def _eight_bits(vectors: DataFrame) -> DataFrame:
    """``id, q`` (unit vector in signed bytes) and ``norm``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                big = np.abs(m).max(1, keepdims=True)
                with np.errstate(over="ignore"):
                    norm = np.minimum(big[:, 0] * np.linalg.norm(m / big, axis=1), np.finfo(np.float64).max)
                q = np.round(m / big * 127).astype(np.int8)
                yield pd.DataFrame({"id": pdf["id"], "q": [x.tobytes() for x in q], "norm": norm})
    return vectors.mapInPandas(run, "id long, q binary, norm double")


def _matrix(raw) -> np.ndarray:
    m = np.stack([np.frombuffer(x, np.int8) for x in raw]).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _block(c: str, blocks: int):
    return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")


LISTS = "id long, nb array<long>, sc array<float>, fresh array<boolean>"
_NO_LISTS = pd.DataFrame({c: pd.Series(dtype=object) for c in ("id", "nb", "sc", "fresh")})


def _leaves(eight: DataFrame, dim: int, n: int) -> DataFrame:
    """First neighbour lists: exact neighbours within random-projection leaves of about ``LEAF``
    vectors (``TREES`` of them) and within one random deal, which gives every vector neighbours."""
    depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    planes = np.random.default_rng(7).standard_normal((TREES, dim, max(depth, 1))).astype(np.float32)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = _matrix(pdf["q"])
                for t in range(TREES):
                    c = ((m @ planes[t] > 0) @ (1 << np.arange(planes.shape[2]))).astype(np.int64) if depth else 0
                    yield pd.DataFrame({"tree": t, "leaf": c, "id": pdf["id"], "q": pdf["q"]})
                yield pd.DataFrame({"tree": TREES, "leaf": 0, "id": pdf["id"], "q": pdf["q"]})

    rows = materialize(eight.select("id", "q").mapInPandas(code, "tree int, leaf long, id long, q binary"), "leaves")
    sizes = rows.groupBy("tree", "leaf").agg(F.ceil(F.count("id") / LEAF).alias("pieces"))
    rows = rows.join(sizes, ["tree", "leaf"]).withColumn("piece", F.pmod(F.xxhash64("id", "tree"), F.col("pieces")))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, m = pdf["id"].to_numpy(), _matrix(pdf["q"])
        s = m @ m.T
        np.fill_diagonal(s, -2)
        t = min(DEGREE // 2, len(ids) - 1)
        if not t:
            return _NO_LISTS
        top = np.argpartition(-s, t - 1, axis=1)[:, :t]
        best = np.take_along_axis(s, top, 1)
        return pd.DataFrame({"id": ids, "nb": list(ids[top]), "sc": list(best), "fresh": list(np.ones(top.shape, bool))})
    return _merged(rows.select("tree", "leaf", "piece", "id", "q").groupBy("tree", "leaf", "piece").applyInPandas(near, LISTS))


def _merged(lists: DataFrame) -> DataFrame:
    """The ``DEGREE`` best of each id's lists (one list may be the old one: it is never fresh
    where another names the same neighbour)."""
    g = lists.groupBy("id").agg(F.flatten(F.collect_list("nb")).alias("nb"), F.flatten(F.collect_list("sc")).alias("sc"),
                                F.flatten(F.collect_list("fresh")).alias("fresh"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            nb, sc, fr = [], [], []
            for b, s, f in zip(pdf["nb"], pdf["sc"], pdf["fresh"]):
                o = np.lexsort((f, b))
                b, s, f = np.asarray(b)[o], np.asarray(s)[o], np.asarray(f)[o]
                one = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
                b, s, f = b[one], s[one], f[one]
                o = np.lexsort((b, -s))[:DEGREE]
                nb.append(b[o])
                sc.append(s[o])
                fr.append(f[o])
            yield pd.DataFrame({"id": pdf["id"], "nb": nb, "sc": sc, "fresh": fr})
    return g.mapInPandas(run, LISTS)


def _round(graph: DataFrame, eight: DataFrame, blocks: int, seed: int) -> DataFrame:
    def propose(batches: Iterator[pd.DataFrame], spent: bool) -> Iterator[pd.DataFrame]:
        """Picks of each list, fresh ones first, then in a deal that differs by round; or the
        list with its picks no longer fresh."""
        for pdf in batches:
            own, v, new, out = [], [], [], []
            for i, b, f in zip(pdf["id"], pdf["nb"], pdf["fresh"]):
                b, f = np.asarray(b), np.asarray(f, bool)
                deal = (b * 0x9E3779B1 + i * 0x85EBCA77 + seed) & 0xFFFFFFFF
                pick = np.lexsort((deal, ~f))[:SAMPLE]
                if spent:
                    f = f.copy()
                    f[pick] = False
                    out.append(f)
                else:
                    own.append(np.full(len(pick), i))
                    v.append(b[pick])
                    new.append(f[pick])
            if spent:
                yield pdf.assign(fresh=out)
            elif own:
                yield pd.DataFrame({"own": np.concatenate(own), "v": np.concatenate(v), "fresh": np.concatenate(new)})
    picks = materialize(graph.mapInPandas(lambda it: propose(it, False), "own long, v long, fresh boolean"), "picks")
    from pyspark.sql import Window
    w = Window.partitionBy("own").orderBy(F.desc("fresh"), F.xxhash64("own", "v", F.lit(seed)))
    back = (picks.select(F.col("v").alias("own"), F.col("own").alias("v"), "fresh")
            .withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLE).drop("r"))
    rows = picks.unionAll(back).groupBy("own", "v").agg(F.max("fresh").alias("fresh")).withColumn("blk", _block("own", blocks))
    rows = materialize(rows, "meetings")
    worst = graph.select("id", F.when(F.size("sc") >= DEGREE, F.array_min("sc")).otherwise(-2.0).cast("float").alias("worst"))
    need = rows.select("blk", F.col("v").alias("id")).distinct().join(eight.select("id", "q"), "id").join(worst, "id")
    both = rows.select("blk", F.col("own").alias("id"), "v", "fresh", F.lit(None).cast("binary").alias("q"), F.lit(None).cast("float").alias("worst")).unionByName(
        need.select("blk", "id", F.lit(None).cast("long").alias("v"), F.lit(None).cast("boolean").alias("fresh"), "q", "worst"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        vec = pdf[pdf["q"].notna()].sort_values("id")
        ids, m = vec["id"].to_numpy(), _matrix(vec["q"])
        e = pdf[pdf["q"].isna()].sort_values("id")
        at = np.searchsorted(ids, e["v"].to_numpy().astype(np.int64))
        own, fresh = e["id"].to_numpy(), e["fresh"].to_numpy().astype(bool)
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        a, b, s = meet(np.split(at, start[1:]), np.split(fresh, start[1:]), m, vec["worst"].to_numpy())
        a, b, s = best_of(a, b, s, SEND_BLOCK)
        if not len(a):
            return _NO_LISTS
        cut = np.flatnonzero(a[1:] != a[:-1]) + 1
        return pd.DataFrame({"id": ids[a[np.r_[0, cut]]], "nb": np.split(ids[b], cut), "sc": np.split(s, cut),
                             "fresh": np.split(np.ones(len(b), bool), cut)})
    found = both.groupBy("blk").applyInPandas(block, LISTS)
    spent = graph.mapInPandas(lambda it: propose(it, True), LISTS)
    return materialize(_merged(spent.unionByName(found)), "graph")


def neighbour_graph(eight: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``id, nb, sc, fresh``: nearest neighbours of every vector, best first."""
    n = eight.count()
    first = eight.select(F.octet_length("q").alias("d")).first()
    if first is None:
        return eight.sparkSession.createDataFrame([], LISTS)
    blocks = max(1, -(-n // BLOCK))
    graph = materialize(_leaves(eight, first["d"], n), "graph")
    for r in range(rounds):
        graph = _round(graph, eight, blocks, r)
    return graph


STATE = "id long, nb array<long>, sc array<float>, p array<double>, done array<boolean>"
FIELDS = ["id", "nb", "sc", "p", "done"]


def _pool(nb: np.ndarray, sc: np.ndarray, p: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``POOL`` best by product and those by cosine, ties to the smaller id."""
    if len(nb) > POOL:
        keep = np.unique(np.r_[np.lexsort((nb, -p))[:POOL], np.lexsort((nb, -sc))[:POOL]])
        nb, sc, p, done = nb[keep], sc[keep], p[keep], done[keep]
    return nb, sc, p, done


def _front(nb, sc, p, done, width: int) -> np.ndarray:
    """Places of the unvisited nodes to visit: half the best by product, then the best by cosine of
    those left."""
    nb, sc, p = np.asarray(nb), np.asarray(sc), np.asarray(p)
    open_ = np.flatnonzero(~np.asarray(done, bool))
    first = open_[np.lexsort((nb[open_], -p[open_]))[:width // 2]]
    rest = np.setdiff1d(open_, first)
    return np.r_[first, rest[np.lexsort((nb[rest], -sc[rest]))[:width - len(first)]]]


def _starts(graph: DataFrame, eight: DataFrame, queries: DataFrame) -> DataFrame:
    """``STATE`` of every query: its own neighbours and its best hubs."""
    lens = eight.select(F.col("id").alias("b"), "norm")
    own = graph.join(queries, "id").select("id", F.explode(F.arrays_zip("nb", "sc")).alias("x"))
    own = own.select("id", F.col("x.nb").alias("b"), "x.sc").join(lens, "b").groupBy("id").agg(
        F.collect_list(F.struct("b", "sc", "norm")).alias("l")).select(
        "id", F.col("l.b").alias("nb"), F.col("l.sc").alias("sc"), F.col("l.norm").alias("norm"))
    hubs = eight.orderBy(F.desc("norm"), "id").limit(HUBS).collect()  # bounded by HUBS
    if not hubs:
        return eight.sparkSession.createDataFrame([], STATE)
    hub, hub_norm, hub_q = np.array([r["id"] for r in hubs]), np.array([r["norm"] for r in hubs]), [bytes(r["q"]) for r in hubs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = _matrix(hub_q)
        for pdf in batches:
            out = []
            if len(pdf):
                cos = _matrix(pdf["q"]) @ h.T
                for i, nb, sc, norm, c in zip(pdf["id"].tolist(), pdf["nb"], pdf["sc"], pdf["norm"], cos):
                    nb, sc, norm = (np.zeros(0, t) if x is None else np.asarray(x, t)
                                   for x, t in ((nb, np.int64), (sc, np.float32), (norm, np.float64)))
                    new = (hub != i) & ~np.isin(hub, nb)
                    nb, sc, p = np.r_[nb, hub[new]], np.r_[sc, c[new]], np.r_[sc * norm, (c * hub_norm)[new]]
                    out.append((i, *_pool(nb, sc, p, np.zeros(len(nb), bool))))
            yield pd.DataFrame(out, columns=FIELDS)
    asked = eight.join(queries, "id").select("id", "q").join(own, "id", "left")
    return asked.select("id", "q", "nb", "sc", "norm").mapInPandas(run, STATE)


def _step(state: DataFrame, graph: DataFrame, eight: DataFrame, blocks: int, width: int) -> DataFrame:
    """Every query visits ``width`` unvisited nodes."""
    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, node = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, nb, sc, p, done in zip(*[pdf[c] for c in FIELDS]):
                go = _front(nb, sc, p, done, width)
                own.append(np.full(len(go), i, np.int64))
                node.append(np.asarray(nb, np.int64)[go])
            yield pd.DataFrame({"id": np.concatenate(own), "node": np.concatenate(node)})
    asked = state.mapInPandas(visits, "id long, node long").select(_block("id", blocks).alias("blk"), "node").distinct()
    lists = materialize(asked.join(graph.select(F.col("id").alias("node"), "nb"), "node"), "visited")
    blk = _block("id", blocks).alias("blk")
    want = lists.select("blk", F.explode("nb").alias("id")).unionAll(state.select(blk, "id")).distinct()
    vecs = want.join(eight, "id")
    kinds = {"blk": "int", "kind": "int", "id": "long", "nb": "array<long>", "sc": "array<float>", "p": "array<double>",
             "done": "array<boolean>", "q": "binary", "norm": "double"}
    parts = [state.select(blk, F.lit(0).alias("kind"), *FIELDS),
             lists.select("blk", F.lit(1).alias("kind"), F.col("node").alias("id"), "nb"),
             vecs.select("blk", F.lit(2).alias("kind"), "id", "q", "norm")]
    rows = None
    for part in parts:
        part = part.select(*[F.col(c) if c in part.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
        rows = part if rows is None else rows.unionByName(part)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].to_numpy()
        vec = pdf.loc[kind == 2, ["id", "q", "norm"]].sort_values("id")
        ids, m, norm = vec["id"].to_numpy(), _matrix(vec["q"]), vec["norm"].to_numpy()
        nbs = dict(zip(pdf["id"].to_numpy()[kind == 1], pdf["nb"].to_numpy()[kind == 1]))
        out = []
        for i, nb, sc, p, done in pdf.loc[kind == 0, FIELDS].itertuples(index=False):
            nb, sc, p, done = np.asarray(nb), np.asarray(sc, np.float32), np.asarray(p, np.float64), np.array(done, bool)
            go = _front(nb, sc, p, done, width)
            done[go] = True
            new = np.unique(np.concatenate([nbs[x] for x in nb[go].tolist() if x in nbs] or [nb[:0]]))
            new = new[~np.isin(new, nb) & (new != i)]
            at = np.searchsorted(ids, new)
            cos = m[at] @ m[np.searchsorted(ids, i)]
            out.append((i, *_pool(np.r_[nb, new], np.r_[sc, cos], np.r_[p, cos * norm[at]], np.r_[done, np.zeros(len(new), bool)])))
        return pd.DataFrame(out, columns=FIELDS)
    return materialize(rows.groupBy("blk").applyInPandas(block, STATE), "search")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, steps: int = 8, width: int = 16) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of each id in ``queries(id)``,
    which are ids of ``vectors(id, v)``; a query is no candidate of its own."""
    vectors = materialize(vectors, "vectors")
    eight = materialize(_eight_bits(vectors), "eight-bits")
    graph = neighbour_graph(eight)
    state = materialize(_starts(graph, eight, queries.select("id").distinct()), "search")
    blocks = max(1, -(-state.count() // (BLOCK // 4)))
    for _ in range(steps):
        state = _step(state, graph, eight, blocks, width)
    best = F.slice(F.sort_array(F.transform(F.arrays_zip("p", "nb"), lambda x: F.struct(x["p"], x["nb"])), asc=False), 1, 3 * k)
    pairs = state.select(F.col("id").alias("query_id"), F.explode(best).alias("x")).select("query_id", F.col("x.nb").alias("vec_id"))
    a = vectors.select(F.col("id").alias("query_id"), F.col("v").alias("va"))
    b = vectors.select(F.col("id").alias("vec_id"), F.col("v").alias("vb"))
    score = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    got = pairs.join(b, "vec_id").join(a, "query_id").select("query_id", "vec_id", score.alias("score"))
    return (got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
