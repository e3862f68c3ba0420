"""N-gram Jaccard self-join by universe-partition pigeonhole.

A document is its set of distinct word shingles. Sizes are cut into bands so that two linked sets
lie in the same or in neighbouring bands; every band splits the universe of shingles into ``m``
segments by hash. Linked sets differ in at most ``H`` shingles (``H`` from the band's sizes), so
if segments are given weights of 1 or 2 that add up to ``H + 1``, some segment of weight 1 is
equal or some segment of weight 2 differs by at most one shingle. Weight 1 indexes the segment's
subset; weight 2 also indexes the subset without each one of its shingles. How many segments get
weight 2 is chosen per band by cost: index rows against accidental meetings, which the corpus'
own counts of sets per band predict.

Sets that share an index key are candidates. Equal sets are one candidate (copies never form
pairs). Candidates pass a length filter and a 512-bit parity sketch (the popcount of the XOR of
two sketches never exceeds the number of shingles in which the sets differ, so it drops no link);
what is left is compared exactly. Only components are asked for, so a key's sets are first
compared with one of them, then each with the nearest set of another component, and last all
pairs that still lie in different components: no link between components is left out, and a
group of near copies does not become all its pairs. A key with more than ``BLOCK`` sets is
compared block against block in separate tasks.

Defined results: words are split at ASCII white space after lower-casing A-Z; a text with fewer
words than a shingle is one shingle; without words it is empty and linked with nothing. Rows with
null or repeated doc_ids are compared by their text; a component's id is its least non-null
doc_id. Shingles and sets are identified by 64-bit hashes. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import id_in, id_out, materialize
from parlance.llm.components import components
from parlance.sources.io import passing_tables, scratch_path, write

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Cost of comparing two sketches, in index rows.
MEET_COST = 0.02
#: Sets of one key that are compared in one task.
BLOCK = 20_000
#: Documents fetched by a broadcast of their ids (16 bytes each); more are fetched by a shuffle.
FETCH_BY_BROADCAST = 100_000
SKETCH = [f"s{i}" for i in range(8)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``n``-word shingles."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i])
    return np.unique(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Bands:
    """Size bands for links of ``100 * intersection >= percent * union``."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.lows = percent, [1]
        while self.lows[-1] <= largest:
            self.lows.append(self.lows[-1] * 100 // percent + 1)
        self.segments: list[tuple[int, int]] = []

    def band(self, sizes) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, side="right") - 1

    def differ(self, k: int) -> int:
        """Most shingles in which a set of band ``k`` and a linked set at least as large differ."""
        return (self.lows[k + 1] - 1) * (100 - self.percent) // self.percent

    def allocate(self, sets: dict[int, int]) -> "Bands":
        """``(m, d)`` per band: ``m`` segments, the first ``d`` of weight 2, ``m + d = H + 1``."""
        for k in range(len(self.lows) - 1):
            h, n = self.differ(k), sets.get(k, 0) + sets.get(k + 1, 0)

            def cost(d: int) -> float:
                m = h + 1 - d
                each = self.lows[k] / m
                meet = exp(-2 * each) * ((m - d) + d * (1 + 2 * each))
                return m + d * each + MEET_COST * n * meet
            d = min(range((h + 1) // 2 + 1), key=cost)
            self.segments.append((h + 1 - d, d))
        return self

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Index keys of a set in its own band and the one below."""
        own, out = int(self.band(len(s))), []
        where, value = mix(s ^ np.uint64(0xA0761D6478BD642F)), mix(s ^ np.uint64(0xE7037ED1A0B428DB))
        for k in {own, max(own - 1, 0)}:
            m, d = self.segments[k]
            seg = ((where >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, seg.astype(np.int64), value)
            salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(k << 32))
            out.append(mix(sums ^ salt) + salt)
            if d:
                i = seg < d
                j = seg[i].astype(np.int64)
                out.append(mix((sums[j] - value[i]) ^ salt[j]) + salt[j])
        return np.unique(np.concatenate(out))


def wide_sketch(s: np.ndarray, percent: int) -> bytes | None:
    """Parity sketch of about three times as many bits as linked sets of this size may differ in, where
    512 bits are too few to tell sets apart. A power of two, so sketches fold onto each other."""
    bits = 1 << max(0, (6 * len(s) * (100 - percent) // (100 + percent)).bit_length())
    if bits <= 512:
        return None
    at = (mix(s ^ np.uint64(0x589965CC75374CC3)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_differ(a: bytes | None, b: bytes | None) -> int:
    """Least number of shingles in which two sets differ, by their wide sketches."""
    if a is None or b is None:
        return 0
    size = min(len(a), len(b))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint64).reshape(-1, size // 8), axis=0) for z in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def set_table(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id, tid`` (hash of the text), ``n``, ``sid`` (hash of the set; null if empty) and the
    sketches per row of ``docs``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size, sid, sk, wide = [], [], [], []
            for text in pdf.pop("text").tolist():
                s = shingle_set(text, n)
                size.append(len(s))
                sid.append(int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True) if len(s) else None)
                odd = np.bincount((mix(s ^ np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(55)).astype(np.int64), minlength=512) & 1
                sk.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                wide.append(wide_sketch(s, percent))
            sk = np.array(sk, np.int64).reshape(-1, 8)
            yield pdf.assign(n=size, sid=pd.array(sid, "Int64"), wide=pd.Series(wide, index=pdf.index, dtype=object), **{c: sk[:, i] for i, c in enumerate(SKETCH)})
    d = docs.select(id_in(), F.col("text").cast("string").alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    return d.mapInPandas(run, "doc_id long, tid long, n long, sid long, wide binary, " + ", ".join(f"{c} long" for c in SKETCH)
                         ).withColumn("doc_id", id_out())


def index_rows(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """``(key, sid)`` rows; a task indexes a set once however many copies it reads."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            keys, sids = [], []
            for text in pdf["text"].tolist():
                s = shingle_set(text, n)
                if not len(s):
                    continue
                sid = int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True)
                if sid in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(sid)
                k = bands.keys(s)
                keys.append(k)
                sids.append(np.full(len(k), sid, np.int64))
            if keys:
                yield pd.DataFrame({"key": _signed(np.concatenate(keys)), "sid": np.concatenate(sids)})
    return docs.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "key long, sid long")


def shared_keys(rows: DataFrame) -> DataFrame:
    """Index rows whose key another set has."""
    w = Window.partitionBy("key").orderBy("sid")
    return (rows.withColumn("before", F.lag("sid").over(w)).withColumn("after", F.lead("sid").over(w))
            .where("before <> sid or after <> sid").select("key", "sid"))


def _near(a: str, b: str, percent: int):
    """Length and sketch filter between two rows of the set table under prefixes ``a``, ``b``."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH), F.lit(0))
    # differ <= (na + nb) * (100 - p) / (100 + p)
    return (percent * F.greatest(na, nb) <= 100 * F.least(na, nb)) & \
        (differ * (100 + percent) <= (na + nb) * (100 - percent)), differ


class Verifier:
    """Exact comparison of candidate pairs of set ids."""

    def __init__(self, docs: DataFrame, sets: DataFrame, n: int, percent: int):
        self.docs, self.sets, self.n, self.percent = docs, sets, n, percent

    def _fetch(self, pairs: DataFrame) -> DataFrame:
        """``(sid, shingles)`` of the sets in ``pairs``, from one document of each."""
        ids = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).distinct()
        need = self.sets.join(ids, "sid", "left_semi").select(F.col("rep.doc_id").alias("want_id"), F.col("rep.tid").alias("want"))
        need = materialize(need, "wanted")
        if need.count() <= FETCH_BY_BROADCAST:
            need = F.broadcast(need)
        d = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        d = d.withColumn("tid", F.xxhash64("text"))
        got = d.join(need, (F.col("tid") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("want_id"))).select("text")
        n = self.n

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                s = [shingle_set(t, n) for t in pdf["text"].tolist()]
                yield pd.DataFrame({"sid": [int.from_bytes(xxhash.xxh3_64_digest(x.tobytes()), "big", signed=True) for x in s],
                                    "shingles": [_signed(x) for x in s]})
        return materialize(got.mapInPandas(run, "sid long, shingles array<long>").dropDuplicates(["sid"]), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that are links, written."""
        v = self._fetch(pairs)
        both = (pairs.join(v.select(F.col("sid").alias("a"), F.col("shingles").alias("sa")), "a")
                .join(v.select(F.col("sid").alias("b"), F.col("shingles").alias("sb")), "b"))
        common = F.size(F.array_intersect("sa", "sb"))
        return materialize(both.where(100 * common >= self.percent * (F.size("sa") + F.size("sb") - common))
                           .select("a", "b"), "verified")


def _star(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of every set with the nearest of the centres (most copies) of its keys."""
    m = shared.join(sets.select("sid", "copies"), "sid")
    centre = m.groupBy("key").agg(F.max(F.struct("copies", "sid"))["sid"].alias("centre"))
    pairs = shared.join(centre, "key").where("sid <> centre").select("sid", "centre").distinct()
    ok, differ = _near("x", "c", percent)
    return (pairs.join(sets.alias("x").select("sid", F.struct("n", *SKETCH).alias("x")), "sid")
            .join(sets.select(F.col("sid").alias("centre"), F.struct("n", *SKETCH).alias("c")), "centre").where(ok)
            .groupBy("sid").agg(F.min_by("centre", F.struct(differ, "centre")).alias("centre"))
            .select(F.col("sid").alias("a"), F.col("centre").alias("b")))


def across(shared: DataFrame, sets: DataFrame, comp: DataFrame, near: Callable, sketch: list[str] | str, nearest: bool,
           may: Callable | None = None) -> DataFrame:
    """Pairs of ``shared(key, sid)`` that share a key, lie in different components and pass
    ``near(differing sketch bits, n, n)``: all of them, or for each set the nearest in each key. With ``may``,
    pairs must also pass ``may(sketches, n)(rows, rows)``, of the column ``sketch`` of ``sets``. ``sketch`` are
    columns of longs, or the name of a binary one (of one length, or empty: zeros).
    A key's sets are compared block by block; pairs within a key's largest component are never
    formed."""
    m = shared.distinct().join(comp.withColumnRenamed("id", "sid"), "sid", "left").select(
        "key", "sid", F.coalesce("component", "sid").alias("component"))
    open_ = m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("sid").alias("g")).where("lo <> hi")
    blocks = F.ceil(F.col("g") / BLOCK).cast("int")
    m = m.join(open_.select("key", blocks.alias("blocks")), "key")
    m = m.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    m = m.select("key", "sid", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    m = m.select("key", "sid", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    wide = F.col("wide") if "wide" in sets.columns else F.lit(None).cast("binary").alias("wide")
    words = [sketch] if isinstance(sketch, str) else sketch
    more = ["sketch"] if may and "sketch" not in words else []
    m = m.join(sets.select("sid", "n", wide, *words, *more), "sid")
    m = m.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(a[..., c] ^ b[..., c]).astype(np.int32) for c in range(a.shape[-1]))

    def passed(ok: np.ndarray, fit: Callable | None, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``ok`` without the pairs of rows that fail ``fit``, some at a time."""
        if fit:
            for some in np.array_split(np.flatnonzero(ok), 1 + len(ok) // 100_000):
                ok[some] = fit(a[some], b[some])
        return ok

    def small(fit, gid, sid, comp, n, sk, row) -> list[np.ndarray]:
        """Rows (group, set, set, differing bits) of many small groups at once: every row against
        the one before it, the second before it, and so on."""
        out, live, shift = [], np.arange(len(gid)), 1
        while len(live := live[live >= shift]) and len(live := live[gid[live] == gid[live - shift]]):
            a, b = live, live - shift
            ok = comp[a] != comp[b]
            a, b = a[ok], b[ok]
            d = differ(sk[a], sk[b])
            ok = passed(near(d, n[a], n[b]), fit, row[a], row[b])
            a, b, d = a[ok], b[ok], d[ok]
            out += [np.stack([gid[a], sid[a], sid[b], d]), np.stack([gid[a], sid[b], sid[a], d])]
            shift += 1
        return out

    def large(fit, gid, sid, comp, n, sk, row, all_: bool) -> list[np.ndarray]:
        """The same for one group, without the pairs within its largest component."""
        _, idx, count = np.unique(comp, return_inverse=True, return_counts=True)
        few, out = np.flatnonzero(idx != count.argmax()), []
        for x in np.array_split(few, max(1, len(few) * len(sid) // 2_000_000)):
            d = differ(sk[x][:, None], sk[None])
            ok = (comp[x][:, None] != comp[None, :]) & near(d, n[x][:, None], n[None, :])
            if fit:
                a, b = np.nonzero(ok)
                ok[a, b] = passed(np.ones(len(a), bool), fit, row[x[a]], row[b])
            if not all_:  # the nearest is enough
                best, keep = np.where(ok, d, 1 << 20).argmin(1), np.zeros_like(ok)
                keep[np.arange(len(x)), best] = True
                ok &= keep
            a, b = np.nonzero(ok)
            out.append(np.stack([np.full(len(a), gid), sid[x[a]], sid[b], d[a, b]]))
        return out

    def meet(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole groups, ordered."""
        at = pdf[["key", "i", "j"]].to_numpy()
        gid = np.r_[0, np.cumsum((at[1:] != at[:-1]).any(1))]
        cols = [pdf[c].to_numpy() for c in ("sid", "component", "n")]
        if isinstance(sketch, str):
            none = bytes(max(map(len, pdf[sketch]), default=0) or 8)
            cols.append(np.frombuffer(b"".join([x or none for x in pdf[sketch]]), np.uint64).reshape(len(pdf), -1))
        else:
            cols.append(np.ascontiguousarray(pdf[sketch].to_numpy()).view(np.uint64))  # bitwise_count takes absolute values
        cols.append(np.arange(len(pdf)))
        fit = may(pdf["sketch"], cols[2]) if may else None
        size = np.bincount(gid)
        some = size[gid] <= 64
        out = small(fit, gid[some], *[c[some] for c in cols])
        for g in np.flatnonzero(size > 64):
            a, b = np.searchsorted(gid, [g, g + 1])
            out += large(fit, g, *[c[a:b] for c in cols], all_=not nearest or bool(pdf["wide"].iloc[a:b].notna().any()))
        p = np.concatenate(out, 1) if out else np.zeros((4, 0), np.int64)
        has = pdf["wide"].notna().to_numpy()
        if p.size and has.any():
            wide_of = dict(zip(pdf["sid"].to_numpy()[has].tolist(), pdf["wide"].to_numpy()[has]))
            size_of = dict(zip(cols[0].tolist(), cols[2].tolist()))
            seen: dict[tuple[int, int], bool] = {}
            ok = np.ones(p.shape[1], bool)
            for k, (a, b) in enumerate(zip(p[1].tolist(), p[2].tolist())):
                if a in wide_of and b in wide_of:
                    pair = (a, b) if a < b else (b, a)
                    if pair not in seen:
                        seen[pair] = bool(near(wide_differ(wide_of[a], wide_of[b]), size_of[a], size_of[b]))
                    ok[k] = seen[pair]
            p = p[:, ok]
        if nearest and p.size:
            p = p[:, np.lexsort((p[2], p[3], p[1], p[0]))]
            p = p[:, np.r_[True, (p[:2, 1:] != p[:2, :-1]).any(0)]]
        if p.size:
            yield pd.DataFrame({"a": p[1:3].min(0), "b": p[1:3].max(0)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of the group that may go on
        group = ["key", "i", "j"]
        for pdf in batches:
            if not len(pdf):
                continue
            last = tuple(pdf[group].iloc[-1])
            if held and last == tuple(pdf[group].iloc[0]) == tuple(held[-1][group].iloc[-1]):
                held.append(pdf)
                continue
            pdf = pd.concat([*held, pdf])
            open_ = (pdf[group] == last).all(axis=1).to_numpy()
            if not open_.all():
                yield from meet(pdf[~open_])
            held = [pdf[open_]]
        if held:
            yield from meet(pd.concat(held))
    cols = ["key", "i", "j", "sid", "component", "n", "wide", *words, *more]
    return m.select(*cols).mapInPandas(run, "a long, b long").distinct()


def link_rounds(shared: DataFrame, sets: DataFrame, links: DataFrame, near: Callable, sketch: list[str],
                verify: Callable[[DataFrame], DataFrame], may: Callable | None = None) -> DataFrame:
    """Components of ``links`` and of all links between sets that share a key: first the nearest
    pairs across components, then all that are left across."""
    comp = materialize(components(links), "components")
    for nearest in (True, False):
        pairs = materialize(across(shared, sets, comp, near, sketch, nearest, may), "pairs")
        if pairs.isEmpty():
            break
        new = verify(pairs)
        if not new.isEmpty():
            links = links.unionAll(new)
            comp = materialize(components(links), "components")
    return comp


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, tid, component`` per row of ``docs`` (``tid``: hash of its
    text; ``component``: a hash that tells components apart whatever their doc_ids, null if empty)."""
    d = materialize(set_table(docs, n, percent), "shingle-sets")
    sets = materialize(d.where("sid is not null").groupBy("sid").agg(
        F.min(F.struct("doc_id", "tid")).alias("rep"), F.min("doc_id").alias("least"), F.count("tid").alias("copies"),
        F.first("n").alias("n"), F.first("wide").alias("wide"), *[F.first(c).alias(c) for c in SKETCH]), "distinct-sets")
    d = d.drop("wide", *SKETCH)
    largest = sets.agg(F.max("n")).first()[0] or 0
    bands = Bands(percent, largest)
    # sets per band: at most one row a band, some hundreds for any size of text
    cuts = F.array(*[F.lit(x) for x in bands.lows])
    per = sets.groupBy((F.size(F.filter(cuts, lambda x: x <= F.col("n"))) - 1).alias("k")).agg(F.count("sid").alias("c")).collect()
    bands.allocate({r["k"]: r["c"] for r in per})
    shared = materialize(shared_keys(index_rows(docs, n, bands)), "shared-keys")
    check = Verifier(docs, sets, n, percent)
    links = check.links(materialize(_star(shared, sets, percent), "pairs"))

    def near(d, a, b):
        return (d * (100 + percent) <= (a + b) * (100 - percent)) & (percent * np.maximum(a, b) <= 100 * np.minimum(a, b))
    comp = link_rounds(shared, sets, links, near, SKETCH, check.links)
    part = sets.join(comp.withColumnRenamed("id", "sid"), "sid", "left").select("sid", F.coalesce("component", "sid").alias("c"), "least")
    part = materialize(part, "parts")
    named = part.join(part.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("sid", "component_id", F.col("c").alias("component"))
    return d.join(named, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "tid", "component")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the least doc_id
    (then text hash) stays; of fully repeated rows one stays. Texts without words stay."""
    path = scratch_path(docs.sparkSession, "kept")
    with passing_tables(docs.sparkSession):
        c = jaccard_components(docs, n, percent).where("n_shingles > 0")
        rows = c.groupBy("component", "doc_id", "tid").agg(F.count("n_shingles").alias("c"))
        keep = rows.groupBy("component").agg(F.min(F.struct("doc_id", "tid", "c")).alias("f")).select(
            F.col("f.doc_id").alias("keep_id"), F.col("f.tid").alias("keep_tid"), (F.col("f.c") > 1).alias("again"))
        write(keep, path)
    keep = docs.sparkSession.read.parquet(path)
    row = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"),
                      F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
    row = row.select("row", "id", F.xxhash64("t").alias("h"), F.coalesce("t", F.lit("")).rlike(r"[^ \t-\r]").alias("worded"))
    kept = row.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_tid")), "left")
    once = kept.where("not worded or not again").select("row.*")
    if keep.where("again").isEmpty():  # no row that repeats in full stays
        return once
    return once.unionByName(kept.where("worded and again").dropDuplicates(["id", "h"]).select("row.*"))
