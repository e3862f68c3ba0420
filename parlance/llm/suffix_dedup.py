"""Removal of long repeated byte strings by a prefix-free-style parse.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else in the
corpus. Texts are parsed at triggers: an 8-byte hash triggers where it is the least (leftmost) of
some ``length``-byte string, so every such string holds a trigger, and equal strings hold theirs
at the same place. A phrase is the stretch around a trigger that holds the strings belonging to
it; phrases are at most twice ``length`` long. The dictionary of phrases is put in order under
the half string beside the trigger (to its right, or to its left for strings that lie mostly
there), the part that every string of the phrase contains:

* equal neighbours in this order are a phrase that occurs again: all its strings are repeated;
* different phrases under one half string are a place where a repeat starts or ends: the suffixes
  of these phrases alone are compared string by string;
* a phrase alone under its half string has no repeated string.

So the order of all suffixes of the corpus is never built: a suffix is ordered as its phrase is,
and only phrases at the edges of repeats are opened. Strings and phrases are compared by 64-bit
hashes and not ranked lexicographically, as only equality is asked for. A half string with more
than ``GROUP`` different phrases is opened into its strings, which are dealt out by their hash.
Equal texts count as one with its number of copies: from two copies on, all their strings repeat.

Defined results: a null or empty text has no bytes; texts shorter than ``length`` lose nothing;
matches never cross documents; repeated rows are copies; doc_ids may be null or repeat (rows are
told apart by their text); extra columns are kept; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import id_in, id_out, materialize
from parlance.llm.ngram_join import mix

LENGTH, GRAM = 200, 8
#: Different phrases under one half string that are compared in one task.
GROUP = 4000
_CHUNK_BITS = 20  # positions of a stretch of text, in the low bits of its hashes


def trigger_of(raw: bytes, length: int) -> np.ndarray:
    """For each string start ``0 .. len(raw) - length``: the place of its trigger."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    wide, step, out = length - GRAM + 1, (1 << _CHUNK_BITS) - length, []
    for base in range(0, n, step):
        part = raw[base:base + step + length - 1]
        g = np.ndarray((len(part) - GRAM + 1,), "<u8", part, strides=(1,))
        low = np.uint64((1 << _CHUNK_BITS) - 1)
        m = (mix(g.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) & ~low) | np.arange(len(g), dtype=np.uint64)
        size = 1
        while size * 2 <= wide:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < wide:
            m = np.minimum(m[:len(m) - (wide - size)], m[wide - size:])
        out.append((m & low).astype(np.int64) + base)
    return np.concatenate(out)[:n]


def phrases(raw: bytes, length: int) -> Iterator[tuple[int, int, bytes, int]]:
    """``(first, last, half string, trigger - first)``: the strings that start at ``first .. last``
    belong to one trigger and contain its half string."""
    t = trigger_of(raw, length)
    if not len(t):
        return
    half = length // 2
    cut = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    for lo, hi, at in zip(cut.tolist(), (np.r_[cut[1:], len(t)] - 1).tolist(), t[cut].tolist()):
        a = max(lo, at - half)
        if a <= hi:
            yield a, hi, b"R" + raw[at:at + half], at - a
        b = min(hi, at - half - 1)
        if lo <= b:
            yield lo, b, b"L" + raw[at - half:at], at - lo


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _texts(docs: DataFrame) -> DataFrame:
    t = docs.select(F.col("text").cast("string").alias("text")).where(F.octet_length("text") > 0)
    return t.select(F.xxhash64("text").alias("tid"), "text")


def _first_seen(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, bytes]]:
    """``(tid, bytes)`` of the texts of a task, copies left out as far as memory allows."""
    seen: set[int] = set()
    for pdf in batches:
        for tid, text in zip(pdf["tid"].tolist(), pdf["text"].tolist()):
            if tid not in seen:
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(tid)
                yield tid, text.encode()


def phrase_table(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``key`` (half string), ``phrase``, ``tid`` and ``at`` (first string start * 2^16 + further
    starts) of every phrase of every distinct text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, phrase, tids, at, h = [], [], [], [], xxhash.xxh3_64_intdigest
        for tid, raw in _first_seen(batches):
            if len(raw) < length:
                continue
            for a, b, half, off in phrases(raw, length):
                key.append(h(half))
                phrase.append(h(raw[a:b + length], off))
                at.append((a << 16) + b - a)
                tids.append(tid)
            if len(key) > 50_000:
                yield _frame(key, phrase, tids, at)
                key, phrase, tids, at = [], [], [], []
        if key:
            yield _frame(key, phrase, tids, at)
    return _texts(docs).mapInPandas(run, "key long, phrase long, tid long, at long")


def _frame(key: list, phrase: list, tids: list, at: list) -> pd.DataFrame:
    return pd.DataFrame({"key": np.array(key, np.uint64).view(np.int64), "phrase": np.array(phrase, np.uint64).view(np.int64),
                         "tid": np.array(tids, np.int64), "at": np.array(at, np.int64)})


def ordered(rows: DataFrame) -> DataFrame:
    """The phrases that share a half string: ``again`` if the phrase occurs elsewhere, ``edge`` on
    (at least) one occurrence of each phrase under a half string that has several."""
    w = Window.partitionBy("key").orderBy("phrase", "tid", "at")
    col, lag, lead = F.col, lambda c: F.lag(c).over(w), lambda c: F.lead(c).over(w)
    n = rows.select("*", *[lag(c).alias(f"p_{c}") for c in ("phrase", "tid", "at")],
                    *[lead(c).alias(f"n_{c}") for c in ("phrase", "tid", "at")])

    def again(p: str):
        return (col(f"{p}_phrase") == col("phrase")) & ((col(f"{p}_tid") != col("tid")) | (col(f"{p}_at") != col("at")))
    n = n.withColumn("again", F.coalesce(again("p"), F.lit(False)) | F.coalesce(again("n"), F.lit(False)))
    n = n.withColumn("edge", F.coalesce(col("p_phrase") != col("phrase"), F.lit(False)) | F.coalesce(col("n_phrase") != col("phrase"), F.lit(False)))
    return n.where("again or edge").select("key", "phrase", "tid", "at", "again", "edge")


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans covered by strings at sorted ``starts``, where neighbours join."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist()))


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(tid, spans array<struct<s, e>>)``: the stretches of repeated strings of each text (they
    may overlap)."""
    found = materialize(ordered(phrase_table(docs, length)), "phrases")
    edge = found.where("edge").groupBy("key", "phrase").agg(F.min(F.struct("tid", "at")).alias("o"))
    edge = materialize(edge.select("key", F.col("o.tid").alias("tid"), F.col("o.at").alias("at")), "edges")
    many = edge.groupBy("key").agg(F.count("tid").alias("n")).where(F.col("n") > GROUP).select("key", F.lit(True).alias("many"))
    want = edge.join(many, "key", "left").groupBy("tid").agg(
        F.collect_list(F.struct("key", "at", F.coalesce("many", F.lit(False)).alias("many"))).alias("want"))

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=1)
        rows, size = [], 0
        for tid, raw in _first_seen(batches):
            rows.append((tid, z.compress(raw)))
            size += len(rows[-1][1])
            if size > 1 << 22:
                yield pd.DataFrame(rows, columns=["tid", "z"])
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["tid", "z"])

    def open_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for pdf in batches:
            rows = []
            for tid, packed, want_ in zip(pdf["tid"].tolist(), pdf["z"], pdf["want"]):
                raw = z.decompress(packed)
                for w in want_:
                    a, more = w["at"] >> 16, w["at"] & 0xFFFF
                    rows.append((w["key"], tid, a, raw[a:a + more + length], w["many"]))
            yield pd.DataFrame(rows, columns=["key", "tid", "a", "phrase", "many"])

    opened = _texts(docs).mapInPandas(squeeze, "tid long, z binary").join(want, "tid").mapInPandas(
        open_, "key long, tid long, a long, phrase binary, many boolean")
    opened = materialize(opened, "opened")

    def compare(g: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
        h = xxhash.xxh3_64_intdigest
        uniq = {(t, a): p for t, a, p in g}
        if len({p for p in uniq.values()}) < 2:
            return []
        sizes = [len(p) - length + 1 for p in uniq.values()]
        hashes = np.array([h(p[i:i + length]) for p, n in zip(uniq.values(), sizes) for i in range(n)], np.uint64)
        _, inv, count = np.unique(hashes, return_inverse=True, return_counts=True)
        hit, out, at = count[inv] > 1, [], 0
        for (t, a), n in zip(uniq, sizes):
            out += [(t, s, e) for s, e in _runs(np.flatnonzero(hit[at:at + n]) + a, length)]
            at += n
        return out

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for pdf in batches:
            for k, t, a, p in zip(pdf["key"].tolist(), pdf["tid"].tolist(), pdf["a"].tolist(), pdf["phrase"]):
                if k != key:
                    if len(held) > 1:
                        out += compare(held)
                    key, held = k, []
                held.append((t, a, bytes(p)))
            yield pd.DataFrame(out, columns=["tid", "s", "e"]).astype("int64")
            out = []
        yield pd.DataFrame(compare(held) if len(held) > 1 else [], columns=["tid", "s", "e"]).astype("int64")

    few = (opened.where("not many").select("key", "tid", "a", "phrase").repartition("key")
           .sortWithinPartitions("key").mapInPandas(groups, "tid long, s long, e long"))

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = xxhash.xxh3_64_intdigest
        for pdf in batches:
            rows = [(h(p[i:i + length]), t, a + i) for t, a, p in zip(pdf["tid"].tolist(), pdf["a"].tolist(), pdf["phrase"])
                    for i in range(len(p) - length + 1)]
            yield pd.DataFrame({"string": np.array([r[0] for r in rows], np.uint64).view(np.int64),
                                "tid": np.array([r[1] for r in rows], np.int64), "s": np.array([r[2] for r in rows], np.int64)})

    w = Window.partitionBy("string").orderBy("tid", "s")
    apart = F.lit(False)
    for f in (F.lag, F.lead):
        apart = apart | F.coalesce((f("tid").over(w) != F.col("tid")) | (f("s").over(w) != F.col("s")), F.lit(False))
    hot = (opened.where("many").select("tid", "a", "phrase").mapInPandas(strings, "string long, tid long, s long")
           .withColumn("hit", apart).where("hit").select("tid", "s", (F.col("s") + length).alias("e")))
    whole = (docs.select(F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= length)
             .groupBy(F.xxhash64("text").alias("tid")).agg(F.count(F.lit(1)).alias("c"), F.max(F.octet_length("text")).alias("e"))
             .where("c > 1").select("tid", F.lit(0).cast("long").alias("s"), F.col("e").cast("long").alias("e")))
    a = F.shiftright("at", 16)
    again = found.where("again").select("tid", a.alias("s"), (a + F.col("at").bitwiseAND(F.lit(0xFFFF)) + length).alias("e"))
    every = again.unionAll(few).unionAll(hot).unionAll(whole)
    return every.groupBy("tid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merge(found, n: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], min(x["e"], n)) for x in (found if found is not None else [])):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """``row`` (all columns), ``text`` and ``spans`` per row of ``docs``."""
    found = spans(docs, length)
    row = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns if x != "text"]).alias("row"),
                      F.col("text").cast("string").alias("text"))
    return (row.withColumn("tid", F.xxhash64("text")).join(materialize(found, "spans"), "tid", "left")
            .select("row", "text", "spans"))


def _kept(text: str | None, found) -> tuple[bytes, bytes, list[tuple[int, int]]]:
    raw = (text or "").encode()
    runs = merge(found, len(raw))
    at, kept = 0, []
    for s, e in runs:
        kept.append(raw[at:s])
        at = e
    return raw, b"".join([*kept, raw[at:]]), runs


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, found in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["spans"]):
                raw, kept, runs = _kept(text, found)
                rows.append((doc, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    d = _with_spans(docs.select(id_in(), "text"), length)
    return d.select("row.doc_id", "text", "spans").mapInPandas(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumn("doc_id", id_out())


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (a character cut in the middle goes)."""
    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _kept(t, f)[1].decode("utf-8", "ignore") for t, f in zip(text, found)], dtype=object)
    d = _with_spans(docs, length)
    d = d.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans")))
    return d.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
