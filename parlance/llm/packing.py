"""Best-fit packing by minimum bin slack.

Every text is tokenized, ended by an end id and, if longer than a sequence, cut into pieces of
``capacity``. Which lengths share a sequence depends only on how many pieces have each length, so
the plan is made on that histogram (at most ``capacity`` rows, whatever the input): the longest
length left opens a bin, a bitset subset-sum over the lengths left finds the fullest sum that
fits beside it, and that pattern is used for as many bins as its lengths allow before it is
removed. Each use exhausts a length of the pattern, so the plan has a bounded number of patterns.
Pieces then take their places by their number among those of equal length, which a counter per
task and a running sum over tasks give without gathering a length in one task.

Defined results: a null or empty text is one piece holding the end id; repeated rows are packed
as often as they occur; null doc_ids stay null; an empty table gives no piece; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import encoder, id_in, id_out, materialize

CAPACITY = 2048


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take for the largest sum of at most ``room``: bit ``s`` of the
    bitset says that sum ``s`` can be made of the lengths seen so far."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for n in sorted((x for x in counts if x <= room), reverse=True):
        most, size = min(counts[n], room // n), 1
        while most > 0:
            take = min(size, most)
            new = (reach | (reach << (take * n))) & full
            if new != reach:
                steps.append((n, take, reach))
                reach = new
            most, size = most - take, size * 2
        if reach >> room & 1:
            break
    left, out = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> left & 1:
            out[n] = out.get(n, 0) + take
            left -= take * n
    return out


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``[(bins, {length: pieces in each of these bins})]`` that uses up the histogram."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    plan = []
    while counts:
        top = max(counts)
        counts[top] -= 1
        if not counts[top]:
            del counts[top]
        pattern = fullest(counts, capacity - top)
        counts[top] = counts.get(top, 0) + 1
        pattern[top] = pattern.get(top, 0) + 1
        bins = min(counts[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            counts[n] -= bins * k
            if not counts[n]:
                del counts[n]
        plan.append((bins, pattern))
    return plan


def _places(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan by (length, number among equal lengths): from which number on, which bins."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for bins, pattern in plan:
        at = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            rows.append((n, used.get(n, 0), base, k, at))
            used[n] = used.get(n, 0) + bins * k
            at += n * k
        base += bins
    rows.sort()
    cols = list(zip(*rows)) if rows else [()] * 5
    return {c: np.array(v, np.int64) for c, v in zip(("n", "first", "base", "k", "at"), cols)}


def token_pieces(docs: DataFrame, vocab_file: str, end_id: int = 0, capacity: int = CAPACITY,
                 words: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and the piece's number ``k`` among those of its
    length in its task ``part``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, tail = encoder(vocab_file, words), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for pdf in batches:
            rows = []
            for doc, raw in zip(pdf["doc_id"].tolist(), enc.batch(pdf["text"].tolist())):
                raw += tail
                for i, a in enumerate(range(0, len(raw), 4 * capacity)):
                    b = raw[a:a + 4 * capacity]
                    n = len(b) // 4
                    rows.append((doc, i, a // 4, n, zlib.crc32(b), part, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"])

    d = docs.select(id_in(), F.col("text").cast("string").alias("text"))
    return d.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``token_pieces``' rows."""
    pieces = materialize(pieces, "pieces")
    counts = pieces.groupBy("part", "length").agg((F.max("k") + 1).alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan_bins(hist, capacity))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    numbered = pieces.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("number"))
    shared = pieces.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        key = (p["n"] << 44) + p["first"]
        for pdf in batches:
            if len(pdf):
                n, num = pdf["length"].to_numpy(), pdf.pop("number").to_numpy()
                i = np.searchsorted(key, (n << 44) + num, side="right") - 1
                j = num - p["first"][i]
                yield pdf.assign(sequence_id=p["base"][i] + j // p["k"][i], offset=p["at"][i] + j % p["k"][i] * n)

    placed = numbered.mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("doc_id", id_out())
