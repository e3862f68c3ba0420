"""Hierarchical weighted hash tree: a row's shard by descending region, rack and shard.

Every shard has a weight. A row draws ``-ln(u) / weight`` for each shard, ``u`` from the hash of its
key and the shard's number, and a subtree's draw is the least draw below it: a race of exponential
variables, so at every level a child wins with probability its weight over its siblings'. A row
descends to the region with the least draw, there to the rack, there to the shard. A changed or
added weight alters only the draws on its own path: all other subtrees keep theirs, so rows leave
a subtree or enter it, and move nowhere else. That a subtree's draw comes from below, not from a
hash of its own, is what makes rows that enter a grown region go to the grown shard and not be
dealt over the whole region.

Law ``key``: the key and the number (and weights) of shards decide, nothing else; one more shard takes
rows only into itself. Sizes and counts are as even as hashing makes them.

Slots number a shard's rows by key, then checksum. Rows are ranked over sampled ranges of light
columns, so no task holds a shard; texts are not moved.

Defined results: a null text has no bytes and checksum 0; null keys are one key, equal keys go to
one shard whatever their texts; rows that are equal in key and text take consecutive slots; a
weight of 0 takes no row; extra columns are ignored by ``report`` and kept by ``assign``; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import let, materialize
from parlance.plans.rank import range_rank

#: Shards of a rack and racks of a region, unless a tree is given.
RACK, REGION = 5, 4
OVERHEAD = 16


@dataclass(frozen=True)
class Tree:
    """Weights of the shards, and where racks (in shards) and regions (in racks) begin."""
    weights: tuple[float, ...]
    racks: tuple[int, ...]
    regions: tuple[int, ...]

    def __post_init__(self):
        for starts, end in ((self.racks, len(self.weights)), (self.regions, len(self.racks))):
            if not starts or starts[0] != 0 or list(starts) != sorted(set(starts)) or starts[-1] >= end:
                raise ValueError("racks and regions must begin at 0, rise, and hold something each")
        if any(not math.isfinite(w) or w < 0 for w in self.weights) or not any(self.weights):
            raise ValueError("weights must be finite, not negative, and not all 0")


def even_tree(shards: int, weights: list[float] | None = None) -> Tree:
    """Shards in racks of ``RACK`` and regions of ``REGION`` racks, in order, so that a tree of one more
    shard only adds to the last ones. Weights are 1 unless given."""
    racks = tuple(range(0, shards, RACK))
    return Tree(tuple(weights or [1.0] * shards), racks, tuple(range(0, len(racks), REGION)))


def _spans(starts: tuple[int, ...], end: int) -> Column:
    """Each child's first place (from 1) and its length, as literals."""
    ends = [*starts[1:], end]
    return F.array(*[F.struct(F.lit(a + 1).alias("at"), F.lit(b - a).alias("n")) for a, b in zip(starts, ends)])


def draws(key: Column, weights: tuple[float, ...]) -> Column:
    """The draw of every shard: 53 bits of the hash of key and number, made exponential."""
    unit = lambda i: (F.shiftrightunsigned(F.xxhash64(key, i), 11).cast("double") + 0.5) * 2.0 ** -53
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(len(weights) - 1).cast("long"))
    raw = F.transform(numbers, lambda i: -F.log(unit(i)))
    if len(set(weights)) == 1:
        return raw
    return F.zip_with(raw, F.array(*[F.lit(float(w)) for w in weights]),
                      lambda d, w: F.when(w > 0, d / w).otherwise(F.lit(float("inf"))))


def _least(values: Column) -> Column:
    """Place of the least value, from 1; the first of equal ones."""
    return let(values, lambda v: F.array_position(v, F.array_min(v)).cast("int"))


def descend(drawn: Column, tree: Tree) -> Column:
    """``struct(region, rack, shard)``, numbered from 0 over the tree, by the shards' draws."""
    below = lambda values, spans: F.transform(spans, lambda s: F.array_min(F.slice(values, s["at"], s["n"])))
    racks, regions = _spans(tree.racks, len(tree.weights)), _spans(tree.regions, len(tree.racks))

    def inside(values: Column, span: Column) -> Column:
        return span["at"] + _least(F.slice(values, span["at"], span["n"])) - 1

    def walk(d: Column, r: Column) -> Column:
        return let(_least(below(r, regions)), lambda region: let(
            inside(r, F.element_at(regions, region)), lambda rack: F.struct(
                (region - 1).alias("region"), (rack - 1).alias("rack"),
                (inside(d, F.element_at(racks, rack)) - 1).alias("shard"))))

    return let(drawn, lambda d: let(below(d, racks), lambda r: walk(d, r)))


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``region``, ``rack`` and ``shard``, and ``grown_shard`` by the tree ``grown``: the
    same tree with other weights or more shards."""
    place = descend(draws(F.col(key), tree.weights), tree)
    out = docs.withColumn("_place", place).select(*docs.columns, "_place.region", "_place.rack", "_place.shard")
    return out if grown is None else out.withColumn("grown_shard", descend(draws(F.col(key), grown.weights), grown)["shard"])


def report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Per document: size, checksum, shard and slot, and its shard with one more."""
    raw = F.encode(F.col("text").cast("string"), "UTF-8")
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        (F.coalesce(F.octet_length(raw), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
                        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"))
    # written before the ranges are sampled, so that texts are read once
    placed = assign(materialize(light, "sizes"), even_tree(shards), even_tree(shards + 1))
    # a number of its own for every row, so that rows equal in all else don't fill one range
    own = F.xxhash64(F.monotonically_increasing_id()).alias("own")
    order = [F.col(c) for c in ("shard", "doc_id", "text_crc32", "size", "own")]
    ranked = range_rank(placed.select("*", own), order, "at")
    # one row a shard; counting needs no rank, so Spark leaves it out here
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    first = F.broadcast(counts.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    return ranked.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") - 1 - F.col("first")).alias("slot"),
        "grown_shard", "region", "rack")


def write_shards(assigned: DataFrame, path: str, files: int) -> None:
    """Whole rows under ``path/shard=<n>``, at most ``files`` files a shard, dealt by row and not by
    shard alone, so that a large shard is written by many tasks."""
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files))
    assigned.repartition("shard", part).write.mode("overwrite").partitionBy("shard").parquet(path)
