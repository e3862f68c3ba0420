"""Connected components of a link table by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import materialize


def _large(e: DataFrame) -> DataFrame:
    """Every neighbour above a node points to the least of its neighbourhood."""
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.join(m, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small(e: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, point to the least of them."""
    m = e.groupBy("u").agg(F.min("v").alias("m"))
    return (e.join(m, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(m.select("u", F.col("m").alias("v"))).distinct())


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)``: long ids. Returns ``(id, component)`` with the least id of the component,
    for every id in a link. Rounds grow with the logarithm of the longest path; each round is
    written to the shared folder, and hot ids are only ever aggregated or joined."""
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last = materialize(e, "links"), None
    while True:
        mark = tuple(e.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last or not mark[0]:
            break
        last = mark
        e = materialize(_small(_large(e)), "links")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
