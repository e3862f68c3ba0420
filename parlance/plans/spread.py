"""Parallelism before per-row heavy work.

Tokenizing, hashing and n-gram expansion multiply each input row many times. If the rows
arrive in few partitions - one unsplittable file, or a shuffle that AQE coalesced because its
*input* was small - that expansion runs in a handful of tasks. ``spread`` hash-partitions the
rows by their key into ``spark.sql.shuffle.partitions`` partitions first; AQE keeps an explicit
partition count, so the expansion gets the cluster's parallelism. The extra exchange moves the
input rows once, which is small next to the expanded rows it parallelizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys else df.repartition(n)
