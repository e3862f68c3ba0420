"""Orders, limits and top-k (ORD-*). Orders are explicit keys, never list positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import md5_key
from parlance.plans.rank import md5_rank


def seeded_shuffle(df: DataFrame, key: list[str], seed: int = 42, out: str = "rank") -> DataFrame:
    """ORD-1: a seeded permutation. ``out`` is the 1-based position in the order of
    ``md5('<seed>:k1:k2...')``; identical under any partitioning and in DuckDB."""
    return md5_rank(df, md5_key(*key, seed=seed), [F.col(k) for k in key], out)


def sort_by_idx(df: DataFrame, idx: str = "idx") -> DataFrame:
    """ORD-2: global order by ``idx`` (range-partitioned sort)."""
    return df.orderBy(idx)


def first_n(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """ORD-3: the first ``n`` examples by ``idx`` (TakeOrderedAndProject: per-task top-n, then
    a merge of n rows per task)."""
    return df.orderBy(idx).limit(n)
