"""Lookups and merges expressed as joins (JN-*, SET-1).

Equi-joins are left to Catalyst/AQE, which broadcasts a side only after measuring it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def attach_outputs(sources: DataFrame, results: DataFrame, idx: str = "idx") -> DataFrame:
    """JN-1: result ``j`` onto source row ``j`` - by an explicit index, never by position."""
    return sources.join(results, idx, "left")


def resume_pending(inputs: DataFrame, done: DataFrame, idx: str = "idx") -> DataFrame:
    """JN-2: inputs whose ``idx`` has no output yet (left anti join)."""
    return inputs.join(done.select(idx), idx, "left_anti")


def merge_shards(shards: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """SET-1: all ranks' outputs plus earlier outputs (UNION ALL by name)."""
    return shards if previous is None else shards.unionByName(previous, allowMissingColumns=True)


def attach_documents(requests: DataFrame, documents: DataFrame, key: str,
                     request_key: str = "request_id", max_documents: int | None = None) -> DataFrame:
    """PRJ-11: each request gets ``documents`` = ordered ``[{title, text}]`` of its rows in
    ``documents(request_id, pos, title, text)`` and ``n_documents``. ``max_documents`` keeps
    the first N by ``pos`` (a prompt-size option of the caller; default: all)."""
    d = documents.select(F.col(request_key).alias(key), "pos", "title", "text")
    if max_documents is not None:
        # Cut before collecting: Catalyst turns ``row_number() <= N`` into a WindowGroupLimit
        # that also runs before the shuffle, so a request with a huge share of the documents
        # sends at most N rows per task and its list is bounded by N.
        w = Window.partitionBy(key).orderBy("pos")
        d = d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_documents).drop("_rn")
    per = (d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "title", "text"))).alias("_d")))
    docs = F.transform("_d", lambda s: F.struct(s["title"].alias("title"), s["text"].alias("text")))
    out = requests.join(per, key, "left").withColumn(
        "documents", F.coalesce(docs, F.array().cast("array<struct<title:string,text:string>>")))
    return out.withColumn("n_documents", F.size("documents").cast("long")).drop("_d")

