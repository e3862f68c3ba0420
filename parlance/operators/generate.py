"""Batch generation as a Spark job (INF-*, UDF-3).

A *generator factory* (UDF-3) is a picklable callable; each task calls it once to build its
generator, then calls ``generator(messages, key=..., attempt=..., **params) -> dict`` for every
row. The response dict has the chat-response shape (``id, model, content, finish_reason,
reasoning_content, usage{total_tokens, prompt_tokens, completion_tokens}``) and may carry
``latency_s`` (server-side timing); otherwise wall-clock time is recorded.

Parallelism comes from partitions (``mapInPandas``) and, for a model server, from ``concurrency``
calls at a time inside a task. Every input row leaves with a ``status`` in ``ok, skipped,
filtered, exhausted`` - never dropped (INF-2, INF-4). Calls are not idempotent and a lazy plan
may run more than once, so results are written to a table and read from there:
``generate_resumable`` commits it range by range or batch by batch and calls only rows without a
final result.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import py_strip, strip_newlines
from parlance.operators.filters import CONTENT_FILTER_PATTERN

RESPONSE_DDL = ("struct<id:string,model:string,content:string,finish_reason:string,"
                "reasoning_content:string,usage:struct<total_tokens:bigint,prompt_tokens:bigint,"
                "completion_tokens:bigint>,latency_s:double>")
RESULT_SCHEMA = "id bigint, status string, attempts int, error string, elapsed_s double, raw_response string"
#: Results that a resumed run does not call again; ``exhausted`` rows are pending.
FINAL = ("ok", "skipped", "filtered")

_FILTER_RE = re.compile(CONTENT_FILTER_PATTERN)


def call_with_retry(gen: Callable, messages: list[dict], key, max_try: int = 3,
                    backoff: tuple[float, float] = (10.0, 12.0), **params) -> tuple:
    """INF-2: up to ``max_try`` attempts; a content-filter error is terminal; other errors wait
    ``backoff`` seconds and retry. Returns ``(status, attempts, error, response, elapsed_s)``."""
    last, spent = None, 0.0
    for attempt in range(1, max_try + 1):
        t0 = time.perf_counter()
        try:
            resp = gen(messages, key=key, attempt=attempt, **params)
            elapsed = resp.get("latency_s")
            spent += float(elapsed if elapsed is not None else time.perf_counter() - t0)
            return "ok", attempt, None, resp, spent
        except Exception as e:  # noqa: BLE001 - any failure is recorded on the row
            spent += time.perf_counter() - t0
            last = f"{type(e).__name__}: {e}"
            if _FILTER_RE.search(last):
                return "filtered", attempt, last, None, spent
            if attempt < max_try and backoff[1] > 0:
                time.sleep(random.uniform(*backoff))
    return "exhausted", max_try, last, None, spent


def resolve_attempts(log: DataFrame, id_col: str = "id", attempt: str = "attempt", error: str = "error",
                     max_try: int = 3) -> DataFrame:
    """INF-2 over a table of attempts: ``id, status, attempts, error``. The first attempt that
    answered (null error) or was filtered ends a row; ``max_try`` failures exhaust it; fewer leave
    it ``pending``. Attempts after the end do not count."""
    ends = F.col(error).isNull() | F.col(error).rlike(CONTENT_FILTER_PATTERN)
    tries = log.where(F.col(attempt) <= max_try).withColumn("_last", F.struct(F.col(attempt).alias("n"), F.col(error).alias("e")))
    per = tries.groupBy(id_col).agg(F.min(F.when(ends, F.col("_last"))).alias("_end"), F.max("_last").alias("_late"))
    at = F.coalesce("_end", "_late")
    status = (F.when(F.col("_end").isNotNull(), F.when(F.col("_end.e").isNull(), "ok").otherwise("filtered"))
              .when(F.col("_late.n") >= max_try, "exhausted").otherwise("pending"))
    return per.select(id_col, status.alias("status"), at["n"].cast("int").alias("attempts"), at["e"].alias("error"))


def generate_batch(requests: DataFrame, factory: Callable, id_col: str = "id", messages: str = "messages",
                   params: dict | None = None, max_try: int = 3, backoff: tuple[float, float] = (10.0, 12.0),
                   partitions: int | None = None, params_col: str | None = None, concurrency: int = 1) -> DataFrame:
    """INF-1: one call per request row (``messages`` = array<struct<role,content>>).

    FLT-2 rows (last message a user message with null content) are ``skipped`` without a call.
    Output: ``id, status, attempts, error, elapsed_s, raw_response`` (JSON text; parse with
    ``flatten_response``). Requests are dealt round-robin to ``partitions`` tasks (by default four
    per core of the cluster), because calls are slow and rows small. ``params_col`` names a column
    of JSON text with a request's own parameters, which go over ``params``; ``concurrency`` calls
    run at a time in a task.
    """
    params = dict(params or {})
    own = F.col(params_col) if params_col else F.lit(None).cast("string")
    src = requests.select(F.col(id_col).cast("long").alias("id"), F.to_json(messages).alias("_msgs"), own.alias("_params"))
    src = src.repartition(partitions or 4 * requests.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = factory()

        def one(row) -> tuple:
            key, msgs_json, own_json = row
            msgs = json.loads(msgs_json) if msgs_json else []
            if not msgs or (msgs[-1].get("role") == "user" and msgs[-1].get("content") is None):
                return key, "skipped", 0, None, 0.0, None
            kw = params | (json.loads(own_json) if own_json else {})
            status, attempts, err, resp, el = call_with_retry(gen, msgs, key, max_try, backoff, **kw)
            return key, status, attempts, err, el, None if resp is None else json.dumps(resp, ensure_ascii=False)

        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                rows = zip(pdf["id"], pdf["_msgs"], pdf["_params"])
                out = list(pool.map(one, rows) if concurrency > 1 else map(one, rows))
                yield pd.DataFrame(out, columns=["id", "status", "attempts", "error", "elapsed_s", "raw_response"])

    return src.mapInPandas(run, RESULT_SCHEMA)


def flatten_response(results: DataFrame, raw: str = "raw_response") -> DataFrame:
    """INF-3: response JSON -> flat fields + usage."""
    r = F.from_json(F.col(raw), RESPONSE_DDL)
    return results.withColumn("_r", r).select(
        *[c for c in results.columns if c != raw],
        F.col("_r.id").alias("response_id"), F.col("_r.model").alias("model"),
        F.col("_r.content").alias("content"), F.col("_r.finish_reason").alias("finish_reason"),
        F.col("_r.reasoning_content").alias("reasoning_content"),
        F.col("_r.usage.prompt_tokens").alias("prompt_tokens"),
        F.col("_r.usage.completion_tokens").alias("completion_tokens"),
        F.col("_r.usage.total_tokens").alias("total_tokens"))


def _stored(spark, out_path: str) -> DataFrame | None:
    try:
        return spark.read.schema(RESULT_SCHEMA).parquet(out_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def generate_resumable(requests: DataFrame, factory: Callable, out_path: str, id_col: str = "id",
                       messages: str = "messages", ranges: int = 8, commit: str = "range", **kw) -> DataFrame:
    """INF-1 + JN-2 + SNK: generate the rows without a final result (``FINAL``), append them to
    ``out_path`` and read the table back, one row per id (``ok`` first, then fewest attempts).

    ``commit="range"``: rows are called and committed in ``ranges`` parts by a hash of the id, by Spark's
    writer into any store it writes; a job that dies loses at most the calls of the part it was in.
    ``commit="task"``: one job whose tasks publish each batch of results when it is made
    (``sources.task_commit``), into a store that pyarrow opens too; what was published is never called
    again. Either way a rerun calls only what is pending."""
    spark = requests.sparkSession

    def pending(todo: DataFrame) -> DataFrame:
        done = _stored(spark, out_path)
        if done is None:
            return todo
        return todo.join(done.where(F.col("status").isin(*FINAL)).select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")

    if commit == "task":
        from parlance.sources.task_commit import register
        res = generate_batch(pending(requests), factory, id_col, messages, **kw)
        res.write.format(register(spark)).mode("append").save(out_path)
    elif commit == "range":
        part = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(ranges))
        for r in range(ranges):
            generate_batch(pending(requests.where(part == r)), factory, id_col, messages, **kw).write.mode("append").parquet(out_path)
    else:
        raise ValueError(f"unknown commit {commit!r}")
    stored = _stored(spark, out_path)
    if stored is None:  # nothing to publish, nothing stored before
        return spark.createDataFrame([], RESULT_SCHEMA)
    order = F.struct((F.col("status") != "ok").alias("a"), (~F.col("status").isin(*FINAL)).alias("b"), "attempts")
    return stored.groupBy("id").agg(F.min_by(F.struct(*[c for c in stored.columns if c != "id"]), order).alias("r")).select("id", "r.*")


def last_segment(text, marker: str = "assistant") -> Column:
    """INF-5: text after the last ``marker``, stripped (``r.split(marker)[-1].strip()``)."""
    c = F.col(text) if isinstance(text, str) else text
    return py_strip(F.element_at(F.split(c, re.escape(marker), -1), -1))


def split_reasoning(text, end_tag: str = "</think>") -> tuple[Column, Column]:
    """INF-6: (reasoning, content) split at the last ``end_tag``; both stripped of newlines
    only. Without the tag the reasoning is empty and the whole text is the content."""
    c = F.col(text) if isinstance(text, str) else text
    after = F.substring_index(c, end_tag, -1)
    has = F.locate(end_tag, c) > 0
    before = F.when(has, F.substring(c, 1, F.length(c) - F.length(after) - len(end_tag))).otherwise(F.lit(""))
    return strip_newlines(before), strip_newlines(F.when(has, after).otherwise(c))


def run_summary(results: DataFrame, settings: dict, elapsed: str = "elapsed_s") -> DataFrame:
    """AGG-1: total generation time, average per example, example count and the sampling
    settings actually used (one row)."""
    agg = results.agg(F.sum(elapsed).alias("total_time"), F.count(F.lit(1)).alias("example_numbers"))
    out = agg.withColumn("average_time", F.try_divide(F.col("total_time"), F.col("example_numbers")))
    for k, v in settings.items():
        out = out.withColumn(k, F.lit(v))
    return out


def status_counts(results: DataFrame, status: str = "status") -> DataFrame:
    """AGG-2: rows per final status."""
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def usage_totals(flat: DataFrame) -> DataFrame:
    """AGG-3: token usage per (model, finish_reason) over answered rows."""
    return (flat.filter(F.col("status") == "ok").groupBy("model", "finish_reason")
            .agg(F.count(F.lit(1)).alias("responses"),
                 F.sum("prompt_tokens").alias("prompt_tokens"),
                 F.sum("completion_tokens").alias("completion_tokens"),
                 F.sum("total_tokens").alias("total_tokens")))


def batch_report(results: DataFrame, batch: str = "batch_id") -> DataFrame:
    """INF-4: per batch, rows answered and failed; a batch with no answer is ``lost`` (what a
    whole-batch exception costs in the reference; here every row keeps its own status)."""
    return (results.groupBy(batch).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).cast("long").alias("ok"),
        F.sum(F.when(F.col("status") != "ok", 1).otherwise(0)).cast("long").alias("failed"))
        .withColumn("lost", F.col("ok") == 0))
