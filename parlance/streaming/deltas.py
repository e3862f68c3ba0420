"""Response deltas -> full texts, in batch and as a stream (STR-1).

A delta row is ``(response_id, seq, delta, finish_reason, ts)``. The text of a response is its
deltas in ``seq`` order; a null delta adds nothing; the first row with a ``finish_reason`` ends
the response and later deltas are ignored; a response without one is ``incomplete``.

Stream policy (ours; the reference's caller discards streamed results): a response is one
event-time session per ``response_id`` (``session_window(ts, gap)``); it is emitted in append
mode once the watermark (``max ts - delay``) passes the session's end; deltas later than the
watermark are dropped and counted by Spark (``numRowsDroppedByWatermark``; it counts after the
partial aggregate, so late deltas of one response with one timestamp count once). The group of one
response is bounded by the generation cap (``max_tokens``), so collecting it is safe, and state holds
the open responses only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.streaming.jobs import StreamStats, run_available

DELTA_DDL = "response_id string, seq bigint, delta string, finish_reason string, ts timestamp"


def _assemble(parts: Column, end_seq: Column) -> Column:
    kept = F.filter(parts, lambda p: end_seq.isNull() | (p["seq"] <= end_seq))
    return F.array_join(F.transform(kept, lambda p: F.coalesce(p["delta"], F.lit(""))), "")


def _aggs(seq: str, delta: str, finish: str) -> list[Column]:
    return [F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(delta).alias("delta")))).alias("_parts"),
            F.min(F.when(F.col(finish).isNotNull(), F.col(seq))).alias("_end"),
            F.min_by(F.col(finish), F.when(F.col(finish).isNotNull(), F.col(seq))).alias("_finish")]


def _finish(df: DataFrame, key: str) -> DataFrame:
    kept = F.filter("_parts", lambda p: F.col("_end").isNull() | (p["seq"] <= F.col("_end")))
    return df.select(key, _assemble(F.col("_parts"), F.col("_end")).alias("text"),
                     F.size(kept).alias("n_deltas"), F.col("_finish").alias("finish_reason"),
                     F.when(F.col("_end").isNull(), "incomplete").otherwise("complete").alias("status"))


def assemble_deltas(deltas: DataFrame, key: str = "response_id", seq: str = "seq", delta: str = "delta",
                    finish: str = "finish_reason") -> DataFrame:
    """STR-1 batch: ``(key, text, n_deltas, finish_reason, status)`` per response."""
    return _finish(deltas.groupBy(key).agg(*_aggs(seq, delta, finish)), key)


def assemble_deltas_stream(deltas: DataFrame, gap: str = "30 seconds", delay: str = "1 minute",
                           key: str = "response_id", seq: str = "seq", delta: str = "delta",
                           finish: str = "finish_reason", ts: str = "ts") -> DataFrame:
    """STR-1 stream: the same result per session of a response, emitted when it closes."""
    agg = (deltas.withWatermark(ts, delay)
           .groupBy(F.session_window(ts, gap).alias("session"), key)
           .agg(*_aggs(seq, delta, finish)))
    kept = F.filter("_parts", lambda p: F.col("_end").isNull() | (p["seq"] <= F.col("_end")))
    return agg.select(key, F.col("session.start").alias("session_start"),
                      _assemble(F.col("_parts"), F.col("_end")).alias("text"),
                      F.size(kept).alias("n_deltas"), F.col("_finish").alias("finish_reason"),
                      F.when(F.col("_end").isNull(), "incomplete").otherwise("complete").alias("status"))


def assemble_delta_files(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, gap: str = "30 seconds",
                         delay: str = "1 minute", files_per_trigger: int = 1) -> tuple[DataFrame, StreamStats]:
    """STR-1 as a job: delta files in order of arrival -> responses in a checkpointed Parquet sink, read
    back, and what was read and dropped. A response whose session the watermark has not passed yet
    stays in state and comes with a later run of the same checkpoint."""
    src = (spark.readStream.schema(DELTA_DDL).option("maxFilesPerTrigger", files_per_trigger)
           .option("recursiveFileLookup", True).parquet(source_dir))
    out = assemble_deltas_stream(src, gap, delay)
    stats = run_available(lambda: out.writeStream.format("parquet").outputMode("append")
                          .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink_dir))
    return spark.read.schema(out.schema).parquet(sink_dir), stats
