"""Registered queries: response deltas (STR-1, batch and stream), the streaming render (STR-2), the
streaming config upsert (STR-3) and the batched pandas map (UDF-2)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import WS_CLASS
from parlance.operators import templates as T
from parlance.operators.udf import batched_map
from parlance.plans import inputs, q_chat
from parlance.plans.q_sft import PAIRS_SQL, SOURCE_SQL, TARGET_SQL
from parlance.plans.registry import ORACLE, query
from parlance.plans.sqltext import strip
from parlance.sources import io
from parlance.sources.io import materialize
from parlance.streaming import jobs
from parlance.streaming.deltas import assemble_delta_files, assemble_deltas


def _quarter(spark) -> int:
    """Files of a micro-batch: a quarter of the shuffle's partitions, so that many tasks read it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


def response_deltas(spark, sf):
    """Deltas ``(response_id, seq, delta, finish_reason, ts)``: each reply cut into 8-character
    pieces at even ``seq``, a null delta first; ``stop`` on the last piece except when
    ``conv_id % 6 = 0`` (incomplete); when ``conv_id % 4 = 1`` one more delta follows the end."""
    c = inputs.conversations(spark, sf).filter(F.col("role") == "assistant")
    rid = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    n = F.ceil(F.length("text") / 8)
    base_ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    ts = lambda sec: base_ts + F.make_dt_interval(F.lit(0), F.col("conv_id"), F.col("turn"), sec)
    pieces = c.select("conv_id", "turn", "text", rid.alias("response_id"), n.alias("n"),
                      F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    finished = F.pmod("conv_id", F.lit(6)) != 0
    real = pieces.select("response_id", (F.col("i") * 2 + 2).alias("seq"),
                         F.substring("text", F.col("i") * 8 + 1, 8).alias("delta"),
                         F.when(finished & (F.col("i") == F.col("n") - 1), F.lit("stop")).alias("finish_reason"),
                         ts(F.col("i") + 1).alias("ts"))
    heads = c.select(rid.alias("response_id"), F.lit(1).cast("long").alias("seq"), F.lit(None).cast("string").alias("delta"),
                     F.lit(None).cast("string").alias("finish_reason"), ts(F.lit(0)).alias("ts"))
    tails = (c.filter((F.pmod("conv_id", F.lit(6)) != 0) & (F.pmod("conv_id", F.lit(4)) == 1))
             .select(rid.alias("response_id"), (F.ceil(F.length("text") / 8) * 2 + 2).alias("seq"),
                     F.lit(" IGNORED").alias("delta"), F.lit(None).cast("string").alias("finish_reason"),
                     ts(F.ceil(F.length("text") / 8) + 1).alias("ts")))
    return real.unionByName(heads).unionByName(tails)


_DELTA_ROWS_SQL = """asst AS (SELECT conv_id, turn, text, conv_id || '-' || turn AS response_id, CAST(ceil(length(text) / 8) AS BIGINT) AS n
  FROM conversations WHERE role = 'assistant'),
pc AS (SELECT *, unnest(range(0, n)) AS i FROM asst),
d AS (SELECT response_id, i * 2 + 2 AS seq, substr(text, CAST(i * 8 + 1 AS BIGINT), 8) AS delta,
    CASE WHEN conv_id % 6 != 0 AND i = n - 1 THEN 'stop' END AS finish_reason FROM pc
  UNION ALL SELECT response_id, 1, NULL, NULL FROM asst
  UNION ALL SELECT response_id, n * 2 + 2, ' IGNORED', NULL FROM asst WHERE conv_id % 6 != 0 AND conv_id % 4 = 1)"""
_DELTA_SQL = f"""{_DELTA_ROWS_SQL},
e AS (SELECT response_id, min(seq) FILTER (WHERE finish_reason IS NOT NULL) AS end_seq FROM d GROUP BY 1)"""


@query("assemble_deltas", f"""WITH {_DELTA_SQL}
SELECT response_id, coalesce(string_agg(delta, '' ORDER BY seq) FILTER (WHERE end_seq IS NULL OR seq <= end_seq), '') AS text,
  CAST(count(*) FILTER (WHERE end_seq IS NULL OR seq <= end_seq) AS INTEGER) AS n_deltas,
  min(finish_reason) AS finish_reason, CASE WHEN max(end_seq) IS NULL THEN 'incomplete' ELSE 'complete' END AS status
FROM d JOIN e USING (response_id) GROUP BY response_id""")
def q_assemble_deltas(spark, sf):
    """STR-1 (batch): ordered deltas -> text; null deltas add nothing, deltas after the end
    marker are ignored, no end marker = incomplete."""
    return assemble_deltas(response_deltas(spark, sf))


#: Arrival steps of the delta stream, and seconds after which a silent response is closed.
STEPS, GAP_S = 5, 30
_OFFSET = "(conv_id * 3600 + turn * 60 + CAST(seq // 2 AS BIGINT))"
_LATE = f"(conv_id % 10 = 3 AND seq = 4 AND {_OFFSET} < w - {GAP_S})"


def delta_arrivals(spark, sf) -> tuple[DataFrame, int]:
    """The deltas with the step in which they arrive, and a step's length in seconds. Steps follow
    event time, but for responses with ``conv_id % 10 = 7`` every other piece comes one step late
    (within the delay of one step), and for ``% 10 = 3`` the second piece of responses of the first
    step comes in the last one, long after the watermark."""
    d = response_deltas(spark, sf)
    ids = F.split("response_id", "-")
    d = d.select("*", ids[0].cast("long").alias("conv_id"), ids[1].cast("long").alias("turn")).withColumn("o", F.expr(
        "conv_id * 3600 + turn * 60 + seq div 2"))
    d = materialize(d, "deltas")
    w = d.agg(F.coalesce(F.max("o"), F.lit(0))).first()[0] // STEPS + 1
    late = F.expr(f"conv_id % 10 = 3 AND seq = 4 AND o < {w - GAP_S}")
    held = F.expr("conv_id % 10 = 7 AND seq % 4 = 0")
    own = F.floor(F.col("o") / w).cast("int")
    step = F.when(late, STEPS - 1).when(held, F.least(own + 1, F.lit(STEPS - 1))).otherwise(own)
    return d.withColumn("step", step), w


@query("assemble_deltas_stream", f"""WITH {_DELTA_ROWS_SQL},
k AS (SELECT *, CAST(split_part(response_id, '-', 1) AS BIGINT) AS conv_id, CAST(split_part(response_id, '-', 2) AS BIGINT) AS turn FROM d),
w AS (SELECT coalesce(max({_OFFSET}), 0) // {STEPS} + 1 AS w FROM k),
t AS (SELECT * FROM k, w WHERE NOT {_LATE}),
n AS (SELECT count(*) AS late FROM k, w WHERE {_LATE}),
e AS (SELECT response_id, min(seq) FILTER (WHERE finish_reason IS NOT NULL) AS end_seq FROM t GROUP BY 1)
SELECT response_id, coalesce(string_agg(delta, '' ORDER BY seq) FILTER (WHERE end_seq IS NULL OR seq <= end_seq), '') AS text,
  CAST(count(*) FILTER (WHERE end_seq IS NULL OR seq <= end_seq) AS INTEGER) AS n_deltas,
  min(finish_reason) AS finish_reason, CASE WHEN max(end_seq) IS NULL THEN 'incomplete' ELSE 'complete' END AS status,
  max(late) AS n_late FROM t JOIN e USING (response_id), n GROUP BY response_id""")
def q_assemble_deltas_stream(spark, sf):
    """STR-1 (stream): delta files in order of arrival, some out of order and some too late. Responses
    are closed by the watermark, one step behind; ``n_late`` is the number of dropped deltas. A
    delta of a far later response ends the input, so that every response before it is closed."""
    arrivals, w = delta_arrivals(spark, sf)
    base = io.scratch_path(spark, "stream-deltas")
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // STEPS)
    cols = ["response_id", "seq", "delta", "finish_reason", "ts"]
    last = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(w * STEPS * 10))
    closer = spark.range(1).select(F.lit("closer").alias("response_id"), F.lit(1).cast("long").alias("seq"), F.lit("").alias("delta"),
                                   F.lit(None).cast("string").alias("finish_reason"), last.alias("ts"))
    for i in range(STEPS + 1):  # in order: a file stream takes files by their age
        part = arrivals.where(F.col("step") == i).select(*cols) if i < STEPS else closer
        part.repartition(files if i < STEPS else 1).write.parquet(f"{base}/in/{i}")
    got, stats = assemble_delta_files(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", f"{GAP_S} seconds", f"{w} seconds", files)
    return got.select("response_id", "text", "n_deltas", "finish_reason", "status",
                      F.lit(sum(stats.dropped.values())).cast("long").alias("n_late"))


@query("stream_render", f"WITH {PAIRS_SQL} SELECT conv_id, turn, {SOURCE_SQL} AS source, {TARGET_SQL} AS target FROM pairs")
def q_stream_render(spark, sf):
    """STR-2: SFT pairs arrive as Parquet files, a quarter of them a micro-batch; a file-stream query
    renders prompt and target per record (stateless) into a checkpointed Parquet sink, read back here."""
    base = io.scratch_path(spark, "stream-render")
    files = _quarter(spark)
    inputs.sft_records(spark, sf).repartition(4 * files).write.mode("overwrite").parquet(f"{base}/in")

    def render(df):
        return df.select("conv_id", "turn", T.render_source("instruction").alias("source"),
                         T.render_target("output").alias("target"))
    return jobs.stream_render(spark, f"{base}/in", "conv_id bigint, turn bigint, instruction string, output string",
                              f"{base}/out", f"{base}/ckpt", render, files)


@query("stream_config_upsert", ORACLE["config_upsert"])
def q_stream_config_upsert(spark, sf):
    """STR-3: config events arrive as Parquet files, a quarter of them a micro-batch; ``foreachBatch``
    folds each into state kept by group; the result equals the batch upsert (CH-3)."""
    base = io.scratch_path(spark, "stream-config")
    files = _quarter(spark)
    q_chat.config_events(spark, sf).repartition(4 * files).write.mode("overwrite").parquet(f"{base}/in")
    ddl = "user_id bigint, seq bigint, kind string, agent string, description string, instructions string"
    return jobs.stream_config_upsert(spark, f"{base}/in", ddl, f"{base}/state", f"{base}/ckpt",
                                     "user_id", "seq", "kind", "agent", ["description", "instructions"], files)


def _text_stats(pdf: pd.DataFrame) -> pd.DataFrame:
    words = pdf["text"].str.split()
    return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"],
                         "n_chars": pdf["text"].str.len().astype("int64"),
                         "n_words": words.str.len().astype("int64"),
                         "first_word": words.str[0]})


@query("batched_map", f"""SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n_chars,
  CAST(len(CASE WHEN {strip('text')} = '' THEN [] ELSE string_split_regex({strip('text')}, '{WS_CLASS}+') END) AS BIGINT) AS n_words,
  CASE WHEN {strip('text')} = '' THEN NULL ELSE string_split_regex({strip('text')}, '{WS_CLASS}+')[1] END AS first_word FROM conversations""")
def q_batched_map(spark, sf):
    """UDF-2: a pandas function over batches of 1000 rows replaces the text columns with
    character and word counts and the first word."""
    c = inputs.conversations(spark, sf).select("conv_id", "turn", "text")
    return batched_map(c, _text_stats, "conv_id bigint, turn bigint, n_chars bigint, n_words bigint, first_word string")
