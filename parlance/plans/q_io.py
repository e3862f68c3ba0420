"""Registered queries: scans and sinks (SRC-*, SNK-*). Each writes test-table rows through a
sink into the shared scratch folder (``spark.checkpoint.dir``) and scans them back with a
declared schema, so the oracle is the source table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import generate as G
from parlance.plans import inputs
from parlance.plans.inputs import TABLES, table
from parlance.plans.q_generate import GEN_CTES, RES_CTES, SETTINGS, results, stored_results
from parlance.plans.q_prep import IDX_SQL
from parlance.plans.registry import query
from parlance.sources import io

CONV_DDL = "conv_id bigint, turn bigint, role string, text string"


@query("scan_jsonl", "SELECT conv_id, turn, role, text, CAST(NULL AS VARCHAR) AS _corrupt_record FROM conversations")
def q_scan_jsonl(spark, sf):
    """SNK-1 + SRC-1: conversations written as JSON lines and scanned back with a schema
    (bad lines would keep their text in ``_corrupt_record``)."""
    path = io.scratch_path(spark, "conversations.jsonl")
    io.sink_jsonl(table(spark, sf, "conversations"), path)
    return io.scan_jsonl(spark, path, CONV_DDL)


@query("scan_json_array", "SELECT doc_id, quality, toxic FROM labels")
def q_scan_json_array(spark, sf):
    """SRC-2: labels written as one JSON-array file and read back in byte ranges by many tasks."""
    path = io.scratch_path(spark, "labels.json")
    io.sink_json_arrays(table(spark, sf, "labels"), path, 1)
    return io.scan_json_array(spark, path, "doc_id bigint, quality int, toxic int")


@query("scan_by_suffix", " UNION ALL ".join(
    f"SELECT '{f}' AS format, doc_id, text, n_chars FROM documents" for f in ("jsonl", "json", "parquet")))
def q_scan_by_suffix(spark, sf):
    """SRC-3: the reader is picked from the path (``.jsonl`` lines, ``.json`` arrays, ``.parquet``)."""
    d = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    base = io.scratch_path(spark, "suffix")
    io.sink_jsonl(d, f"{base}/documents.jsonl")
    d.write.mode("overwrite").parquet(f"{base}/documents.parquet")
    io.sink_json_arrays(d, f"{base}/documents.json", spark.sparkContext.defaultParallelism)
    ddl = "doc_id bigint, text string, n_chars bigint"
    parts = [io.scan_by_suffix(spark, f"{base}/documents.{f}", ddl).select(F.lit(f).alias("format"), "doc_id", "text", "n_chars")
             for f in ("jsonl", "json", "parquet")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SPLIT_SQL = "CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < 'c' THEN 'test' ELSE 'train' END"


@query("dataset_split_export", f"SELECT doc_id, source AS subset, {_SPLIT_SQL} AS split, lang, text FROM documents")
def q_dataset_split_export(spark, sf):
    """SRC-4: documents exported per (subset = source, split) as JSON lines and read back
    with the partition columns."""
    d = table(spark, sf, "documents")
    split = F.when(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "c", "test").otherwise("train")
    path = io.scratch_path(spark, "export")
    io.dataset_split_export(d.select("doc_id", "lang", "text", F.col("source").alias("subset"), split.alias("split")),
                            path, "subset", "split")
    back = spark.read.schema("doc_id bigint, lang string, text string, subset string, split string").json(path)
    return back.select("doc_id", "subset", "split", "lang", "text")


@query("record_contract", """SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'missing quality' END AS contract_error
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_record_contract(spark, sf):
    """SRC-5: documents joined to labels; a row without a label fails the contract."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return io.record_contract(d, ["doc_id", "text", "quality"]).select("doc_id", "contract_error")


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, CAST(count(*) AS BIGINT) AS rows FROM {t}" for t in TABLES))
def q_row_counts(spark, sf):
    """SRC-6: rows per dataset."""
    return io.row_counts({t: table(spark, sf, t) for t in TABLES})


@query("sink_sharded", f"WITH {IDX_SQL} SELECT idx, conv_id, turn, instruction AS input, output, CAST(idx % 4 AS INTEGER) AS shard FROM idxd")
def q_sink_sharded(spark, sf):
    """SNK-2: records written one directory per rank (``shard = idx % 4``) and read back."""
    r = inputs.indexed_records(spark, sf).select("idx", "conv_id", "turn", "input", "output", F.pmod("idx", F.lit(4)).cast("int").alias("shard"))
    path = io.scratch_path(spark, "sharded")
    io.sink_sharded(r, path)
    return spark.read.schema("idx bigint, conv_id bigint, turn bigint, input string, output string, shard int").json(path)


_SUMMARY_DDL = ("total_time double, example_numbers bigint, average_time double, temperature double, do_sample boolean, "
                "max_new_tokens int, top_k int, top_p double, repetition_penalty double")


@query("sink_run_summary", f"""WITH {RES_CTES}
SELECT round(sum(elapsed_s), 6) AS total_time, CAST(count(*) AS BIGINT) AS example_numbers,
  round(sum(elapsed_s) / count(*), 9) AS average_time, CAST(0.4 AS DOUBLE) AS temperature, true AS do_sample,
  CAST(1024 AS INTEGER) AS max_new_tokens, CAST(40 AS INTEGER) AS top_k, CAST(0.85 AS DOUBLE) AS top_p,
  CAST(1.05 AS DOUBLE) AS repetition_penalty, CAST(count(*) AS BIGINT) AS rows_written FROM stored""")
def q_sink_run_summary(spark, sf):
    """SNK-3: generation rows and the run summary written as two datasets and read back."""
    flat = io.materialize(stored_results(spark, sf), "results")
    summary = G.run_summary(flat, SETTINGS)
    summary = summary.select(F.round("total_time", 6).alias("total_time"), "example_numbers",
                             F.round("average_time", 9).alias("average_time"), *SETTINGS.keys())
    rp, sp = io.sink_run_summary(flat.select("id", "status", "error"), summary, io.scratch_path(spark, "run"))
    back = spark.read.schema(_SUMMARY_DDL).json(sp)
    n = spark.read.schema("id bigint, status string, error string").json(rp).agg(F.count(F.lit(1)))
    return back.withColumn("rows_written", n.scalar())


@query("sink_responses", f"WITH {GEN_CTES} SELECT id, content AS response FROM flat")
def q_sink_responses(spark, sf):
    """SNK-4: ``{id, response}`` written as JSON lines (nulls kept) and read back."""
    f = results(spark, sf).select("id", F.col("content").alias("response"))
    path = io.scratch_path(spark, "responses")
    io.sink_responses(f, path)
    return spark.read.schema("id bigint, response string").json(path)


@query("sink_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def q_sink_jsonl(spark, sf):
    """SNK-1: user turns written as JSON lines (overwrite), then the other turns appended
    (append mode); the folder read back holds every conversation row once."""
    c = table(spark, sf, "conversations")
    path = io.scratch_path(spark, "sink.jsonl")
    io.sink_jsonl(c.filter(F.col("role") == "user"), path, mode="overwrite")
    io.sink_jsonl(c.filter(F.col("role") != "user"), path, mode="append")
    return spark.read.schema(CONV_DDL).json(path)
