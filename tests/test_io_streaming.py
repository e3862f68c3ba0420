import os

import pytest
from pyspark.sql import functions as F

from parlance.sources import io
from parlance.streaming import jobs
from parlance.streaming.deltas import DELTA_DDL, assemble_deltas, assemble_deltas_stream
from tests.conftest import rows


def test_jsonl_corrupt_and_strict(spark, tmp_dir):
    p = os.path.join(tmp_dir, "x.jsonl")
    with open(p, "w") as f:
        f.write('{"a": 1, "b": "é"}\n\n{bad\n{"a": 2}\n')
    df = io.scan_jsonl(spark, p, "a long, b string")
    got = rows(df, "a", "b", "_corrupt_record")
    assert sorted(got, key=repr) == sorted([(None, None, "{bad"), (1, "é", None), (2, None, None)], key=repr)
    with pytest.raises(Exception):
        io.scan_jsonl(spark, p, "a long, b string", strict=True).collect()


def test_suffix_dispatch_and_json_arrays(spark, tmp_dir):
    with pytest.raises(NotImplementedError):
        io.scan_by_suffix(spark, "/x/data.xlsx", "a long")
    with pytest.raises(ValueError):
        io.scan_by_suffix(spark, "/x/data.csv", "a long")
    df = spark.range(25).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("v")).alias("b"))
    path = os.path.join(tmp_dir, "arr.json")
    io.sink_json_arrays(df, path, 3)
    back = io.scan_by_suffix(spark, path, "a long, b string")
    assert rows(back) == rows(df)


def test_sink_jsonl_keeps_nulls(spark, tmp_dir):
    path = os.path.join(tmp_dir, "n.jsonl")
    io.sink_jsonl(spark.createDataFrame([(1, None)], "a long, b string"), path)
    text = "".join(open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".json"))
    assert '"b":null' in text


def _deltas(spark):
    ts = "2024-01-01 00:00:{:02d}"
    data = [("r1", 1, "Hel", None, ts.format(1)), ("r1", 3, "lo", "stop", ts.format(2)), ("r1", 2, None, None, ts.format(1)),
            ("r1", 4, "IGNORED", None, ts.format(3)), ("r2", 1, "par", None, ts.format(5)), ("r2", 2, "tial", None, ts.format(6))]
    return spark.createDataFrame(data, "response_id string, seq long, delta string, finish_reason string, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))


def test_assemble_deltas_batch(spark):
    got = rows(assemble_deltas(_deltas(spark)), "response_id", "text", "n_deltas", "status")
    assert got == [("r1", "Hello", 3, "complete"), ("r2", "partial", 2, "incomplete")]


def test_assemble_deltas_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "deltas")
    d = _deltas(spark)
    d.coalesce(1).write.parquet(os.path.join(src, "b1"))
    # a later event moves the watermark past every session so all of them are emitted
    spark.createDataFrame([("zz", 1, "x", "stop", "2024-01-01 01:00:00")],
                          "response_id string, seq long, delta string, finish_reason string, ts string") \
        .withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(os.path.join(src, "b2"))
    stream = spark.readStream.schema(DELTA_DDL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    out = os.path.join(tmp_dir, "out")
    jobs.run_available(lambda: assemble_deltas_stream(stream, "30 seconds", "10 seconds").writeStream
                       .format("parquet").outputMode("append").option("checkpointLocation", os.path.join(tmp_dir, "ck"))
                       .trigger(availableNow=True).start(out))
    got = rows(spark.read.parquet(out).filter("response_id != 'zz'"), "response_id", "text", "status")
    assert got == rows(assemble_deltas(d), "response_id", "text", "status")
