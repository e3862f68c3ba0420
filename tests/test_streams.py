"""Delta assembly over a file stream, and state kept by key."""

import os

import pytest
from pyspark.sql import functions as F

from parlance.streaming import jobs
from parlance.streaming.deltas import DELTA_DDL, assemble_delta_files, assemble_deltas
from tests.conftest import rows

TEXT_DDL = DELTA_DDL.replace("timestamp", "string")


def arrive(spark, path, *files):
    for i, data in enumerate(files):
        d = spark.createDataFrame(data, TEXT_DDL).withColumn("ts", F.col("ts").cast("timestamp"))
        d.coalesce(1).write.parquet(f"{path}/{i}")


def at(m, s=0):
    return f"2024-01-01 00:{m:02d}:{s:02d}"


def test_out_of_order_and_late_deltas(spark, tmp_dir):
    first = [("a", 2, "lo", "stop", at(0, 2)), ("b", 1, "wor", None, at(0, 1)), ("n", 1, None, None, at(0, 3))]
    second = [("a", 1, "Hel", None, at(0, 1)), ("c", 1, "x", "length", at(1))]       # out of order, in time
    third = [("d", 1, "later", "stop", at(20))]                                      # closes a, b, c
    then = [("f", 1, "f", "stop", at(20, 40))]  # Spark drops by the watermark of the micro-batch before
    fourth = [("b", 2, "ld", "stop", at(0, 2)), ("c", 2, "y", None, at(1, 1)), ("e", 1, "end", "stop", at(21))]  # b, c: late
    fifth = [("closer", 1, "", None, at(59))]  # itself still open at the end
    arrive(spark, f"{tmp_dir}/in", first, second, third, then, fourth, fifth)
    got, stats = assemble_delta_files(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck", "10 seconds", "2 minutes")
    on_time = spark.createDataFrame(first + second + third + then + fourth[2:], TEXT_DDL)
    cols = ["response_id", "text", "n_deltas", "finish_reason", "status"]
    assert rows(got, *cols) == rows(assemble_deltas(on_time), *cols)
    assert sum(stats.dropped.values()) == 2 and sum(stats.rows.values()) == 11


def test_a_second_run_goes_on_from_the_checkpoint(spark, tmp_dir):
    args = (spark, f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck", "10 seconds", "1 minute")
    arrive(spark, f"{tmp_dir}/in", [("a", 1, "A", None, at(0)), ("z", 1, "", None, at(0, 30))])
    got, _ = assemble_delta_files(*args)
    assert got.count() == 0  # nothing is closed yet; state holds both
    d = spark.createDataFrame([("a", 2, "B", "stop", at(0, 5)), ("y", 1, "", None, at(30))], TEXT_DDL)
    d.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_dir}/in/1")
    got, stats = assemble_delta_files(*args)
    assert rows(got, "response_id", "text", "status") == [("a", "AB", "complete"), ("z", "", "incomplete")]
    assert sum(stats.dropped.values()) == 0


def latest(df):
    return df.groupBy("k", "name", "bucket").agg(F.max("v").alias("v")).select("k", "name", "v", "bucket")


@pytest.fixture()
def state(spark, tmp_dir):
    return jobs.KeyedState(spark, f"{tmp_dir}/state", "k long, name string, v long", "k", latest, 8)


def change(spark, data):
    return spark.createDataFrame(data, "k long, name string, v long")


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_merge_rewrites_only_touched_buckets(spark, state):
    assert state.read().count() == 0 and state.ready() is None
    state.merge(change(spark, [(i, "a", i) for i in range(100)]), 0)
    before = files(state.table)
    touched = state.merge(change(spark, [(7, "a", 500), (7, "b", 1), (1000, None, 3)]), 1)
    after = files(state.table)
    assert 1 <= len(touched) <= 2
    same = {f for f in before if f"bucket={touched[0]}/" not in f and f"bucket={touched[-1]}/" not in f}
    assert same <= set(after) and all(before[f] == after[f] for f in same)
    assert len(after) <= len(before) + 1  # replaced files are gone
    want = {(i, "a"): i for i in range(100)} | {(7, "a"): 500, (7, "b"): 1, (1000, None): 3}
    assert {(r.k, r.name): r.v for r in state.read().collect()} == want


def test_a_replayed_batch_mends_a_half_replaced_table(spark, state):
    state.merge(change(spark, [(i, "a", i) for i in range(50)]), 0)
    touched = state.merge(change(spark, [(3, "a", 99)]), 1)
    want = rows(state.read(), "k", "name", "v")
    for f in files(f"{state.table}/bucket={touched[0]}"):  # as if the run had died between delete and rename
        os.replace(f, f + ".lost")
        os.replace(f + ".lost", f"{os.path.dirname(state.table)}/{os.path.basename(f)}")
    assert rows(state.read(), "k", "name", "v") != want
    state.merge(change(spark, [(3, "a", 99)]), 1)
    assert rows(state.read(), "k", "name", "v") == want
    state.merge(change(spark, []), 2)
    assert rows(state.read(), "k", "name", "v") == want


def test_a_new_stream_into_old_state_is_no_replay(spark, state):
    state.merge(change(spark, [(1, "a", 1)]), 0, "first")
    state.merge(change(spark, [(1, "a", 5), (2, "b", 1)]), 0, "second")
    assert rows(state.read(), "k", "name", "v") == [(1, "a", 5), (2, "b", 1)]


def test_config_stream_goes_on_and_starts_anew(spark, tmp_dir):
    ddl = "g long, seq long, kind string, agent string, d string"
    put = lambda name, data: spark.createDataFrame(data, ddl).coalesce(1).write.parquet(f"{tmp_dir}/{name}")
    run = lambda src, ck: rows(jobs.stream_config_upsert(
        spark, f"{tmp_dir}/{src}/*", ddl, f"{tmp_dir}/state", f"{tmp_dir}/{ck}", "g", "seq", "kind", "agent", ["d"], buckets=4))
    put("a/1", [(1, 1, "role_config", "x", "x1"), (1, 2, "background", None, "bg")])
    assert run("a", "ck") == [(1, 0, "x", "x1", "bg")]
    put("a/2", [(1, 3, "role_config", "y", "y3"), (1, 4, "role_config", "x", "x4"), (2, 1, "other", "z", "-")])
    want = [(1, 0, "x", "x4", "bg"), (1, 1, "y", "y3", "bg")]
    assert run("a", "ck") == want
    put("b/1", [(1, 5, "role_config", "y", "y5")])
    assert run("b", "ck2") == [want[0], (1, 1, "y", "y5", "bg")]
