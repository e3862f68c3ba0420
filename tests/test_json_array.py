"""JSON array files cut anywhere, against the json module."""

import io as pyio
import json
import random

import pytest

from parlance.sources import io, json_array as J
from parlance.operators import conversations as CV
from pyspark.sql import Window
from pyspark.sql import functions as F
from tests.conftest import rows

NASTY = [{"a": 1, "b": 'x"},{"a": 2'}, {"a": 2, "b": "\\\\"}, {"a": 3, "b": "é😀\\\""}, {"a": 4, "b": None}, {"a": 5}, {},
         {"a": 6, "b": "[{]}"}, {"a": 7, "b": "", "c": [{"a": 1}, {"a": [2, {"x": "]"}]}]}, {"a": 8, "b": "\n\t\u0001"}]


@pytest.mark.parametrize("style", [dict(), dict(indent=2), dict(ensure_ascii=False, separators=(",", ":"))])
def test_any_cut_gives_every_record_once(style):
    raw = json.dumps(NASTY, **style).encode()
    for step in (1, 2, 3, 7, 16, 50, len(raw)):
        state, depth, got = J.OUT, 0, []
        for a in range(0, len(raw), step):
            got += [json.loads(t) for t in J.records(pyio.BytesIO(raw), len(raw), a, min(a + step, len(raw)), state, depth)]
            state, change = J.effect(raw[a:a + step], state)
            depth += change
        assert got == NASTY and (state, depth) == (J.OUT, 0)


def test_effects_compose():
    rnd = random.Random(2)
    for _ in range(300):
        raw = bytes(rnd.choice(b'"\\{}[]ab,') for _ in range(rnd.randrange(30)))
        cut = rnd.randrange(len(raw) + 1)
        for s in (J.OUT, J.IN, J.ESCAPE):
            mid, d = J.effect(raw[:cut], s)
            end, e = J.effect(raw[cut:], mid)
            assert (end, d + e) == J.effect(raw, s)


def test_one_file_is_read_in_many_tasks(spark, tmp_dir):
    data = [{"a": i, "b": "x" * (i % 50) + '"},{'} for i in range(3000)]
    path = f"{tmp_dir}/one.json"
    with open(path, "w") as f:
        json.dump(data, f)
    df = io.scan_by_suffix(spark, path, "a long, b string")
    assert rows(df) == [(r["a"], r["b"]) for r in data]
    parts = io.scan_json_array(spark, path, "a long, b string", 5000).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 4
    for bad in ("", "[]", "  [ ] "):
        with open(path, "w") as f:
            f.write(bad)
        assert io.scan_json_array(spark, path, "a long, b string").count() == 0
    with open(path, "w") as f:
        f.write('[{"a": 1}, {"a": ')
    with pytest.raises(Exception, match="not a JSON array"):
        io.scan_json_array(spark, path, "a long, b string").collect()


def test_what_a_task_holds_does_not_grow_with_the_file(spark, tmp_dir, monkeypatch):
    cut = J.ranges([("x", 40 << 30), ("y", 5)], 12, None)
    assert max(b - a for _, _, a, b in cut) <= 4 << 20 and sum(b - a for _, _, a, b in cut) == (40 << 30) + 5
    key, path = "spark.sql.execution.arrow.maxRecordsPerBatch", f"{tmp_dir}/sizes"
    monkeypatch.setattr(io, "_bracket_lines", lambda batches: (pdf.assign(value=str(len(pdf))) for pdf in batches))
    before = spark.conf.get(key)
    io.sink_json_arrays(spark.range(3000), path, 2)
    assert max(int(r.value) for r in spark.read.text(path).collect()) <= 200 and spark.conf.get(key) == before


@pytest.mark.parametrize("block", [1, 7, 64])
def test_prefix_history_from_blocks(spark, block):
    data = [(1, i, "u" if i % 2 else "a", f"t{i}") for i in range(0, 300, 3)] + [(2, 5, "u", None), (None, 1, "u", "n"), (None, 2, "a", "m")]
    d = spark.createDataFrame(data, "k long, t long, role string, text string")
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = d.select("k", "t", F.to_json(F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w)).alias("m"))
    got = CV.prefix_history(d, ["k"], "t", "role", "text", None, block)
    assert got.columns == d.columns + ["messages"]
    assert rows(got.select("k", "t", F.to_json("messages").alias("m"))) == rows(want)
    blocks = CV.prefix_blocks(d, ["k"], "t", "role", "text", block)
    assert blocks.agg(F.sum(F.size("msgs"))).first()[0] == len(data)  # every message is stored once
    assert CV.prefix_history(d.limit(0), ["k"], "t", "role", "text").count() == 0
