"""Next rows and running values over sampled ranges against plain windows, with hot keys and gaps."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators.conversations import chat_segments
from parlance.operators.templates import conversation_pairs
from parlance.plans import ranges
from tests.conftest import rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def make(spark, hot, others, seed=1, step=1):
    rnd = random.Random(seed)
    data = [(1, t * step + 1_700_000_000_000, rnd.choice("ua"), rnd.randrange(-5, 6)) for t in rnd.sample(range(3 * hot), hot)]
    data += [(rnd.choice([None, 2, 3, 4]), 10 * i, rnd.choice("ua"), rnd.choice([None, 1, 2])) for i in range(others)]
    return spark.createDataFrame(data, "k long, t long, role string, v long")


@pytest.mark.parametrize("hot,others,parts", [(400, 60, 7), (0, 30, 5), (5, 3, 16), (50, 0, 4), (0, 0, 3)])
def test_ranges_equal_windows(spark, hot, others, parts):
    d = make(spark, hot, others)
    w = Window.partitionBy("k").orderBy("t")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    got = ranges.next_row(d, ["k"], ["t"], ["t", "v"], partitions=parts).withColumn("n", F.col("_next.t")).withColumn("nv", F.col("_next.v"))
    want = d.withColumn("n", F.lead("t").over(w)).withColumn("nv", F.lead("v").over(w))
    assert rows(got, "k", "t", "v", "n", "nv") == rows(want, "k", "t", "v", "n", "nv")
    run = ranges.running(d, ["k"], ["t"], {"s": ("v", "sum"), "m": ("v", "max"), "l": ("v", "min")}, parts)
    want = d.select("k", "t", F.sum("v").over(up).alias("s"), F.max("v").over(up).alias("m"), F.min("v").over(up).alias("l"))
    assert rows(run, "k", "t", "s", "m", "l") == rows(want, "k", "t", "s", "m", "l")


def test_rows_cross_once_and_a_hot_key_is_spread(spark):
    d = make(spark, 3000, 10)
    r = ranges.in_ranges(d, ["k", "t"], partitions=6)
    sizes = [x["count"] for x in r.where("k = 1").groupBy("_part").count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 1500
    for df in (ranges.next_row(d, ["k"], ["t"], ["v"]), ranges.running(d, ["k"], ["t"], {"s": ("v", "sum")})):
        plan = plan_of(df)
        assert "Bucketed: true" in plan
        # rows: scan, sort, window, join; exchanges lie over aggregates by range only
        assert all("hashpartitioning(_last" in x or "SinglePartition" in x or "BroadcastExchange" in x
                   for x in plan.split("\n") if "Exchange " in x)


def conv(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_pairs_over_gaps(spark):
    data = [(1, 0, "user", "q0"), (1, 2, "assistant", "a2"), (1, 7, "user", "q7"), (1, 9, "user", "q9"), (1, 10, "assistant", "a10"),
            (2, 0, "assistant", "a"), (2, 5, "user", "last"), (3, 0, "assistant", "not of 2"), (4, 1, "user", "u"), (4, 3, "system", "s"),
            (4, 4, "assistant", "x"), (5, 0, "user", None), (5, 1, "assistant", None)]
    got = rows(conversation_pairs(conv(spark, data).repartition(5)), "conv_id", "turn", "instruction", "output")
    assert got == [(1, 0, "q0", "a2"), (1, 9, "q9", "a10"), (5, 0, None, None)]
    assert conversation_pairs(conv(spark, [])).count() == 0


def test_segments_with_millisecond_seq(spark):
    lines = [(1, 1_700_000_000_000 + 997 * i, q) for i, q in enumerate(["hi", "new  topic", "x", "news", "y"] * 40)]
    lines += [(2, 5, " a "), (2, 1_700_000_000_000, "QUIT"), (2, 1_700_000_000_001, "after"), (3, 1, "quit"), (4, 1, "new"), (None, 1, "n")]
    d = spark.createDataFrame(lines, "user_id long, seq long, query string")
    got = rows(chat_segments(d), "user_id", "seq", "segment", "new_topic", "text")
    want, seg, done = [], {}, set()
    for u, s, q in sorted(lines, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        q = q.strip()
        if q.lower() == "quit":
            done.add(u)
        if u in done:
            continue
        new = q.startswith("new")
        seg[u] = seg.get(u, 0) + new
        want.append((u, s, seg[u], new, q[4:].strip() if new else q))
    assert got == sorted(want, key=lambda t: (t[0] is None, t[0] or 0, t[1]))
