from hypothesis import given, settings, strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators import batching as B, ordering
from parlance.plans.rank import global_rank, md5_rank, range_rank
from tests.conftest import rows


def test_pad_right_left_and_masks(spark):
    df = spark.createDataFrame([(1, 0, [5, 6, 7], [-100, 6, 7]), (2, 0, [8], [8])],
                               "k int, batch_id long, ids array<int>, labels array<int>")
    r = {x.k: x for x in B.pad_batch(df, "ids", "labels", "batch_id").collect()}
    assert r[2].ids == [8, 0, 0] and r[2].labels == [8, -100, -100] and r[2].attention_mask == [1, 0, 0]
    l = {x.k: x for x in B.pad_batch(df, "ids", None, "batch_id", side="left", mask_mode="by_length").collect()}
    assert l[2].ids == [0, 0, 8] and l[2].attention_mask == [0, 0, 1]


def test_parity_mask_hides_real_eos_when_pad_is_eos(spark):
    df = spark.createDataFrame([(0, [5, 1]), (0, [5, 6, 7])], "batch_id long, ids array<int>")
    out = B.pad_batch(df, "ids", None, "batch_id", pad_id=1)
    masks = sorted(r.attention_mask for r in out.collect())
    assert [1, 0, 0] in masks  # the real eos (id 1) is masked like a pad in parity mode


def test_strided_shard_drops_tail(spark):
    df = spark.range(10).withColumnRenamed("id", "idx")
    kept = B.strided_shard(df, "idx", 4)
    assert rows(kept, "idx") == [(i,) for i in range(8)]
    assert {r.shard for r in kept.collect()} == {0, 1, 2, 3}
    assert B.strided_shard(df, "idx", 4, keep_tail=True).count() == 10


def test_assign_batches_last_short(spark):
    df = spark.range(1, 20).withColumnRenamed("id", "rank")
    counts = dict(rows(B.assign_batches(df, "rank", 8).groupBy("batch_id").count()))
    assert counts == {0: 8, 1: 8, 2: 3}


def test_global_rank_equals_row_number_any_partitioning(spark):
    base = spark.range(0, 3000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("h"))
    want = rows(base.select("id", F.row_number().over(Window.orderBy("h", "id")).alias("r")))
    for parts in (1, 4, 16):
        got = md5_rank(base.repartition(parts), F.col("h"), [F.col("id")], "r", digits=2)
        assert rows(got, "id", "r") == want


def test_global_rank_with_data_bucket(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "id long, g long")
    got = global_rank(df, [F.col("g"), F.col("id")], F.col("g"), "r")
    want = rows(df.select("id", F.row_number().over(Window.orderBy("g", "id")).alias("r")))
    assert rows(got, "id", "r") == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=40, unique=True), st.integers(0, 99))
def test_seeded_shuffle_is_permutation(spark, ids, seed):
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    r = ordering.seeded_shuffle(df, ["k"], seed).collect()
    assert sorted(x.rank for x in r) == list(range(1, len(ids) + 1))
    assert sorted(x.k for x in r) == sorted(ids)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.integers(2, 99), max_size=6), min_size=1, max_size=6))
def test_pad_then_unpad_identity(spark, seqs):
    df = spark.createDataFrame([(i, 0, s) for i, s in enumerate(seqs)], "k int, batch_id long, ids array<int>")
    out = B.pad_batch(df, "ids", None, "batch_id").collect()
    width = max(len(s) for s in seqs)
    for r in out:
        assert len(r.ids) == width
        assert [x for x, m in zip(r.ids, r.attention_mask) if m] == seqs[r.k]


def test_range_rank_with_a_hot_bucket(spark):
    """A third of the rows share count 1 and one two-character prefix (the vocabulary's worst
    case). Ranks equal a brute-force sort, and no sampled range is hot."""
    rows_ = ([(f"ht{i:05d}", 1) for i in range(3000)] + [(f"w{i:05d}", 1 + i % 7) for i in range(6000)])
    df = spark.createDataFrame(rows_, "token string, n long").repartition(5)
    out = range_rank(df, [F.col("n").desc(), F.col("token")], "rank", partitions=8)
    got = sorted((r["rank"], r["token"]) for r in out.collect())
    want = sorted(rows_, key=lambda t: (-t[1], t[0]))
    assert [t for _, t in got] == [t for t, _ in want]
    assert [k for k, _ in got] == list(range(1, len(rows_) + 1))
    sizes = (df.repartitionByRange(8, F.col("n").desc(), F.col("token"))
             .groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert max(r["count"] for r in sizes) < 2 * len(rows_) / 8
