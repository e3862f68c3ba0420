import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parlance.operators import tokens as K
from parlance.plans import sft
from tests.conftest import rows


def test_special_tokens_spaced(spark):
    df = spark.createDataFrame([("a<|im_end|>b <No Retrieval>c</s>",)], "t string")
    assert df.select(K.split_tokens("t")).first()[0] == ["a", "<|im_end|>", "b", K.NO_RETRIEVAL_PLACEHOLDER, "c", "</s>"]


def test_blank_text_no_tokens(spark):
    df = spark.createDataFrame([("  \n\t ",), ("",)], "t string")
    assert [r[0] for r in df.select(K.split_tokens("t")).collect()] == [[], []]


def test_label_mask_edges(spark):
    df = spark.createDataFrame([([5, 6, 7], 1), ([5, 6], 5), ([], 2), ([5, 6, 7], 0)], "ids array<int>, m int")
    out = [r[0] for r in df.select(K.label_mask("ids", F.col("m"))).collect()]
    assert out == [[-100, 6, 7], [-100, -100], [], [5, 6, 7]]


def test_hashed_ids_match_python(spark):
    toks = ["hello", "<pad>", "</s>", "wörld"]
    df = spark.createDataFrame([(toks,)], "t array<string>")
    got = df.select(K.hashed_ids("t", 1000)).first()[0]
    want = [int(hashlib.md5(b"hello").hexdigest()[:8], 16) % 1000 + 7, 0, 1,
            int(hashlib.md5("wörld".encode()).hexdigest()[:8], 16) % 1000 + 7]
    assert got == want


def test_vocabulary_order_and_roundtrip(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "c", "</s>"]), (2, ["a", "b", "zz"])], "k bigint, toks array<string>")
    vocab = K.build_vocabulary(df, "toks")
    v = {r.token: (r.id, r.n) for r in vocab.collect()}
    assert v["b"] == (7, 3) and v["a"] == (8, 2) and v["c"][0] == 9 and v["zz"][0] == 10
    assert v["</s>"] == (1, 1) and v["<pad>"] == (0, 0)
    enc = K.encode(df, ["k"], "toks", vocab)
    dec = K.decode(enc.select("k", "ids"), ["k"], "ids", vocab, skip_special=True)
    assert rows(dec, "k", "text") == [(1, "b a b c"), (2, "a b zz")]


def test_sft_plan_masks_source(spark):
    conv = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "hi")],
                                 "conv_id bigint, turn bigint, role string, text string")
    rows_, _ = sft.tokenize_examples(sft.sft_examples(conv), max_len=128)
    r = rows_.first()
    assert len(r.ids) == len(r.labels) == r.n_full
    assert r.labels[: r.n_source] == [-100] * r.n_source
    assert r.labels[r.n_source:] == r.ids[r.n_source:] and r.labels[-1] == K.EOS_ID


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=12), st.integers(0, 20))
def test_label_mask_length_property(spark, ids, m):
    df = spark.createDataFrame([(ids, m)], "ids array<int>, m int")
    lab = df.select(K.label_mask("ids", F.col("m"))).first()[0]
    assert len(lab) == len(ids)
    k = min(m, len(ids))
    assert lab == [-100] * k + ids[k:]


def test_markers_and_frequent_tokens_do_not_meet_in_a_shuffle(spark):
    toks = [(i, ["</s>"] * 30 + ["the"] * 10 + [f"t{i}", f"u{i % 7}"]) for i in range(60)] + [(60, []), (61, ["never seen"])]
    df = spark.createDataFrame(toks, "k long, toks array<string>")
    vocab = K.build_vocabulary(df.where("k < 61"), "toks")
    ex = df.select("k", F.posexplode_outer("toks").alias("_pos", "token"))
    near, tail = K.look_up(ex, vocab, "token", hot=8)  # the, u0..u6
    assert {r.token for r in tail.select("token").distinct().collect()} == {f"t{i}" for i in range(60)} | {"never seen"}
    assert near.count() + tail.count() == 60 * 42 + 2
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(token" not in plan
    ids = {r.token: r.id for r in vocab.collect()}
    for hot in (0, 8, 4096):
        K.HOT_TOKENS, old = hot, K.HOT_TOKENS
        try:
            got = {r.k: r.ids for r in K.encode(df, ["k"], "toks", vocab, carry=[]).collect()}
            assert got == {k: [ids.get(t, K.UNK_ID) for t in x] for k, x in toks}
            back = {r.k: r.text for r in K.decode(K.encode(df, ["k"], "toks", vocab, carry=[]), ["k"], "ids", vocab, carry=[]).collect()}
            assert back[3] == " ".join(["the"] * 10 + ["t3", "u3"]) and back[60] == back[61] == ""
        finally:
            K.HOT_TOKENS = old
