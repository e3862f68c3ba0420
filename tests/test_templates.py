from pyspark.sql import functions as F

from parlance.operators import templates as T
from tests.conftest import rows


def test_chatml_strings(spark):
    df = spark.createDataFrame([("hi", "yo")], "instruction string, output string")
    r = df.select(T.render_source("instruction").alias("s"),
                  T.render_source("instruction", add_generation_prompt=False).alias("t"),
                  T.render_target("output").alias("q"), T.render_target("output", "llama2").alias("l"),
                  T.render_source("instruction", "llama2", with_system=False).alias("i"),
                  T.render_source("instruction", "llama2").alias("iw")).first()
    assert r.s == ("<|im_start|>system\nYou are a helpful assistant<|im_end|>\n"
                   "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n")
    assert r.t == "<|im_start|>system\nYou are a helpful assistant<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert r.q == "yo</s>"
    assert r.l == " yo </s>"
    assert r.i == "<s>[INST] hi [/INST]"
    assert r.iw == "<s>[INST] <<SYS>>\nYou are a helpful assistant\n<</SYS>>\n\nhi [/INST]"


def test_conversation_pairs_adjacency(spark):
    conv = spark.createDataFrame([
        (1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"),
        (2, 0, "user", "x"), (2, 1, "user", "y"), (2, 2, "assistant", "z"),
    ], "conv_id bigint, turn bigint, role string, text string")
    assert rows(T.conversation_pairs(conv), "conv_id", "turn", "instruction", "output") == [
        (1, 1, "u1", "a1"), (2, 1, "y", "z")]


def test_system_user_messages_null_system(spark):
    df = spark.createDataFrame([("q", None), ("q", "sys")], "c string, s string")
    out = [r[0] for r in df.select(F.to_json(T.system_user_messages("c", F.col("s")))).collect()]
    assert out[0] == '[{"role":"user","content":"q"}]'
    assert out[1] == '[{"role":"system","content":"sys"},{"role":"user","content":"q"}]'


def test_preference_triples_drops_columns(spark):
    df = spark.createDataFrame([("p", "c", "r", 7)], "prompt string, chosen string, rejected string, extra int")
    out = T.preference_triples(df)
    assert out.columns == ["prompt", "chosen", "rejected"]
    r = out.first()
    assert r.prompt[0].role == "user" and r.chosen[0].role == "assistant" and r.rejected[0].content == "r"


def test_request_params_overrides(spark):
    df = spark.createDataFrame([(None,), (0.1,)], "t double").withColumn("messages", T.user_messages(F.lit("x")))
    out = T.request_params(df, "messages", {"temperature": "t"}).select("temperature", "top_k", "max_tokens", "stream")
    assert rows(out) == [(0.1, 50, 1500, False), (0.8, 50, 1500, False)]
