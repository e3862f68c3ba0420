from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators import conversations as CV
from parlance.plans.ranges import running
from tests.conftest import rows


def _lines(spark, qs, user=1):
    return spark.createDataFrame([(user, i, q) for i, q in enumerate(qs)], "user_id long, seq long, query string")


def test_chat_segments_markers(spark):
    df = _lines(spark, ["  hello ", "new topic here", "more", "news today", "QUIT", "after quit"])
    got = rows(CV.chat_segments(df), "seq", "segment", "new_topic", "text")
    assert got == [(0, 0, False, "hello"), (1, 1, True, "topic here"), (2, 1, False, "more"), (3, 2, True, "today")]
    word = rows(CV.chat_segments(df, mode="word"), "seq", "segment", "text")
    assert word[3] == (3, 1, "news today")


def test_running_equals_window(spark):
    df = spark.createDataFrame([(u, s, (s * 7 + u) % 3) for u in range(3) for s in range(50)], "u long, s long, v long")
    w = Window.partitionBy("u").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    for how, agg in (("sum", F.sum), ("max", F.max)):
        want = rows(df.select("u", "s", agg("v").over(w).alias("r")))
        got = rows(running(df, ["u"], ["s"], {"r": ("v", how)}, 4), "u", "s", "r")
        assert got == want


def test_mentions_first_in_config_order(spark):
    agents = spark.createDataFrame([(0, "Al"), (1, "Alice"), (2, "Bob")], "pos long, name string")
    msgs = spark.createDataFrame([
        (1, "@Alice hi @Bob and @Alice"),   # 'Alice...' starts with 'Al' first in config order
        (2, "Bob says hi @Zed"),            # the piece before the first @ counts
        (3, "no mentions here"),
        (4, "@"),
    ], "k long, content string")
    got = dict(rows(CV.mentions(msgs, ["k"], "content", agents), "k", "mentions"))
    assert got == {1: ["Al", "Bob"], 2: ["Bob"], 3: [], 4: []}


def test_render_history_null_part_and_call(spark):
    df = spark.createDataFrame([("user", [("a", None), (None, "f.pdf"), ("b ", None)], None),
                                ("bot", [(" x ", None)], "add(1)")],
                               "name string, parts array<struct<text:string,file:string>>, fc string")
    line, side = CV.render_history(F.col("name"), F.col("parts"), F.col("fc"))
    got = [tuple(r) for r in df.select(line, side).collect()]
    assert got == [("user: a\n\nb", "left"), ("bot: x\nCall Function: add(1)", "right")]


def test_config_upsert_replace_in_place(spark):
    ev = spark.createDataFrame([
        (1, 1, "role_config", "a", "A1"), (1, 2, "role_config", "b", "B1"), (1, 3, "background", None, "bg1"),
        (1, 4, "role_config", "a", "A2"), (1, 5, "background", None, "bg2"), (1, 6, "other", None, "x"),
    ], "g long, seq long, kind string, agent string, description string")
    agents, bg = CV.config_upsert(ev, "g", "seq", "kind", "agent", ["description"])
    assert rows(agents, "pos", "name", "description") == [(0, "a", "A2"), (1, "b", "B1")]
    assert rows(bg, "background") == [("bg2",)]


def test_human_name_default(spark):
    a = spark.createDataFrame([(1, 0, "x", False), (1, 1, "h1", True), (1, 2, "h2", True), (2, 0, "y", None)],
                              "g long, pos long, name string, is_human boolean")
    assert rows(CV.human_name(a, "g")) == [(1, "h1"), (2, "user")]


def test_user_message_parts_first_upload_only(spark):
    m = spark.createDataFrame([(1, 1, "t1", "f.pdf"), (1, 2, "t2", "f.pdf"), (1, 3, "t3", None), (1, 4, "t4", "g.pdf")],
                              "s long, seq long, text string, file string")
    got = {r.seq: len(r.content) for r in CV.user_message_parts(m, "s", "seq", "text", "file").collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: 2}


def test_prefix_history_and_append(spark):
    df = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2")],
                               "c long, t long, role string, text string")
    h = {r.t: r.messages for r in CV.prefix_history(df, ["c"], "t", "role", "text").collect()}
    assert [m.content for m in h[2]] == [CV.DEFAULT_SYSTEM, "q1", "a1", "q2"]
    one = spark.createDataFrame([(1,)], "x int").select(
        CV.append_assistant(F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content"))),
                            F.lit("  ok \n")).alias("m")).first().m
    assert one[-1].role == "assistant" and one[-1].content == "ok"
