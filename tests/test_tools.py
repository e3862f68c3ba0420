import json
import urllib.parse

from pyspark.sql import functions as F

from parlance.operators import tools as TL
from tests.conftest import rows


def _calls(spark, data):
    return spark.createDataFrame(data, "message_id long, pos int, call_id string, type string, name string, arguments string")


def test_dispatch_statuses_and_results(spark):
    calls = _calls(spark, [
        (1, 0, "c1", "function", "add", '{"a": 2, "b": 40}'),
        (1, 1, "c2", "function", "add", '{"a": 2'),
        (1, 2, "c3", "function", "nope", "{}"),
        (2, 0, "c4", "function", "get_current_temperature", '{"location": "Paris"}'),
        (2, 1, "c5", "function", "get_current_wind_speed", '{"location": "Oslo"}'),
    ])
    got = {r.call_id: (r.status, r.result) for r in TL.dispatch_tools(calls).collect()}
    assert got["c1"] == ("ok", "42")
    assert got["c2"] == ("bad_arguments", None)
    assert got["c3"] == ("unknown_tool", None)
    assert json.loads(got["c4"][1]) == {"location": "Paris", "unit": "celsius", "temperature": 22.0}
    assert json.loads(got["c5"][1]) == {"location": "Oslo", "wind_speed": 15.0}


def test_image_url_matches_python_quote(spark):
    prompt = "a cat ~ on/the *mat* 100% ü&x=1"
    df = spark.createDataFrame([(prompt,)], "p string")
    got = json.loads(df.select(TL.image_url_json(F.col("p"))).first()[0])
    assert got == {"image_url": TL.IMAGE_URL_BASE + urllib.parse.quote(prompt)}


def test_same_name_two_servers_first_wins(spark):
    calls = _calls(spark, [(1, 0, "c1", "function", "get_current_temperature", "{}")])
    r = TL.route_tool_calls(calls, TL.BUILTIN.catalog(spark)).first()
    assert r.server == "mcp" and r.route_status == "routed"
    r2 = TL.route_tool_calls(_calls(spark, [(1, 0, "c", "function", "zzz", "{}")]), TL.BUILTIN.catalog(spark)).first()
    assert r2.server is None and r2.route_status == "unknown_tool"


def test_explode_null_and_empty_lists(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [("i", "function", "add", "{}")])],
                               f"message_id long, tool_calls array<{TL.CALL_DDL}>")
    got = rows(TL.explode_tool_calls(df, "message_id"), "message_id", "pos", "call_id")
    assert got == [(1, None, None), (2, None, None), (3, 0, "i")]


def test_hermes_extraction_with_bad_block(spark):
    text = 'x<tool_call>\n{"name": "add", "arguments": {"a": 1}}\n</tool_call> y <tool_call>{bad</tool_call>'
    df = spark.createDataFrame([(1, text)], "k long, t string")
    got = rows(TL.extract_hermes_calls(df, "k", "t"), "pos", "name", "arguments", "valid")
    assert got == [(0, "add", '{"a":1}', True), (1, None, None, False)]


def test_tool_turn_in_call_order_with_missing_result(spark):
    calls = _calls(spark, [(1, 1, "b", "function", "add", '{"a": 1, "b": 1}'),
                           (1, 0, "a", "function", "nope", "{}")])
    d = TL.dispatch_tools(calls)
    att = TL.attach_tool_results(d.select("message_id", "pos", "call_id"), TL.tool_messages(d), "message_id").first()
    assert att.n_calls == 2 and att.n_results == 1
    assert [(m.tool_call_id, m.content) for m in att.tool_messages] == [("a", None), ("b", "2")]


def test_flatten_blocks(spark):
    blocks = [("text", "Hi", None, None, None), ("tool_use", None, "add", '{"a": 1}', "It is 2."),
              ("text", "Bye", None, None, None)]
    df = spark.createDataFrame([(blocks,)], "b array<struct<type:string,text:string,name:string,input:string,follow_up:string>>")
    assert df.select(TL.flatten_blocks("b")).first()[0] == 'Hi\n[Calling tool add with args {"a": 1}]\nIt is 2.\nBye'


def test_user_registered_tool(spark):
    reg = TL.ToolRegistry()

    @reg.register("echo", "Echo text", {"type": "object", "properties": {"t": {"type": "string"}}})
    def _echo(args):
        return F.upper(F.try_variant_get(args, "$.t", "string"))

    calls = _calls(spark, [(1, 0, "c", "function", "echo", '{"t": "hey"}')])
    assert TL.dispatch_tools(calls, reg).first().result == "HEY"
    cat = reg.catalog(spark).first()
    assert json.loads(cat.parameters) == {"properties": {"t": {"type": "string"}}, "type": "object"}


def test_arguments_are_checked_against_the_schema(spark):
    from parlance.operators import tools as TL
    cases = {"sum": ("add", '{"a": 1, "b": 2}'), "missing": ("add", '{"a": 1}'), "part": ("add", '{"a": 1.5, "b": 2}'),
             "list": ("add", "[1, 2]"), "over": ("add", '{"a": 9223372036854775807, "b": 1}'), "words": ("add", '{"a": "x", "b": 2}'),
             "where": ("get_current_temperature", "{}"), "unknown": ("nope", "{}"), "broken": ("add", '{"a": 1')}
    df = spark.createDataFrame([(k, *v) for k, v in cases.items()], "k string, name string, arguments string")
    got = {r.k: (r.status, r.result) for r in TL.dispatch_tools(df).collect()}
    assert got.pop("sum") == ("ok", "3") and got.pop("unknown") == ("unknown_tool", None)
    assert set(got.values()) == {("bad_arguments", None)}


def test_a_turn_opens_with_the_default_system_message(spark):
    df = spark.createDataFrame([(1, "q", None), (2, "q", []), (3, "q", [("user", "a"), ("assistant", "b")])],
                               "k long, q string, m array<struct<role:string,content:string>>")
    got = {r.k: [tuple(x) for x in r.o] for r in df.select("k", TL.opening_messages(F.col("q"), F.col("m")).alias("o")).collect()}
    fresh = [("system", TL.DEFAULT_SYSTEM_TOOL_CHAT), ("user", "q")]
    assert got == {1: fresh, 2: fresh, 3: [("user", "a"), ("assistant", "b"), ("user", "q")]}
