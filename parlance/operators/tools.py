"""Tool catalogs, tool calls and their evaluation (TL-*, JN-3, JN-4, UDF-1).

A tool is registered with a name, a description, a JSON parameter schema and a *Column
builder*: ``fn(args: Column) -> Column`` where ``args`` is the call's arguments parsed to a
VARIANT and the result is the tool's text content. Dispatch folds every registered builder into
one ``CASE name WHEN ...`` expression, so evaluating millions of calls is one projection inside
whole-stage codegen - no Python per call. A builder may also return a ``pandas_udf`` call for a
tool that cannot be written with SQL functions.

The catalog is a DataFrame (``catalog(spark)``), bounded by the number of registered tools, so
it is the side that gets broadcast in the routing join.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import url_quote
from parlance.operators.templates import DEFAULT_SYSTEM_TOOL_CHAT

# ---- Fixed values ---------------------------------------------------------------------------
TOOL_LINE = "[Calling tool {name} with args {args}]"
IMAGE_URL_BASE = "https://image.pollinations.ai/prompt/"
HERMES_CALL_RE = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
# ---------------------------------------------------------------------------------------------

CALL_DDL = "struct<id:string,type:string,name:string,arguments:string>"


def canonical_json(obj) -> str:
    """Compact JSON with sorted keys (the form a VARIANT renders back to)."""
    return json.dumps(obj, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@dataclass(frozen=True)
class Tool:
    server: str
    name: str
    description: str
    parameters: str  # canonical JSON schema
    build: Callable[[Column], Column]


class ToolRegistry:
    """UDF-1: named tools registered by decorator; ``server`` order decides name clashes."""

    def __init__(self):
        self._tools: list[Tool] = []

    def register(self, name: str, description: str, parameters: dict, server: str = "default"):
        def deco(fn: Callable[[Column], Column]):
            self._tools.append(Tool(server, name, description, canonical_json(parameters), fn))
            return fn
        return deco

    @property
    def tools(self) -> list[Tool]:
        return list(self._tools)

    def catalog(self, spark: SparkSession) -> DataFrame:
        """The catalog table ``(server_pos, server, name, description, parameters)``."""
        servers = list(dict.fromkeys(t.server for t in self._tools))
        rows = [(servers.index(t.server), t.server, t.name, t.description, t.parameters) for t in self._tools]
        return spark.createDataFrame(
            rows, "server_pos int, server string, name string, description string, parameters string")

    def accepts(self, name: Column, args: Column) -> Column:
        """Whether the arguments hold every required property of the named tool with its type (a
        whole number for ``integer``)."""
        expr, seen = None, set()
        for t in self._tools:
            if t.name in seen:
                continue
            seen.add(t.name)
            schema, ok = json.loads(t.parameters), F.lit(True)
            for key in schema.get("required", []):
                kind = schema.get("properties", {}).get(key, {}).get("type")
                if kind == "integer":
                    ok = ok & F.coalesce(_arg(args, key, "bigint").cast("double") == _arg(args, key, "double"), F.lit(False))
                else:
                    ok = ok & _arg(args, key, "double" if kind == "number" else "string").isNotNull()
            expr = F.when(name == t.name, ok) if expr is None else expr.when(name == t.name, ok)
        return F.coalesce(expr, F.lit(True)) if expr is not None else F.lit(True)

    def dispatch(self, name: Column, args: Column) -> Column:
        """TL-6: the result text of every call, ``null`` for an unknown name. The first
        registration of a name wins (server order)."""
        expr = None
        seen = set()
        for t in self._tools:
            if t.name in seen:
                continue
            seen.add(t.name)
            expr = (F.when(name == t.name, t.build(args)) if expr is None
                    else expr.when(name == t.name, t.build(args)))
        return expr if expr is not None else F.lit(None).cast("string")


def _arg(args: Column, key: str, dtype: str = "string") -> Column:
    return F.try_variant_get(args, f"$.{key}", dtype)


# ---- The reference's tools, as Column builders -------------------------------------------------
BUILTIN = ToolRegistry()

_LOCATION = {"type": "string", "description": "Name of the place."}


@BUILTIN.register("add", "Sum of two whole numbers",
                  {"type": "object", "properties": {"a": {"type": "integer", "title": "A"},
                                                    "b": {"type": "integer", "title": "B"}},
                   "required": ["a", "b"]}, server="mcp")
def _add(args: Column) -> Column:
    return F.try_add(_arg(args, "a", "bigint"), _arg(args, "b", "bigint")).cast("string")


@BUILTIN.register("get_current_temperature",
                  "Temperature now at a place.",
                  {"type": "object", "properties": {
                      "location": _LOCATION,
                      "unit": {"type": "string", "enum": ["celsius", "fahrenheit"], "default": "celsius",
                               "description": "Scale of the answer."}},
                   "required": ["location"]}, server="mcp")
def _temperature(args: Column) -> Column:
    return F.to_json(F.struct(_arg(args, "location").alias("location"),
                              F.coalesce(_arg(args, "unit"), F.lit("celsius")).alias("unit"),
                              F.lit(22.0).alias("temperature")), {"ignoreNullFields": "false"})


@BUILTIN.register("get_current_wind_speed",
                  "Wind speed now at a place, in km/h.",
                  {"type": "object", "properties": {"location": _LOCATION}, "required": ["location"]},
                  server="functions")
def _wind(args: Column) -> Column:
    return F.to_json(F.struct(_arg(args, "location").alias("location"), F.lit(15.0).alias("wind_speed")),
                     {"ignoreNullFields": "false"})


# Same name on a second server: the first registration (server "mcp") serves calls.
@BUILTIN.register("get_current_temperature",
                  "Temperature now at a place.",
                  {"type": "object", "properties": {
                      "location": {"type": "string",
                                   "description": 'Place as "City, Country"'},
                      "unit": {"type": "string", "enum": ["celsius", "fahrenheit"]}},
                   "required": ["location", "unit"]}, server="functions")
def _temperature2(args: Column) -> Column:
    return _temperature(args)


@BUILTIN.register("my_image_gen",
                  "Paints a picture from words and gives the address of the image.",
                  {"type": "object", "properties": {"prompt": {
                      "type": "string", "description": "What the picture should show, in English"}},
                   "required": ["prompt"]}, server="agent")
def _image(args: Column) -> Column:
    return image_url_json(_arg(args, "prompt"))


def image_url_json(prompt: Column, base: str = IMAGE_URL_BASE) -> Column:
    """TL-9: ``{"image_url": base + quote(prompt)}``."""
    return F.to_json(F.struct(F.concat(F.lit(base), url_quote(prompt)).alias("image_url")))


# ---- Catalog shapes ------------------------------------------------------------------------------


def unique_catalog(catalog: DataFrame) -> DataFrame:
    """One row per tool name: the first server's definition (server order)."""
    return (catalog.groupBy("name")
            .agg(F.min_by(F.struct("server", "description", "parameters"), "server_pos").alias("d"))
            .select("name", "d.server", "d.description", "d.parameters"))


def tools_per_request(calls: DataFrame, catalog: DataFrame, request: str, shape: str = "function") -> DataFrame:
    """TL-1 / TL-2 per request: the definitions of the tools a request may use (the distinct
    known names among its calls), sorted by name, as one JSON array."""
    cat = unique_catalog(catalog)
    used = calls.select(request, "name").distinct().join(cat, "name", "inner")
    # Sort plain strings (VARIANT has no order), then shape each entry.
    per = used.groupBy(request).agg(
        F.array_sort(F.collect_list(F.struct("name", "description", "parameters"))).alias("_t"))
    if shape == "function":
        shaped = F.transform("_t", lambda s: F.struct(
            F.lit("function").alias("type"),
            F.struct(s["name"].alias("name"), s["description"].alias("description"),
                     F.parse_json(s["parameters"]).alias("parameters")).alias("function")))
    else:
        shaped = F.transform("_t", lambda s: F.struct(
            s["name"].alias("name"), s["description"].alias("description"),
            F.parse_json(s["parameters"]).alias("input_schema")))
    return per.select(request, F.size("_t").cast("long").alias("n_tools"), F.to_json(shaped).alias("tools"))


# ---- Calls ---------------------------------------------------------------------------------------
def explode_tool_calls(messages: DataFrame, key: str, calls: str = "tool_calls") -> DataFrame:
    """TL-3: one row per call of each message in order; a message with a null or empty list
    keeps one row with null call fields (``posexplode_outer``)."""
    return messages.select(key, F.posexplode_outer(calls).alias("pos", "_c")).select(
        key, "pos", F.col("_c.id").alias("call_id"), F.col("_c.name").alias("name"),
        F.col("_c.arguments").alias("arguments"))


def extract_hermes_calls(df: DataFrame, key: str, text: str) -> DataFrame:
    """TL-4: ``<tool_call>{json}</tool_call>`` blocks of a text -> ``(key, pos, name,
    arguments, valid)``; ``arguments`` is compact JSON text, null when the block is not JSON."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(HERMES_CALL_RE), 1)
    ex = df.select(key, F.posexplode(blocks).alias("pos", "_b"))
    v = F.try_parse_json("_b")
    return ex.select(key, "pos", F.try_variant_get(v, "$.name", "string").alias("name"),
                     F.when(v.isNotNull(), F.get_json_object("_b", "$.arguments")).alias("arguments"),
                     v.isNotNull().alias("valid"))


def parse_tool_args(arguments) -> Column:
    """TL-5: arguments JSON text -> VARIANT, null when malformed (the reference raises)."""
    a = F.col(arguments) if isinstance(arguments, str) else arguments
    return F.try_parse_json(a)


def route_tool_calls(calls: DataFrame, catalog: DataFrame, name: str = "name") -> DataFrame:
    """JN-4: each call's tool by name (first server wins); ``status`` ``routed`` or
    ``unknown_tool``."""
    cat = unique_catalog(catalog).select(F.col("name").alias(name), "server")
    out = calls.join(cat, name, "left")
    return out.withColumn("route_status", F.when(F.col("server").isNull(), "unknown_tool").otherwise("routed"))


def dispatch_tools(calls: DataFrame, registry: ToolRegistry = BUILTIN, name: str = "name",
                   arguments: str = "arguments") -> DataFrame:
    """TL-6: evaluate every call. ``status``: ``unknown_tool``, ``bad_arguments`` (not JSON, a required
    argument missing or of another type, or no result), ``ok``; ``result`` is the tool's text, null unless ok."""
    known = F.col(name).isin(sorted({t.name for t in registry.tools}))
    # The arguments are parsed once, in their own projection: status and every tool branch
    # read the parsed value (Catalyst keeps a non-cheap column referenced several times
    # instead of inlining a copy of the parse into each use).
    parsed = calls.withColumn("_args", parse_tool_args(arguments))
    args = F.col("_args")
    status = (F.when(~F.coalesce(known, F.lit(False)), "unknown_tool")
              .when(args.isNull() | ~registry.accepts(F.col(name), args), "bad_arguments").otherwise("ok"))
    done = (parsed.withColumn("status", status)
            .withColumn("result", F.when(F.col("status") == "ok", registry.dispatch(F.col(name), args))))
    # a tool that cannot answer (an overflow, say) had bad arguments
    return done.withColumn("status", F.when((F.col("status") == "ok") & F.col("result").isNull(), "bad_arguments")
                           .otherwise(F.col("status"))).drop("_args")


def tool_messages(results: DataFrame, call_id: str = "call_id", content: str = "result") -> DataFrame:
    """Tool reply messages ``{role: tool, content, tool_call_id}``, one per evaluated call;
    ``content`` is null for a call that got no answer (unknown tool, bad arguments).

    Unanswered calls are kept rather than filtered out: a filter on the result would be pushed
    by Catalyst into the scan with the whole dispatch expression substituted, evaluating every
    tool twice. Joined by ``attach_tool_results`` the outcome is the same (content null)."""
    return results.select(F.col(call_id).alias("tool_call_id"), F.col(content).alias("content"))


def attach_tool_results(calls: DataFrame, replies: DataFrame, key: str, call_id: str = "call_id",
                        pos: str = "pos", call: Column | None = None, carry: list[Column] | None = None) -> DataFrame:
    """JN-3: the tool messages of each assistant message, in call order, joined to their calls
    by ``tool_call_id`` (left join: a call without a reply gets content null). ``call``: a call's
    columns as a struct, returned in the same order as ``calls``; ``carry``: further aggregates of a
    message's rows, so that one grouping serves the whole turn."""
    j = calls.join(replies.withColumnRenamed("tool_call_id", call_id), call_id, "left")
    msg = F.struct(F.lit("tool").alias("role"), F.col("content"), F.col(call_id).alias("tool_call_id"))
    parts = [F.col(pos).alias("p"), msg.alias("m")] + ([call.alias("c")] if call is not None else [])
    per = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("_m"),
                             F.count(F.lit(1)).alias("n_calls"),
                             F.count("content").alias("n_results"), *(carry or []))
    out = per.withColumn("tool_messages", F.col("_m.m"))
    return (out.withColumn("calls", F.col("_m.c")) if call is not None else out).drop("_m")


def opening_messages(question: Column, earlier: Column | None = None, system: str = DEFAULT_SYSTEM_TOOL_CHAT) -> Column:
    """The messages a tool conversation's turn begins with: without earlier ones the default system
    message and the question, else the earlier ones and the question."""
    user = F.struct(F.lit("user").alias("role"), question.alias("content"))
    fresh = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), user)
    if earlier is None:
        return fresh
    return F.when(F.coalesce(F.size(earlier), F.lit(0)) <= 0, fresh).otherwise(F.array_append(earlier, user))


def tool_turn_messages(prior: Column, assistant_content: Column, calls: Column, tool_msgs: Column) -> Column:
    """TL-7: ``prior + [assistant with tool_calls] + tool messages in call order``.

    ``prior`` is ``array<struct<role,content,tool_calls,tool_call_id>>``-compatible: every
    message gets the four fields (nulls where absent)."""
    def full(role, content, tcalls, tcid):
        return F.struct(role.alias("role"), content.alias("content"),
                        tcalls.alias("tool_calls"), tcid.alias("tool_call_id"))
    null_calls = F.lit(None).cast(f"array<{CALL_DDL}>")
    pre = F.transform(prior, lambda m: full(m["role"], m["content"], null_calls, F.lit(None).cast("string")))
    asst = F.array(full(F.lit("assistant"), assistant_content, calls, F.lit(None).cast("string")))
    tools = F.transform(tool_msgs, lambda m: full(m["role"], m["content"], null_calls, m["tool_call_id"]))
    return F.concat(pre, asst, tools)


def flatten_blocks(blocks) -> Column:
    """TL-8: content blocks -> text lines: a text block's text; a tool_use block's
    ``[Calling tool N with args A]`` line followed by the text of the response that came after
    that call. Lines joined by newline (null texts skipped; a null name or input reads ``None``)."""
    b = F.col(blocks) if isinstance(blocks, str) else blocks
    lines = F.transform(b, lambda x: F.when(
        x["type"] == "text", F.array(x["text"])).when(
        x["type"] == "tool_use",
        F.array(F.concat(F.lit("[Calling tool "), F.coalesce(x["name"], F.lit("None")), F.lit(" with args "),
                         F.coalesce(x["input"], F.lit("None")), F.lit("]")),
                x["follow_up"])).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.flatten(lines), "\n")
