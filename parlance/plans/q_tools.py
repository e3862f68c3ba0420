"""Registered queries: tool catalogs, calls, routing, evaluation and tool turns (TL-*, JN-3,
JN-4). Calls are shaped from ``events`` by ``inputs.tool_calls``."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from parlance.operators import tools as TL
from parlance.plans import inputs
from parlance.plans.registry import query
from parlance.plans.sqltext import lit

_EV = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in inputs.EVENT_TOOL.items())

CALLS_SQL = f"""ev AS (SELECT *, json_extract_string(props, '$.k') AS kt, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    '{{"location": "City ' || user_id || '"' AS loc FROM events),
ea AS (SELECT *, CASE event_type
    WHEN 'purchase' THEN '{{"a": ' || kt || ', "b": ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '}}'
    WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN loc || '}}' ELSE loc || ', "unit": "' || CASE WHEN k % 2 = 0 THEN 'celsius' ELSE 'fahrenheit' END || '"}}' END
    WHEN 'click' THEN loc || '}}'
    WHEN 'signup' THEN '{{"prompt": "a ' || event_type || ' scene #' || kt || ' ~ sky/sea * 100% ü"}}'
    ELSE '{{"query": "event ' || event_id || '"}}' END AS a FROM ev),
calls AS (SELECT event_id // 4 AS message_id, CAST(event_id % 4 AS INTEGER) AS pos, 'call_' || event_id AS call_id,
    'function' AS type, CASE event_type {_EV} END AS name,
    CASE WHEN k % 10 = 7 THEN substr(a, 1, length(a) - 1) ELSE a END AS arguments, user_id FROM ea)"""


def _catalog_sql(unique: bool = True) -> str:
    seen, rows = set(), []
    servers = list(dict.fromkeys(t.server for t in TL.BUILTIN.tools))
    for t in TL.BUILTIN.tools:
        if unique and t.name in seen:
            continue
        seen.add(t.name)
        rows.append(f"({lit(t.name)}, {lit(t.server)}, {servers.index(t.server)}, {lit(t.description)}, {lit(t.parameters)})")
    return f"cat AS (SELECT * FROM (VALUES {', '.join(rows)}) v(name, server, server_pos, description, parameters))"


_ARG = "json_extract_string(arguments, '$.{}')"
DISPATCH_SQL = f"""disp AS (SELECT *, CASE WHEN name NOT IN (SELECT name FROM cat) THEN 'unknown_tool'
    WHEN NOT json_valid(arguments) THEN 'bad_arguments' ELSE 'ok' END AS status FROM calls),
res AS (SELECT *, CASE WHEN status = 'ok' THEN CASE name
    WHEN 'add' THEN CAST(CAST(json_extract(arguments, '$.a') AS BIGINT) + CAST(json_extract(arguments, '$.b') AS BIGINT) AS VARCHAR)
    WHEN 'get_current_temperature' THEN CAST(to_json({{'location': {_ARG.format('location')}, 'unit': coalesce({_ARG.format('unit')}, 'celsius'), 'temperature': 22.0::DOUBLE}}) AS VARCHAR)
    WHEN 'get_current_wind_speed' THEN CAST(to_json({{'location': {_ARG.format('location')}, 'wind_speed': 15.0::DOUBLE}}) AS VARCHAR)
    WHEN 'my_image_gen' THEN CAST(to_json({{'image_url': {lit(TL.IMAGE_URL_BASE)} || replace(url_encode({_ARG.format('prompt')}), '%2F', '/')}}) AS VARCHAR)
    END END AS result FROM disp)"""

TOOL_CTES = f"{CALLS_SQL},\n{_catalog_sql()},\n{DISPATCH_SQL}"


def _dispatched(spark, sf):
    return TL.dispatch_tools(inputs.tool_calls(spark, sf))


# ---- catalog shapes ------------------------------------------------------------------------
_USED = "used AS (SELECT DISTINCT c.message_id, c.name, t.description, t.parameters FROM calls c JOIN cat t USING (name))"


@query("catalog_function_shape", f"""WITH {CALLS_SQL}, {_catalog_sql()}, {_USED}
SELECT message_id, CAST(count(*) AS BIGINT) AS n_tools, CAST(to_json(list({{'type': 'function', 'function': {{'name': name,
  'description': description, 'parameters': json(parameters)}}}} ORDER BY name)) AS VARCHAR) AS tools FROM used GROUP BY message_id""")
def q_catalog_function_shape(spark, sf):
    """TL-1: per assistant message, the function-call definitions of the tools it may use."""
    return TL.tools_per_request(inputs.tool_calls(spark, sf), TL.BUILTIN.catalog(spark), "message_id", "function")


@query("catalog_block_shape", f"""WITH {CALLS_SQL}, {_catalog_sql()}, {_USED}
SELECT message_id, CAST(count(*) AS BIGINT) AS n_tools, CAST(to_json(list({{'name': name, 'description': description,
  'input_schema': json(parameters)}} ORDER BY name)) AS VARCHAR) AS tools FROM used GROUP BY message_id""")
def q_catalog_block_shape(spark, sf):
    """TL-2: the same tools in the ``{name, description, input_schema}`` block shape."""
    return TL.tools_per_request(inputs.tool_calls(spark, sf), TL.BUILTIN.catalog(spark), "message_id", "block")


# ---- calls -----------------------------------------------------------------------------------
def _messages(spark, sf):
    """Assistant messages with their ``tool_calls`` array in order; every 7th message has a
    null list and the next one an empty list."""
    c = inputs.tool_calls(spark, sf)
    m = (c.groupBy("message_id")
         .agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("call_id").alias("id"), "type", "name",
                                                                  "arguments").alias("c")))).alias("_c")))
    calls = F.transform("_c", lambda s: s["c"])
    r = F.pmod("message_id", F.lit(7))
    return m.select("message_id", F.when(r == 0, F.lit(None).cast(f"array<{TL.CALL_DDL}>"))
                    .when(r == 1, F.array().cast(f"array<{TL.CALL_DDL}>")).otherwise(calls).alias("tool_calls"))


_MSGS_SQL = """msgs AS (SELECT message_id, CASE WHEN message_id % 7 = 0 THEN NULL WHEN message_id % 7 = 1 THEN []
    ELSE list({'id': call_id, 'type': type, 'name': name, 'arguments': arguments} ORDER BY pos) END AS tool_calls
  FROM calls GROUP BY message_id)"""


@query("explode_tool_calls", f"""WITH {CALLS_SQL}, {_MSGS_SQL},
ex AS (SELECT message_id, tool_calls, unnest(CASE WHEN coalesce(len(tool_calls), 0) = 0 THEN [NULL]
    ELSE range(len(tool_calls)) END) AS p FROM msgs)
SELECT message_id, CAST(p AS INTEGER) AS pos, tool_calls[p + 1].id AS call_id, tool_calls[p + 1].name AS name,
  tool_calls[p + 1].arguments AS arguments FROM ex""")
def q_explode_tool_calls(spark, sf):
    """TL-3: each call of each assistant message in order; null or empty lists keep one row."""
    return TL.explode_tool_calls(_messages(spark, sf), "message_id")


_HERMES_TEXT = ("'Checking.' || string_agg(chr(10) || '<tool_call>' || chr(10) || '{\"name\": \"' || name || "
                "'\", \"arguments\": ' || arguments || '}' || chr(10) || '</tool_call>', '' ORDER BY pos)")


def _hermes_text(spark, sf):
    c = inputs.tool_calls(spark, sf)
    block = F.concat(F.lit("\n<tool_call>\n{\"name\": \""), "name", F.lit("\", \"arguments\": "), "arguments",
                     F.lit("}\n</tool_call>"))
    per = c.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("_b"))
    return per.select("message_id", F.concat(F.lit("Checking."),
                                             F.array_join(F.transform("_b", lambda s: s["b"]), "")).alias("text"))


@query("extract_hermes_calls", f"""WITH {CALLS_SQL}, t AS (SELECT message_id, {_HERMES_TEXT} AS text FROM calls GROUP BY message_id),
b AS (SELECT message_id, unnest(range(len(bl))) AS p, unnest(bl) AS blk FROM
  (SELECT message_id, regexp_extract_all(text, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', 1) AS bl FROM t))
SELECT message_id, CAST(p AS INTEGER) AS pos, CASE WHEN json_valid(blk) THEN json_extract_string(blk, '$.name') END AS name,
  CASE WHEN json_valid(blk) THEN CAST(json_extract(blk, '$.arguments') AS VARCHAR) END AS arguments, json_valid(blk) AS valid FROM b""")
def q_extract_hermes_calls(spark, sf):
    """TL-4: ``<tool_call>{json}</tool_call>`` blocks in generated text -> calls."""
    return TL.extract_hermes_calls(_hermes_text(spark, sf), "message_id", "text")


@query("parse_tool_args", f"""WITH {CALLS_SQL} SELECT call_id, name, CASE WHEN json_valid(arguments) THEN 'ok' ELSE 'bad_arguments' END AS status,
  CASE WHEN json_valid(arguments) THEN CAST(len(json_keys(arguments)) AS INTEGER) END AS n_keys FROM calls""")
def q_parse_tool_args(spark, sf):
    """TL-5: JSON arguments parsed; malformed text is ``bad_arguments`` instead of an error."""
    c = inputs.tool_calls(spark, sf)
    v = TL.parse_tool_args("arguments")
    return c.select("call_id", "name", F.when(v.isNull(), "bad_arguments").otherwise("ok").alias("status"),
                    F.when(v.isNotNull(), F.size(F.json_object_keys("arguments"))).alias("n_keys"))


@query("route_tool_calls", f"""WITH {CALLS_SQL}, {_catalog_sql()}
SELECT c.call_id, c.name, t.server, CASE WHEN t.server IS NULL THEN 'unknown_tool' ELSE 'routed' END AS route_status
FROM calls c LEFT JOIN cat t USING (name)""")
def q_route_tool_calls(spark, sf):
    """JN-4: each call's tool found by name in the broadcast catalog; no match = unknown."""
    r = TL.route_tool_calls(inputs.tool_calls(spark, sf), TL.BUILTIN.catalog(spark))
    return r.select("call_id", "name", "server", "route_status")


@query("dispatch_tools", f"WITH {TOOL_CTES} SELECT call_id, name, status, result FROM res")
def q_dispatch_tools(spark, sf):
    """TL-6: every call evaluated by its registered Column expression (one CASE chain)."""
    return _dispatched(spark, sf).select("call_id", "name", "status", "result")


@query("image_url_json", f"WITH {TOOL_CTES} SELECT call_id, result AS image_url_json FROM res "
       f"WHERE name = 'my_image_gen' AND status = 'ok'")
def q_image_url_json(spark, sf):
    """TL-9: image tool results: base URL + percent-encoded prompt, as JSON."""
    d = _dispatched(spark, sf).filter((F.col("name") == "my_image_gen") & (F.col("status") == "ok"))
    return d.select("call_id", F.col("result").alias("image_url_json"))


_ATTACH_SQL = f"""WITH {TOOL_CTES},
j AS (SELECT message_id, pos, call_id, CASE WHEN status = 'ok' THEN result END AS content FROM res)
SELECT message_id, CAST(count(*) AS BIGINT) AS n_calls, CAST(count(content) AS BIGINT) AS n_results,
  CAST(to_json(list({{'role': 'tool', 'content': content, 'tool_call_id': call_id}} ORDER BY pos)) AS VARCHAR) AS tool_messages
FROM j GROUP BY message_id"""


def _attached(spark, sf):
    d = _dispatched(spark, sf)
    calls = d.select("message_id", "pos", "call_id", "type", "name", "arguments")
    return TL.attach_tool_results(calls, TL.tool_messages(d), "message_id")


@query("attach_tool_results", _ATTACH_SQL)
def q_attach_tool_results(spark, sf):
    """JN-3: tool reply messages joined to their calls by ``tool_call_id``, in call order;
    calls without a reply (unknown tool, bad arguments) keep a null content."""
    a = _attached(spark, sf)
    return a.select("message_id", "n_calls", "n_results",
                    F.to_json("tool_messages", {"ignoreNullFields": "false"}).alias("tool_messages"))


@query("tool_turn_messages", f"""WITH {TOOL_CTES},
m AS (SELECT message_id, list({{'id': call_id, 'type': type, 'name': name, 'arguments': arguments}} ORDER BY pos) AS tc,
  list({{'role': 'tool', 'content': CASE WHEN status = 'ok' THEN result END, 'tool_calls': NULL::STRUCT(id VARCHAR, type VARCHAR, name VARCHAR, arguments VARCHAR)[], 'tool_call_id': call_id}} ORDER BY pos) AS tm,
  min(user_id) AS uid FROM res GROUP BY message_id)
SELECT message_id, CAST(3 + len(tm) AS INTEGER) AS n_messages, CAST(to_json(list_concat(
  [{{'role': 'system', 'content': {lit(TL.DEFAULT_SYSTEM_TOOL_CHAT)}, 'tool_calls': NULL::STRUCT(id VARCHAR, type VARCHAR, name VARCHAR, arguments VARCHAR)[], 'tool_call_id': NULL::VARCHAR}},
   {{'role': 'user', 'content': 'What happened for user ' || uid || '?', 'tool_calls': NULL::STRUCT(id VARCHAR, type VARCHAR, name VARCHAR, arguments VARCHAR)[], 'tool_call_id': NULL::VARCHAR}},
   {{'role': 'assistant', 'content': NULL::VARCHAR, 'tool_calls': tc, 'tool_call_id': NULL::VARCHAR}}], tm)) AS VARCHAR) AS messages FROM m""")
def q_tool_turn_messages(spark, sf):
    """TL-7: the default system message, the user question, the assistant message carrying its
    calls, then one tool message per call in call order (one round)."""
    d = _dispatched(spark, sf)
    call = F.struct(F.col("call_id").alias("id"), "type", "name", "arguments")
    att = TL.attach_tool_results(d.select("message_id", "pos", "call_id", "type", "name", "arguments", "user_id"), TL.tool_messages(d),
                                 "message_id", call=call, carry=[F.min("user_id").alias("uid")])
    prior = TL.opening_messages(F.concat(F.lit("What happened for user "), F.col("uid").cast("string"), F.lit("?")))
    msgs = TL.tool_turn_messages(prior, F.lit(None).cast("string"), F.col("calls"), F.col("tool_messages"))
    return att.select("message_id", F.size(msgs).alias("n_messages"),
                      F.to_json(msgs, {"ignoreNullFields": "false"}).alias("messages"))


@query("flatten_blocks", f"""WITH {TOOL_CTES}
SELECT message_id, 'Let me look that up.' || chr(10) || string_agg('[Calling tool ' || name || ' with args ' || arguments || ']' || chr(10)
  || 'Result: ' || coalesce(result, 'none'), chr(10) ORDER BY pos) AS text FROM res GROUP BY message_id""")
def q_flatten_blocks(spark, sf):
    """TL-8: a text block, then per tool_use block its ``[Calling tool ...]`` line and the text of
    the response that followed, joined by newlines."""
    d = _dispatched(spark, sf)
    blk = F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), "name",
                   F.col("arguments").alias("input"),
                   F.concat(F.lit("Result: "), F.coalesce("result", F.lit("none"))).alias("follow_up"))
    per = d.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("pos", blk.alias("b")))).alias("_b"))
    first = F.struct(F.lit("text").alias("type"), F.lit("Let me look that up.").alias("text"),
                     F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("input"),
                     F.lit(None).cast("string").alias("follow_up"))
    blocks = F.concat(F.array(first), F.transform("_b", lambda s: s["b"]))
    return per.select("message_id", TL.flatten_blocks(blocks).alias("text"))


def extended_registry() -> TL.ToolRegistry:
    """UDF-1: a user registry = the built-in tools plus ``search_web`` registered by decorator."""
    reg = TL.ToolRegistry()
    for t in TL.BUILTIN.tools:
        reg.register(t.name, t.description, json.loads(t.parameters), t.server)(t.build)

    @reg.register("search_web", "Search the web for a query.",
                  {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]},
                  server="user")
    def _search(args):
        return F.concat(F.lit("Results for: "), F.try_variant_get(args, "$.query", "string"))
    return reg


_EXT_SQL = (DISPATCH_SQL.replace("CASE WHEN name NOT IN (SELECT name FROM cat) THEN 'unknown_tool'\n    WHEN",
                                 "CASE WHEN")
            .replace("    END END AS result", "    WHEN 'search_web' THEN 'Results for: ' || json_extract_string(arguments, '$.query')\n    END END AS result"))


@query("register_tool", f"WITH {CALLS_SQL},\n{_catalog_sql()},\n{_EXT_SQL} SELECT call_id, name, status, result FROM res")
def q_register_tool(spark, sf):
    """UDF-1: a tool registered at run time (``search_web``) is dispatched like the built-in
    ones - the calls that were ``unknown_tool`` now evaluate."""
    d = TL.dispatch_tools(inputs.tool_calls(spark, sf), extended_registry())
    return d.select("call_id", "name", "status", "result")
