"""Registered queries: chat segments, history, mentions, group config and weather reports
(WIN-*, CH-*, JN-5, JN-6, GEO-*, ORD-4).

Stand-in inputs are shaped here from ``conversations``, ``customer`` and ``events``; every
operator's work is in ``parlance.operators``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import conversations as CV, reports as R, templates as T
from parlance.plans import inputs
from parlance.plans.registry import query
from parlance.plans.sqltext import lit, strip

# ---- stand-in inputs --------------------------------------------------------------------------


def chat_lines(spark, sf) -> DataFrame:
    """Input lines ``(user_id, seq, query)``: the user turns of each conversation, some wrapped
    as ``new`` / ``news`` markers with padding, and a ``QUIT`` line in every fifth chat."""
    c = inputs.conversations(spark, sf).filter(F.col("role") == "user")
    m = F.pmod("turn", F.lit(7))
    q = (F.when(m == 0, F.concat(F.lit("  new "), "text"))
         .when(m == 1, F.concat(F.lit("news "), "text"))
         .when((m == 2) & (F.pmod("conv_id", F.lit(5)) == 0), F.lit("QUIT"))
         .otherwise(F.col("text")))
    return c.select(F.col("conv_id").alias("user_id"), F.col("turn").alias("seq"), q.alias("query"))


_LINES_SQL = """lines AS (SELECT conv_id AS user_id, turn AS seq, CASE WHEN turn % 7 = 0 THEN '  new ' || text
    WHEN turn % 7 = 1 THEN 'news ' || text WHEN turn % 7 = 2 AND conv_id % 5 = 0 THEN 'QUIT' ELSE text END AS query
  FROM conversations WHERE role = 'user')"""


def _agent_name(x):
    return F.concat(F.lit("Customer#"), F.lpad(x.cast("string"), 9, "0"))


def mention_texts(spark, sf) -> DataFrame:
    """Messages ``(conv_id, turn, content)`` with ``@`` mentions of customer-named agents:
    none, one, two with a repeat, or a leading name plus an unknown ``@Nobody``."""
    c = inputs.conversations(spark, sf)
    n = inputs.group_agents(spark, sf).agg(F.count(F.lit(1))).scalar()
    a = _agent_name(F.pmod(F.col("conv_id") * 7 + F.col("turn"), n))
    b = _agent_name(F.pmod(F.col("conv_id") * 13 + F.col("turn") * 3, n))
    m = F.pmod("turn", F.lit(4))
    content = (F.when(m == 0, F.col("text"))
               .when(m == 1, F.concat(F.lit("@"), a, F.lit(" "), "text"))
               .when(m == 2, F.concat(F.lit("Hi @"), a, F.lit(" and @"), b, F.lit(", "), "text", F.lit(" @"), a))
               .otherwise(F.concat(b, F.lit(" says @Nobody "), "text")))
    return c.select("conv_id", "turn", content.alias("content"))


def _name_sql(x: str) -> str:
    return f"'Customer#' || lpad(CAST({x} AS VARCHAR), 9, '0')"


_MT_SQL = f"""mt AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text
    WHEN 1 THEN '@' || {_name_sql('(conv_id * 7 + turn) % (SELECT count(*) FROM customer)')} || ' ' || text
    WHEN 2 THEN 'Hi @' || {_name_sql('(conv_id * 7 + turn) % (SELECT count(*) FROM customer)')} || ' and @' || {_name_sql('(conv_id * 13 + turn * 3) % (SELECT count(*) FROM customer)')} || ', ' || text || ' @' || {_name_sql('(conv_id * 7 + turn) % (SELECT count(*) FROM customer)')}
    ELSE {_name_sql('(conv_id * 13 + turn * 3) % (SELECT count(*) FROM customer)')} || ' says @Nobody ' || text END AS content FROM conversations),
agents AS (SELECT c_custkey AS pos, c_name AS name FROM customer),
pieces AS (SELECT conv_id, turn, unnest(range(len(string_split(content, '@')))) AS pp, unnest(string_split(content, '@')) AS piece
  FROM mt WHERE contains(content, '@')),
hit AS (SELECT conv_id, turn, pp, arg_min(a.name, a.pos) AS name, min(a.pos) AS pos FROM pieces p JOIN agents a ON starts_with(p.piece, a.name)
  GROUP BY conv_id, turn, pp)"""


# ---- WIN -------------------------------------------------------------------------------------
@query("chat_segments", f"""WITH {_LINES_SQL},
s AS (SELECT *, {strip('query')} AS q FROM lines),
f AS (SELECT *, CASE WHEN lower(q) = 'quit' THEN 1 ELSE 0 END AS is_quit, CASE WHEN starts_with(q, 'new') THEN 1 ELSE 0 END AS is_new FROM s),
e AS (SELECT *, max(is_quit) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM f)
SELECT user_id, seq, CAST(sum(is_new) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment,
  is_new = 1 AS new_topic, CASE WHEN is_new = 1 THEN {strip('substr(q, 5)')} ELSE q END AS text FROM e WHERE ended = 0""")
def q_chat_segments(spark, sf):
    """WIN-1: stripped input lines; ``quit`` ends a chat, ``new...`` starts a new segment."""
    return CV.chat_segments(chat_lines(spark, sf))


@query("prefix_history", f"""SELECT conv_id, turn, CAST(count(*) OVER w + 1 AS INTEGER) AS n_messages,
  CAST(to_json(list_concat([{{'role': 'system', 'content': {lit(CV.DEFAULT_SYSTEM)}}}], list({{'role': role, 'content': text}}) OVER w)) AS VARCHAR) AS messages
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_prefix_history(spark, sf):
    """WIN-2: at every turn, the default system message and all messages so far."""
    h = CV.prefix_history(inputs.conversations(spark, sf), ["conv_id"], "turn", "role", "text")
    return h.select("conv_id", "turn", F.size("messages").alias("n_messages"), F.to_json("messages").alias("messages"))


@query("append_assistant", f"""WITH pairs AS (SELECT conv_id, turn, text AS instruction, nxt AS output FROM (
    SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
           lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE role = 'user' AND nrole = 'assistant')
SELECT conv_id, turn, CAST(to_json([{{'role': 'system', 'content': {lit(CV.DEFAULT_SYSTEM)}}}, {{'role': 'user', 'content': instruction}},
  {{'role': 'assistant', 'content': {strip("(chr(10) || output || '  ')")}}}]) AS VARCHAR) AS messages FROM pairs""")
def q_append_assistant(spark, sf):
    """WIN-3: the reply appended to the row's own conversation as an assistant message
    (text only: stripped). Stand-in reply: the gold output with padding."""
    r = inputs.sft_records(spark, sf)
    msgs = T.system_user_messages("instruction", CV.DEFAULT_SYSTEM)
    reply = F.concat(F.lit("\n"), "output", F.lit("  "))
    return r.select("conv_id", "turn", F.to_json(CV.append_assistant(msgs, reply, text_only=True)).alias("messages"))


@query("append_response", f"""WITH pairs AS (SELECT conv_id, turn, text AS instruction, nxt AS output FROM (
    SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
           lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE role = 'user' AND nrole = 'assistant')
SELECT conv_id, turn, '[' || CAST(to_json({{'role': 'system', 'content': {lit(CV.DEFAULT_SYSTEM)}}}) AS VARCHAR) || ',' ||
  CAST(to_json({{'role': 'user', 'content': instruction}}) AS VARCHAR) || ',' || CAST(to_json({{'role': 'assistant', 'content':
  {{'content': output, 'finish_reason': 'stop', 'tool_calls': NULL::VARCHAR, 'usage': {{'completion_tokens': length(output), 'prompt_tokens': length(instruction)}}}}}}) AS VARCHAR)
  || ']' AS messages FROM pairs""")
def q_append_response(spark, sf):
    """WIN-3: the whole response object appended as the assistant message's content."""
    r = inputs.sft_records(spark, sf)
    usage = F.struct(F.length("output").alias("completion_tokens"), F.length("instruction").alias("prompt_tokens"))
    resp = F.struct(F.col("output").alias("content"), F.lit("stop").alias("finish_reason"),
                    F.lit(None).cast("string").alias("tool_calls"), usage.alias("usage"))
    msgs = CV.append_response(T.system_user_messages("instruction", CV.DEFAULT_SYSTEM), resp)
    return r.select("conv_id", "turn", F.to_json(msgs).alias("messages"))


# ---- JN-6 / CH -----------------------------------------------------------------------------------
@query("mention_match", f"WITH {_MT_SQL} SELECT conv_id, turn, CAST(pp AS INTEGER) AS piece_pos, name, pos FROM hit")
def q_mention_match(spark, sf):
    """JN-6: every ``@`` piece matched to the first agent whose name it starts with."""
    m = mention_texts(spark, sf).filter(F.col("content").contains("@"))
    pieces = m.select("conv_id", "turn", F.posexplode(F.split("content", "@", -1)).alias("piece_pos", "piece"))
    agents = inputs.group_agents(spark, sf).select("pos", "name")
    return CV.first_prefix_match(pieces, ["conv_id", "turn", "piece_pos"], "piece", agents)


@query("mentions", f"""WITH {_MT_SQL}, fo AS (SELECT conv_id, turn, name, min(pp) AS f FROM hit GROUP BY ALL),
per AS (SELECT conv_id, turn, list(name ORDER BY f) AS names FROM fo GROUP BY ALL)
SELECT m.conv_id, m.turn, CAST(coalesce(len(names), 0) AS INTEGER) AS n_mentions, coalesce(array_to_string(names, ','), '') AS mentions
FROM mt m LEFT JOIN per USING (conv_id, turn)""")
def q_mentions(spark, sf):
    """CH-1: mentioned agents per message, first-occurrence order, no duplicates."""
    agents = inputs.group_agents(spark, sf).select("pos", "name")
    out = CV.mentions(mention_texts(spark, sf), ["conv_id", "turn"], "content", agents)
    return out.select("conv_id", "turn", F.size("mentions").alias("n_mentions"),
                      F.array_join("mentions", ",").alias("mentions"))


def history_messages(spark, sf) -> DataFrame:
    """Group messages ``(conv_id, turn, name, parts, function_call)``: text lines as parts, a
    file-only part (null text) on every third turn, a function call on some replies."""
    c = inputs.conversations(spark, sf)
    parts = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("text"), F.lit(None).cast("string").alias("file")))
    file_part = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit("notes.pdf").alias("file")))
    parts = F.when(F.pmod("turn", F.lit(3)) == 0, F.concat(parts, file_part)).otherwise(parts)
    fc = F.when((F.col("role") == "assistant") & (F.pmod("turn", F.lit(4)) == 1),
                F.concat(F.lit('{"name": "add", "arguments": "{\\"a\\": '), F.col("turn").cast("string"), F.lit('}"}')))
    return c.select("conv_id", "turn", F.col("role").alias("name"), parts.alias("parts"), fc.alias("function_call"))


@query("render_history", f"""WITH m AS (SELECT conv_id, turn, role AS name, CASE WHEN turn % 3 = 0 THEN text || chr(10) ELSE text END AS joined,
  CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN '{{"name": "add", "arguments": "{{\\"a\\": ' || turn || '}}"}}' END AS fc FROM conversations)
SELECT conv_id, turn, name || ': ' || {strip('joined')} || CASE WHEN fc IS NOT NULL AND fc != '' THEN chr(10) || 'Call Function: ' || fc ELSE '' END AS line,
  CASE WHEN name = 'user' THEN 'left' ELSE 'right' END AS side FROM m""")
def q_render_history(spark, sf):
    """CH-2: display lines ``name: content`` (+ function call), user left, others right."""
    m = history_messages(spark, sf)
    line, side = CV.render_history(F.col("name"), F.col("parts"), F.col("function_call"))
    return m.select("conv_id", "turn", line.alias("line"), side.alias("side"))


def config_events(spark, sf) -> DataFrame:
    """Config events per group (``user_id``) in ``event_id`` order: signups and clicks are
    ``role_config`` of agent ``agent_<k % 6>``, errors set the ``background``."""
    e = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = (F.when(F.col("event_type").isin("signup", "click"), "role_config")
            .when(F.col("event_type") == "error", "background").otherwise("other"))
    desc = F.when(kind == "background", F.concat(F.lit("background "), F.col("event_id").cast("string"))) \
        .otherwise(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")))
    return e.select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"),
                    F.concat(F.lit("agent_"), F.pmod(k, F.lit(6)).cast("string")).alias("agent"),
                    desc.alias("description"), F.concat(F.lit("Act on "), F.col("props")).alias("instructions"))


@query("config_upsert", """WITH e AS (SELECT user_id, event_id AS seq, CASE WHEN event_type IN ('signup', 'click') THEN 'role_config'
    WHEN event_type = 'error' THEN 'background' ELSE 'other' END AS kind,
  'agent_' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 6) AS agent,
  CASE WHEN event_type = 'error' THEN 'background ' || event_id ELSE event_type || ' ' || event_id END AS description,
  'Act on ' || props AS instructions FROM events),
l AS (SELECT user_id, agent, min(seq) AS f, arg_max(description, seq) AS description, arg_max(instructions, seq) AS instructions
  FROM e WHERE kind = 'role_config' GROUP BY ALL),
bg AS (SELECT user_id, arg_max(description, seq) AS background FROM e WHERE kind = 'background' GROUP BY ALL)
SELECT user_id, pos, name, description, instructions, background FROM (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY f, agent) - 1 AS INTEGER) AS pos, agent AS name,
    description, instructions FROM l) FULL JOIN bg USING (user_id)""")
def q_config_upsert(spark, sf):
    """CH-3: agents replaced in place or appended by config events; last background wins; a group
    that has only a background keeps it (agent fields null)."""
    agents, bg = CV.config_upsert(config_events(spark, sf), "user_id", "seq", "kind", "agent",
                                  ["description", "instructions"])
    return agents.join(bg, "user_id", "full_outer")


@query("human_name", """SELECT c_nationkey, c_mktsegment, coalesce(arg_min(c_name, c_custkey) FILTER (WHERE c_acctbal < -500), 'user') AS human_name
FROM customer GROUP BY ALL""")
def q_human_name(spark, sf):
    """CH-4: per group (nation and segment), the first human agent's name, else ``user``."""
    c = inputs.table(spark, sf, "customer")
    agents = c.select(F.struct("c_nationkey", "c_mktsegment").alias("g"), F.col("c_custkey").alias("pos"),
                      F.col("c_name").alias("name"), (F.col("c_acctbal") < -500).alias("is_human"))
    return CV.human_name(agents, "g").select("g.c_nationkey", "g.c_mktsegment", "human_name")


@query("user_message_parts", """WITH m AS (SELECT user_id, event_id, 'I did ' || event_type AS text,
  CASE WHEN event_type = 'purchase' THEN 'receipt_' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) || '.pdf' END AS file FROM events),
f AS (SELECT user_id, file, min(event_id) AS fs FROM m WHERE file IS NOT NULL GROUP BY ALL)
SELECT m.user_id, m.event_id, CAST(CASE WHEN m.event_id = f.fs THEN 2 ELSE 1 END AS INTEGER) AS n_parts,
  CAST(to_json(CASE WHEN m.event_id = f.fs THEN [{'text': text, 'file': NULL::VARCHAR}, {'text': NULL::VARCHAR, 'file': m.file}]
    ELSE [{'text': text, 'file': NULL::VARCHAR}] END) AS VARCHAR) AS content FROM m LEFT JOIN f USING (user_id, file)""")
def q_user_message_parts(spark, sf):
    """CH-5: a user message = its text part, plus the file part on that file's first upload."""
    e = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    m = e.select("user_id", "event_id", F.concat(F.lit("I did "), "event_type").alias("text"),
                 F.when(F.col("event_type") == "purchase",
                        F.concat(F.lit("receipt_"), F.pmod(k, F.lit(3)).cast("string"), F.lit(".pdf"))).alias("file"))
    out = CV.user_message_parts(m, "user_id", "event_id", "text", "file")
    return out.select("user_id", "event_id", F.size("content").alias("n_parts"),
                      F.to_json("content", {"ignoreNullFields": "false"}).alias("content"))


# ---- GEO / JN-5 / ORD-4 ------------------------------------------------------------------------
_ABSENT = "\u0000absent"


def alert_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Alert documents per state (= ``user_id``) and their features, a row each, from the state's
    events; no document for ``user_id % 10 = 0``, no features key for ``% 10 = 1``, an empty list for
    ``% 10 = 2``. ``description`` is absent when ``k % 4 = 0`` and null when ``k % 4 = 1``; ``instruction``
    absent when ``k % 3 = 0``."""
    e = inputs.table(spark, sf, "events").select(F.col("user_id").alias("state"), F.col("event_id").alias("seq"), "event_type",
                                                 F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    r, k = F.pmod("state", F.lit(10)), F.col("k")
    desc = (F.when(F.pmod(k, F.lit(4)) == 0, F.lit(_ABSENT)).when(F.pmod(k, F.lit(4)) == 1, F.lit(None))
            .otherwise(F.concat(F.lit("Value "), k.cast("string"))))
    inst = F.when(F.pmod(k, F.lit(3)) == 0, F.lit(_ABSENT)).otherwise(F.lit("Stay safe"))
    props = F.map_filter(F.create_map(
        F.lit("event"), F.col("event_type"), F.lit("areaDesc"), F.concat(F.lit("Zone "), k.cast("string")),
        F.lit("severity"), F.when(F.col("value") > 100, "Severe").otherwise("Minor"),
        F.lit("description"), desc, F.lit("instruction"), inst),
        lambda _k, v: F.coalesce(v != _ABSENT, F.lit(True)))
    documents = e.select("state").distinct().where(r != 0).select("state", (r != 1).alias("has_features"))
    return documents, e.where(~r.isin(0, 1, 2)).select("state", "seq", props.alias("properties"))


_ALERT_SQL = """ae AS (SELECT user_id AS state, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, value FROM events
  WHERE user_id % 10 != 0),
al AS (SELECT state, event_id, chr(10) || '        Event: ' || event_type || chr(10) || '        Area: Zone ' || k || chr(10)
  || '        Severity: ' || CASE WHEN value > 100 THEN 'Severe' ELSE 'Minor' END || chr(10)
  || '        Description: ' || CASE WHEN k % 4 = 0 THEN 'No description available' WHEN k % 4 = 1 THEN 'None' ELSE 'Value ' || k END || chr(10)
  || '        Instructions: ' || CASE WHEN k % 3 = 0 THEN 'No specific instructions provided' ELSE 'Stay safe' END || chr(10) || '        ' AS alert FROM ae)"""


@query("format_alerts", f"""WITH {_ALERT_SQL} SELECT state, CAST(row_number() OVER (PARTITION BY state ORDER BY event_id) - 1 AS INTEGER) AS pos, alert
FROM al WHERE state % 10 NOT IN (1, 2)""")
def q_format_alerts(spark, sf):
    """GEO-1: each alert feature as five lines; absent keys take defaults, nulls print None."""
    return R.numbered_alerts(alert_tables(spark, sf)[1])


@query("alert_report", f"""WITH {_ALERT_SQL}, st AS (SELECT DISTINCT user_id AS state FROM events),
rep AS (SELECT state, string_agg(alert, chr(10) || '---' || chr(10) ORDER BY event_id) AS body FROM al GROUP BY state)
SELECT s.state, CASE WHEN s.state % 10 IN (0, 1) THEN {lit(R.NO_ALERTS_DOCUMENT)} WHEN s.state % 10 = 2 THEN {lit(R.EMPTY_ALERTS)}
  ELSE body END AS report FROM st s LEFT JOIN rep USING (state)""")
def q_alert_report(spark, sf):
    """GEO-2: every state's report; missing document / features and empty lists -> sentinels."""
    states = inputs.table(spark, sf, "events").select(F.col("user_id").alias("state")).distinct()
    return R.alert_reports_long(states, *alert_tables(spark, sf))


def forecast_inputs(spark, sf):
    """Requests ``(latitude, longitude)`` per user; point rows except ``user_id % 7 = 0``; forecast
    periods, a row each (the user's events in time order), except ``% 11 = 0``."""
    e = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    lat, lon = (F.col("user_id") * 0.5).alias("latitude"), (-F.col("user_id") * 0.25).alias("longitude")
    users = e.select("user_id").distinct()
    grid = F.concat(F.lit("grid/"), F.col("user_id").cast("string")).alias("forecast")
    period = F.struct(F.concat(F.lit("Period "), F.col("event_id").cast("string")).alias("name"),
                      F.floor("value").cast("int").alias("temperature"), F.lit("F").alias("temperatureUnit"),
                      F.concat(k, F.lit(" mph")).alias("windSpeed"),
                      F.upper(F.substring("event_type", 1, 1)).alias("windDirection"),
                      F.concat("event_type", F.lit(" expected")).alias("detailedForecast"))
    periods = e.filter(F.pmod("user_id", F.lit(11)) != 0).select(grid, "ts", "event_id", period.alias("period"))
    return users.select(lat, lon), users.filter(F.pmod("user_id", F.lit(7)) != 0).select(lat, lon, grid), periods


_IN_TIME = ["ts", "event_id"]
_FC_SQL = """u AS (SELECT DISTINCT user_id FROM events),
req AS (SELECT user_id, CAST(user_id * 0.5 AS DOUBLE) AS latitude, CAST(-user_id * 0.25 AS DOUBLE) AS longitude FROM u),
per AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n,
  chr(10) || '    Period ' || event_id || ':' || chr(10) || '    Temperature: ' || CAST(floor(value) AS INTEGER) || '°F' || chr(10)
  || '    Wind: ' || json_extract_string(props, '$.k') || ' mph ' || upper(substr(event_type, 1, 1)) || chr(10)
  || '    Forecast: ' || event_type || ' expected' || chr(10) || '    ' AS txt, 'Period ' || event_id AS pname FROM events WHERE user_id % 11 != 0)"""


@query("point_forecast_lookup", f"""WITH {_FC_SQL}, np AS (SELECT user_id, max(n) AS n FROM per GROUP BY ALL)
SELECT r.latitude, r.longitude, CASE WHEN r.user_id % 7 != 0 THEN 'grid/' || r.user_id END AS forecast,
  CASE WHEN r.user_id % 7 = 0 THEN 'no_point' WHEN r.user_id % 11 = 0 THEN 'no_forecast' ELSE 'ok' END AS lookup_status,
  CAST(CASE WHEN r.user_id % 7 != 0 THEN np.n END AS INTEGER) AS n_periods FROM req r LEFT JOIN np USING (user_id)""")
def q_point_forecast_lookup(spark, sf):
    """JN-5: location -> grid point -> forecast document, by two left joins."""
    req, points, periods = forecast_inputs(spark, sf)
    j = R.point_forecast_counts(req, points, R.period_counts(periods))
    return j.select("latitude", "longitude", "forecast", "lookup_status", "n_periods")


@query("forecast_report", f"""WITH {_FC_SQL}, rep AS (SELECT user_id, string_agg(txt, chr(10) || '---' || chr(10) ORDER BY rn) AS body
  FROM per WHERE rn <= 5 GROUP BY ALL)
SELECT r.latitude, r.longitude, CASE WHEN r.user_id % 7 = 0 THEN {lit(R.NO_POINT)} WHEN r.user_id % 11 = 0 THEN {lit(R.NO_FORECAST)}
  ELSE body END AS report FROM req r LEFT JOIN rep USING (user_id)""")
def q_forecast_report(spark, sf):
    """GEO-3: the first five periods of each location's forecast, formatted and joined."""
    req, points, periods = forecast_inputs(spark, sf)
    j = R.point_forecast_counts(req, points, R.period_counts(periods))
    return R.forecast_reports(j, periods, _IN_TIME).select("latitude", "longitude", "report")


@query("top_k_periods", f"""WITH {_FC_SQL} SELECT 'grid/' || user_id AS forecast, CAST(max(n) AS INTEGER) AS n_periods,
  string_agg(pname, ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS first_periods FROM per GROUP BY user_id""")
def q_top_k_periods(spark, sf):
    """ORD-4: the first five periods of every forecast document, and how many it has."""
    _, _, periods = forecast_inputs(spark, sf)
    shown = R.shown_periods(periods, _IN_TIME, F.col("period.name"), ",", out="first_periods")
    return R.period_counts(periods).join(shown, "forecast")
