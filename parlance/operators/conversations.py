"""Conversations and group chat (WIN-*, CH-*, JN-6).

Long-form tables are canonical: one row per message with an explicit order key. Running state
(segments, the end of a chat) is a prefix scan over sampled ranges (``plans.ranges``) so one very
long chat does not land in one task; lists are rebuilt with ``array_sort(collect_list(struct(pos, ...)))``
so the result never depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import py_strip
from parlance.plans.ranges import running
from parlance.sources.io import materialize

# ---- Fixed values ---------------------------------------------------------------------------
QUIT_WORD = "quit"
NEW_MARKER = "new"
DEFAULT_SYSTEM = "You are a helpful assistant."
FUNCTION_LINE = "\nCall Function: "
DEFAULT_USER_NAME = "user"
# ---------------------------------------------------------------------------------------------

MSG = "struct<role:string,content:string>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chat_segments(lines: DataFrame, user: str = "user_id", seq: str = "seq", query: str = "query",
                  mode: str = "prefix", partitions: int | None = None) -> DataFrame:
    """WIN-1: input lines of each user -> ``(user, seq, segment, new_topic, text)``.

    Each line is stripped; the first line whose lower case is ``quit`` ends the user's chat
    (it and everything after are dropped). A line starting with ``new`` resets the history:
    its segment number goes up by one and its text becomes ``line[4:]`` stripped. ``mode``
    ``prefix`` matches any line beginning ``new`` (``news`` too, like the reference); ``word``
    only ``new`` alone or followed by whitespace. Both running values come from one pass over sampled
    ranges of ``(user, seq)``, whatever numbers ``seq`` holds.
    """
    q = py_strip(query)
    if mode == "prefix":
        is_new = q.startswith(NEW_MARKER)
    elif mode == "word":
        is_new = (q == NEW_MARKER) | q.rlike(f"^{NEW_MARKER}\\s")
    else:
        raise ValueError(mode)
    base = lines.select(user, seq, q.alias("_q"),
                        F.when(F.lower(q) == QUIT_WORD, 1).otherwise(0).alias("_quit"),
                        F.when(is_new, 1).otherwise(0).alias("_new"))
    s = running(base, [user], [seq], {"_ended": ("_quit", "max"), "segment": ("_new", "sum")}, partitions).filter("_ended = 0")
    text = F.when(F.col("_new") == 1, py_strip(F.substring(F.col("_q"), 5, 1 << 30))).otherwise(F.col("_q"))
    return s.select(user, seq, F.col("segment").cast("long").alias("segment"),
                    (F.col("_new") == 1).alias("new_topic"), text.alias("text"))


#: Messages of a stored prefix block.
PREFIX_BLOCK = 64


def prefix_blocks(df: DataFrame, keys: list[str], order: str, role: str, content: str, block: int = PREFIX_BLOCK) -> DataFrame:
    """WIN-2, stored form: every message once. A row holds ``block`` consecutive messages of a chat:
    ``(keys, _b, msgs, rows)`` with the block's number, its messages and the input rows they came from.
    The history of the chat's row ``i`` is blocks ``0 .. i div block``, cut after ``i mod block`` more
    messages. Rows are numbered over sampled ranges, so a long chat is spread from the start."""
    msg = F.struct(_c(role).alias("role"), _c(content).alias("content"))
    d = df.select(*keys, F.col(order).alias("_o"), F.lit(1).cast("long").alias("_one"), msg.alias("_m"), F.struct(*df.columns).alias("_r"))
    n = running(d, keys, ["_o"], {"_n": ("_one", "sum")}).withColumn("_i", F.col("_n") - 1)
    per = n.groupBy(*keys, F.floor(F.col("_i") / block).cast("int").alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_m", "_r"))).alias("_l"))
    return materialize(per.select(*keys, "_b", F.col("_l._m").alias("msgs"), F.col("_l._r").alias("rows")), "prefix-blocks")


def expand_history(blocks: DataFrame, keys: list[str], system: str | None = DEFAULT_SYSTEM, block: int = PREFIX_BLOCK) -> DataFrame:
    """The input rows with ``messages``, from stored blocks. A block asks for the blocks before it, and its
    rows are cut from what comes back: a message travels once for every later block, not for every
    later row, and each block of a long chat is a group of its own."""
    b = blocks.select(*keys, "_b", "msgs").alias("b")
    asks = blocks.select(*keys, F.col("_b").alias("_for"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_b")).alias("a")
    on = F.col("a._b") == F.col("b._b")
    for c in [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]:
        on = on & c
    sent = asks.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a._for").alias("_b"),
                                   F.struct(F.col("a._b").alias("n"), F.col("b.msgs").alias("m")).alias("_s"))
    whole = sent.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list("_s")).alias("_s")).alias("w")
    own = blocks.select(*keys, "_b", "rows").alias("o")
    on = F.col("w._b") == F.col("o._b")
    for c in [F.col(f"w.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]:
        on = on & c
    out = whole.join(own, on).select(F.col("w._b").alias("_b"), F.flatten(F.col("w._s.m")).alias("_all"),
                                     F.posexplode("o.rows").alias("_p", "_r"))
    hist = F.slice("_all", 1, F.col("_b") * block + F.col("_p") + 1)
    if system is not None:
        hist = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), hist)
    return out.select("_r.*", hist.alias("messages"))


def prefix_history(df: DataFrame, keys: list[str], order: str, role: str, content: str,
                   system: str | None = DEFAULT_SYSTEM, block: int = PREFIX_BLOCK) -> DataFrame:
    """WIN-2: the message list sent at each row = the default system message, then every
    message of the same ``keys`` (e.g. user and segment) up to and including this row.

    The output of a chat of n turns holds n(n+1)/2 messages by definition; ``keys`` should
    include the segment so a reset really empties the history. Messages are stored once in blocks
    and the lists are only made at the end. ``(keys, order)`` should identify a row."""
    return expand_history(prefix_blocks(df, keys, order, role, content, block), keys, system, block)


def append_assistant(messages, content, text_only: bool = True) -> Column:
    """WIN-3: append ``{"role": "assistant", "content": ...}``; ``text_only`` strips the text."""
    c = py_strip(content) if text_only else _c(content)
    return F.array_append(_c(messages), F.struct(F.lit("assistant").alias("role"), c.alias("content")))


def append_response(messages, response: Column) -> Column:
    """WIN-3, whole responses: append ``{"role": "assistant", "content": <the response>}``. Contents are
    texts and objects side by side, so every content becomes a ``VARIANT`` (an object's fields in
    alphabetic order when printed)."""
    said = F.transform(_c(messages), lambda m: F.struct(m["role"].alias("role"), m["content"].cast("variant").alias("content")))
    return F.array_append(said, F.struct(F.lit("assistant").alias("role"), F.to_variant_object(response).alias("content")))


def first_prefix_match(pieces: DataFrame, piece_key: list[str], piece: str, agents: DataFrame,
                       name: str = "name", pos: str = "pos") -> DataFrame:
    """JN-6: for each piece, the first agent (lowest ``pos``) whose name the piece starts with.

    The ``startswith`` theta join is rewritten as an exact equi-join: each piece is cut to
    every distinct agent-name length and the cuts are joined to the names. The set of
    lengths is bounded by the longest agent name (not by the data), so it is read once as a
    short list. No nested loop and no pair of (piece, agent) that cannot match is formed.
    Returns ``piece_key + [name, pos]`` for matched pieces only.
    """
    a = agents.groupBy(name).agg(F.min(pos).alias(pos))
    lengths = sorted(r[0] for r in a.select(F.length(name).alias("n")).distinct().collect() if r[0])
    if not lengths:
        return pieces.select(*piece_key, F.lit(None).cast("string").alias(name),
                             F.lit(None).cast("long").alias(pos)).limit(0)
    cuts = pieces.select(*piece_key, F.explode(F.array(*[
        F.when(F.length(piece) >= n, F.substring(piece, 1, n)) for n in lengths])).alias("_cut"))
    hits = cuts.filter(F.col("_cut").isNotNull()).join(a.withColumnRenamed(name, "_cut"), "_cut")
    return hits.groupBy(*piece_key).agg(F.min_by("_cut", pos).alias(name), F.min(pos).alias(pos))


def mentions(messages: DataFrame, key: list[str], content: str, agents: DataFrame,
             name: str = "name", pos: str = "pos") -> DataFrame:
    """CH-1: agents mentioned in a message. Only a content with ``@`` is looked at; it is split
    on ``@`` and **every** piece (also the one before the first ``@``) is matched by JN-6;
    names are kept in first-occurrence order without duplicates. Every message gets a row
    (``mentions`` may be empty)."""
    m = messages.select(*key, content)
    pieces = m.filter(F.col(content).contains("@")).select(
        *key, F.posexplode(F.split(content, "@", -1)).alias("_pp", "_piece"))
    hit = first_prefix_match(pieces, [*key, "_pp"], "_piece", agents, name, pos)
    first = hit.groupBy(*key, name).agg(F.min("_pp").alias("_first"))
    per = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_first", name))).alias("_m"))
    out = m.join(per, key, "left").select(
        *key, F.coalesce(F.transform("_m", lambda s: s[name]), F.array().cast("array<string>")).alias("mentions"))
    return out


def render_history(name, parts, function_call) -> tuple[Column, Column]:
    """CH-2: ``(line, side)``: parts' texts joined by newline (null text = empty), stripped;
    ``name: content`` plus ``\\nCall Function: ...`` when there is a call; ``left`` for the
    user, ``right`` for everybody else."""
    text = py_strip(F.array_join(F.transform(_c(parts), lambda p: F.coalesce(p["text"], F.lit(""))), "\n"))
    fc = _c(function_call)
    line = F.concat(_c(name), F.lit(": "), text,
                    F.when(fc.isNotNull() & (fc != ""), F.concat(F.lit(FUNCTION_LINE), fc)).otherwise(F.lit("")))
    side = F.when(_c(name) == DEFAULT_USER_NAME, F.lit("left")).otherwise(F.lit("right"))
    return line, side


def config_upsert(events: DataFrame, group: str, seq: str, kind: str, agent_name: str,
                  payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """CH-3: apply config events in ``seq`` order per ``group``.

    ``role_config`` events replace the agent of the same name in place or append it; the
    agent's position is where its name first appeared, its fields are the latest event's.
    ``background`` events: the last one wins. Returns ``(agents, backgrounds)``:
    ``agents(group, pos, name, *payload)`` with ``pos`` 0-based, ``backgrounds(group, background)``.
    Only aggregations (partial first); the position rank runs over the few agents of a group.
    """
    roles = events.filter(F.col(kind) == "role_config")
    latest = roles.groupBy(group, agent_name).agg(
        F.min(seq).alias("_first"),
        F.max_by(F.struct(*payload), seq).alias("_p"))
    w = Window.partitionBy(group).orderBy("_first", agent_name)
    agents = latest.select(group, (F.row_number().over(w) - 1).cast("int").alias("pos"),
                           F.col(agent_name).alias("name"), *[F.col(f"_p.{p}").alias(p) for p in payload])
    bg = (events.filter(F.col(kind) == "background").groupBy(group)
          .agg(F.max_by(payload[0], seq).alias("background")))
    return agents, bg


def human_name(agents: DataFrame, group: str, name: str = "name", pos: str = "pos",
               flag: str = "is_human") -> DataFrame:
    """CH-4: per group, the first human agent's name, else ``user``."""
    h = agents.groupBy(group).agg(
        F.min_by(F.when(F.coalesce(F.col(flag), F.lit(False)), F.col(name)),
                 F.when(F.coalesce(F.col(flag), F.lit(False)), F.col(pos))).alias("_h"))
    return h.select(group, F.coalesce("_h", F.lit(DEFAULT_USER_NAME)).alias("human_name"))


def user_message_parts(msgs: DataFrame, session: str, seq: str, text: str, file: str) -> DataFrame:
    """CH-5: a user message's content = a text part, plus a file part only the first time that
    file is sent in the session. The first time is found by an aggregate + equi-join (no
    window over the session, so a long session is not one task)."""
    first = (msgs.filter(F.col(file).isNotNull()).groupBy(session, file)
             .agg(F.min(seq).alias("_first_seq")))
    j = msgs.join(first, [session, file], "left")
    send_file = F.col(file).isNotNull() & (F.col(seq) == F.col("_first_seq"))
    text_part = F.struct(F.col(text).alias("text"), F.lit(None).cast("string").alias("file"))
    file_part = F.struct(F.lit(None).cast("string").alias("text"), F.col(file).alias("file"))
    parts = F.when(send_file, F.array(text_part, file_part)).otherwise(F.array(text_part))
    return j.withColumn("content", parts).drop("_first_seq")
