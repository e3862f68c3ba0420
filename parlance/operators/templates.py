"""Chat records and prompt templates (PRJ-*): projections without a UDF; only pairs need a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import py_strip
from parlance.plans.ranges import next_row

# ---- Fixed values (must equal the reference's strings) -----------------------------------
CHATML_SYSTEM = "<|im_start|>system\nYou are a helpful assistant<|im_end|>\n"
CHATML_USER = "<|im_start|>user\n{instruction}<|im_end|>\n<|im_start|>assistant\n"
CHATML_TURN = "<|im_start|>user\n{instruction}<|im_end|>\n<|im_start|>assistant\n{output}<|im_end|>\n"
CHATML_ASSISTANT_HEADER = "<|im_start|>assistant\n"
INST_SYSTEM = "<<SYS>>\nYou are a helpful assistant\n<</SYS>>\n\n"
INST_USER = "<s>[INST] {instruction} [/INST]"
DEFAULT_EOS = "</s>"
DEFAULT_SYSTEM_TOOL_CHAT = "You are a helpful assistant."
DEFAULT_SYSTEM_INFERENCE = "你是一个乐于助人的人工智能助手"
# Request defaults: n, top_k, max_tokens, repetition_penalty, temperature, stream.
REQUEST_DEFAULTS = {"n": 1, "top_k": 50, "max_tokens": 1500, "repetition_penalty": 1.05,
                    "temperature": 0.8, "stream": False}
# -------------------------------------------------------------------------------------------

MESSAGE_DDL = "struct<role:string,content:string>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fill(template: str, **cols: Column) -> Column:
    """Render ``template`` with ``{name}`` holes as one ``concat`` (literals folded by Catalyst)."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(cols[rest[i + 1:j]])
        rest = rest[j + 1:]
    return F.concat(*parts)


def message(role, content) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), _c(content).cast("string").alias("content"))


def user_messages(content) -> Column:
    """PRJ-2: ``[{"role": "user", "content": x}]``."""
    return F.array(message("user", content))


def system_user_messages(content, system=None) -> Column:
    """PRJ-3: optional system message (skipped when null), then the user message."""
    if system is None:
        return user_messages(content)
    sys_c = F.lit(system) if isinstance(system, str) else system
    return F.concat(F.when(sys_c.isNotNull(), F.array(message("system", sys_c)))
                    .otherwise(F.array().cast(f"array<{MESSAGE_DDL}>")),
                    user_messages(content))


def render_source(instruction, mode: str = "qwen2", add_generation_prompt: bool = True,
                  with_system: bool = True) -> Column:
    """PRJ-4 / PRJ-5 / PRJ-7: the prompt text of one instruction.

    ``qwen2``: ChatML system block + user block (+ assistant header when
    ``add_generation_prompt``). ``llama2``: ``<s>[INST] {instruction} [/INST]``, with the
    ``<<SYS>>`` block inside the instruction when ``with_system``.
    """
    ins = _c(instruction)
    if mode == "qwen2":
        user = CHATML_USER if add_generation_prompt else CHATML_USER[: -len(CHATML_ASSISTANT_HEADER)]
        body = _fill(user, instruction=ins)
        return F.concat(F.lit(CHATML_SYSTEM), body) if with_system else body
    if mode == "llama2":
        if with_system:
            ins = F.concat(F.lit(INST_SYSTEM), ins)
        return _fill(INST_USER, instruction=ins)
    raise ValueError(f"unknown format mode {mode!r}")


def render_target(output, mode: str = "qwen2", eos: str = DEFAULT_EOS) -> Column:
    """PRJ-6: ``output + eos`` (qwen2) or ``' ' + output + ' ' + eos`` (llama2)."""
    out = _c(output)
    if mode == "qwen2":
        return F.concat(out, F.lit(eos))
    if mode == "llama2":
        return F.concat(F.lit(" "), out, F.lit(" " + eos))
    raise ValueError(f"unknown format mode {mode!r}")


def render_turn(instruction, output) -> Column:
    """One block of the multi-turn ChatML template."""
    return _fill(CHATML_TURN, instruction=_c(instruction), output=_c(output))


def conversation_pairs(conversations: DataFrame, key: str = "conv_id", turn: str = "turn",
                       role: str = "role", text: str = "text") -> DataFrame:
    """PRJ-1: every user turn whose next existing turn is an assistant's -> (instruction, output).

    Turn numbers may have gaps. The next row is found over sampled ranges of ``(key, turn)`` with the
    first row of the next range carried over, so a long conversation is spread over tasks (a
    ``lead() OVER (PARTITION BY key)`` window would put it in one). Of rows with equal key and turn
    the order is that of role and text.
    """
    c = conversations.select(key, turn, role, text)
    n = next_row(c, [key], [turn], [role, text], tie=[role, text])
    pair = (F.col(role) == "user") & (F.col(f"_next.{role}") == "assistant")
    return n.filter(pair).select(key, turn, F.col(text).alias("instruction"), F.col(f"_next.{text}").alias("output"))


def chatml_multi_turn(pairs: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """PRJ-9: a conversation's pairs rendered with the multi-turn template, in turn order.

    One output row per conversation is the operator's result, so each conversation's
    blocks meet in one row; partial lists are merged map-side first.
    """
    blocks = pairs.select(key, F.struct(F.col(turn).alias("t"),
                                        render_turn("instruction", "output").alias("b")).alias("blk"))
    return (blocks.groupBy(key)
            .agg(F.array_sort(F.collect_list("blk")).alias("blks"),
                 F.count(F.lit(1)).alias("n_pairs"))
            .select(key, "n_pairs",
                    F.concat(F.lit(CHATML_SYSTEM),
                             F.array_join(F.transform("blks", lambda x: x["b"]), "")).alias("text")))


def preference_triples(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen",
                       rejected: str = "rejected") -> DataFrame:
    """PRJ-8: prompt/chosen/rejected -> one-message arrays; every other column is dropped."""
    return df.select(user_messages(prompt).alias("prompt"),
                     F.array(message("assistant", chosen)).alias("chosen"),
                     F.array(message("assistant", rejected)).alias("rejected"))


def result_projection(df: DataFrame, generator: str, idx="idx", inp="input",
                      original_events="original_events", output="output",
                      model_output="model_output") -> DataFrame:
    """PRJ-10: the inference output row; ``model_output`` stripped like ``str.strip()``."""
    return df.select(F.col(idx).cast("long").alias("idx"), F.lit(generator).alias("generator"),
                     F.col(inp).alias("input"), F.col(original_events).alias("original_events"),
                     F.col(output).alias("output"), py_strip(model_output).alias("model_output"))


def request_params(df: DataFrame, messages: str = "messages", overrides: dict | None = None,
                   model: str | None = None) -> DataFrame:
    """PRJ-12: request row = messages + sampling parameters, per-row override or default.

    ``overrides`` maps a parameter name to a column name holding per-row overrides (null =
    use the default). Adds the parameter columns and the JSON ``body`` of the request.
    """
    overrides = overrides or {}
    cols = {}
    for name, default in REQUEST_DEFAULTS.items():
        lit = F.lit(default).cast(_TYPES[name])
        cols[name] = F.coalesce(F.col(overrides[name]).cast(_TYPES[name]), lit) if name in overrides else lit
    out = df.withColumns(cols)
    fields = ([F.lit(model).alias("model")] if model else []) + [F.col(messages).alias("messages")] + \
        [F.col(n) for n in REQUEST_DEFAULTS]
    return out.withColumn("body", F.to_json(F.struct(*fields)))


_TYPES = {"n": "int", "top_k": "int", "max_tokens": "int", "repetition_penalty": "double",
          "temperature": "double", "stream": "boolean"}
