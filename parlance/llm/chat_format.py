"""Chat formatting: every assistant turn becomes one example whose context is all turns
before it and whose only trainable text is that reply.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a role or
text are escaped reversibly: ``\\`` doubles, then ``<|`` becomes ``<\\|`` (and a newline in a role
``\\n``), so ``<|`` in the output is always a mark.

Defined results: a null text or role is empty; a null turn sorts first; equal turns sort by role
and text; repeated rows are repeated turns; a null conv_id is one conversation. Turns after the
last assistant turn come as one more example with nothing trainable (``target`` null), so every
turn is in the output. Extra columns are ignored; an empty table gives no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import let

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    # "\n" written as backslash-n: a single backslash before n (others are doubled)
    return unescape(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """``(conv_id, target, n_context, text, loss_start, loss_chars)``: one row per assistant turn
    (``target`` its position from 0) and at most one row without a target. ``loss_start`` is the
    code point (from 0) where the trainable reply starts in ``text``.

    A conversation's turns meet in one row, because each example is made of all turns before its
    reply; the turns are grouped once and the examples exploded inside the row.
    """
    t = conversations.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "body")))
    g = t.groupBy("conv_id").agg(turns.alias("turns"))
    heads = F.transform("turns", lambda x: F.concat(F.lit(START), _escape_role(x["role"]), F.lit("\n")))
    bodies = F.transform("turns", lambda x: escape(x["body"]))
    g = g.select("conv_id", F.transform("turns", lambda x: x["role"]).alias("roles"),
                 heads.alias("heads"), bodies.alias("bodies"))
    n = F.size("roles")
    targets = F.filter(F.sequence(F.lit(0), n - 1),
                       lambda i: (F.get("roles", i) == "assistant") | (i == n - 1))
    g = g.withColumn("target", F.explode(targets))
    seg = F.transform(F.arrays_zip("heads", "bodies"),
                      lambda x: F.concat(x["heads"], x["bodies"], F.lit(END + "\n")))
    before = F.array_join(F.slice(seg, 1, F.col("target")), "")
    reply = F.get("roles", F.col("target")) == "assistant"
    return (g.withColumn("before", F.concat(before, F.get("heads", F.col("target"))))
            .select("conv_id", F.when(reply, F.col("target")).alias("target"),
                    F.col("target").alias("n_context"),
                    F.concat("before", F.get("bodies", F.col("target")), F.lit(END + "\n")).alias("text"),
                    F.when(reply, F.char_length("before")).alias("loss_start"),
                    F.when(reply, F.char_length(F.get("bodies", F.col("target")))).otherwise(0).alias("loss_chars")))


def parse_turns(text: Column) -> Column:
    """Array of ``(role, text)`` read back from formatted text."""
    def one(s: Column) -> Column:
        at = F.locate("\n", s)
        return F.struct(_unescape_role(F.substring(s, F.lit(len(START) + 1), at - len(START) - 1)).alias("role"),
                        unescape(F.substring(s, at + 1, F.char_length(s))).alias("text"))
    parts = F.split(text, r"<\|im_end\|>\n")
    return let(parts, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), one))


def loss_text(text: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return F.when(chars > 0, unescape(F.substring(text, start + 1, chars))).otherwise("")


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns and loss digests and lengths."""
    longest = F.max(F.struct("n_context", "text"))["text"]
    replies = F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct(
        "target", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("said")))))
    g = examples.groupBy("conv_id").agg(longest.alias("longest"), replies.alias("replies"),
                                        F.sum(F.char_length("text")).alias("formatted_chars"))
    g = g.select("conv_id", "formatted_chars", parse_turns(F.col("longest")).alias("turns"),
                 F.array_join(F.transform("replies", lambda x: x["said"]), "").alias("said"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return g.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(lines, 256).alias("turns_sha256"),
                    F.char_length("said").cast("long").alias("loss_chars"),
                    F.sha2(F.col("said"), 256).alias("loss_sha256"),
                    F.col("formatted_chars").cast("long").alias("formatted_chars"))
