"""Tokens, vocabulary, label masks (TOK-*).

The reference tokenizer is an external model file; the built-in tokenizer here is an exact,
oracle-checkable whitespace tokenizer with reserved special tokens and a corpus vocabulary
ranked by ``(count desc, token)``. All steps are Spark SQL expressions or shuffles:

* splitting is a projection (no UDF);
* the vocabulary is ``explode -> groupBy(token).count`` (map-side partial counts) and a
  distributed global rank over sampled ranges (``plans.rank.range_rank``);
* ids are attached by an equi-join on the token, so a vocabulary of any size works; when it
  is small AQE measures it and broadcasts it. Hot tokens on the big side are split by AQE's
  skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import WS_CLASS, explode_rows, safe_slice
from parlance.plans.rank import range_rank

# ---- Fixed values ---------------------------------------------------------------------------
IGNORE_INDEX = -100
PAD, EOS, UNK = "<pad>", "</s>", "<unk>"
CONTROL_TAGS = ["<Retrieval>", "<No Retrieval>", "<Relevant>", "<Irrelevant>"]
# Reserved ids in order: pad 0, eos 1, unk 2, then the four control tags 3..6.
RESERVED_TOKENS = [PAD, EOS, UNK] + CONTROL_TAGS
CHAT_MARKERS = ["<|im_start|>", "<|im_end|>", "<s>", "[INST]", "[/INST]"]
# ---------------------------------------------------------------------------------------------

# "<No Retrieval>" holds a space; it is swapped for a placeholder before splitting whose joining
# character (U+E000, private use) is not whitespace in Python, Java or RE2.
NO_RETRIEVAL_PLACEHOLDER = "<No\ue000Retrieval>"
PAD_ID, EOS_ID, UNK_ID = 0, 1, 2
FIRST_FREE_ID = len(RESERVED_TOKENS) - 1  # ordinary tokens get FIRST_FREE_ID + rank


def _java_quote(tok: str) -> str:
    return "".join("\\" + ch if ch in r"\^$.|?*+()[]{}" else ch for ch in tok)


_SPACED = [NO_RETRIEVAL_PLACEHOLDER if t == "<No Retrieval>" else t
           for t in CHAT_MARKERS + RESERVED_TOKENS]


def _factored(tokens: list[str]) -> str:
    """One capturing group matching any of ``tokens``, the alternatives grouped by first
    character (``<(?:pad>|unk>|...)|\\[(?:INST\\]|...)``): at most positions of a text the
    match fails on one character test instead of trying every alternative. Longest first
    inside each group; valid in Java regex and RE2."""
    groups: dict[str, list[str]] = {}
    for t in sorted(tokens, key=len, reverse=True):
        groups.setdefault(t[0], []).append(t[1:])
    return "(" + "|".join(_java_quote(first) + "(?:" + "|".join(_java_quote(r) for r in rest) + ")"
                          for first, rest in groups.items()) + ")"


SPECIAL_RE = _factored(_SPACED)
SPLIT_RE = WS_CLASS + "+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_tokens(text) -> Column:
    """Whitespace tokens with every special token spaced out (``str.split()`` semantics).

    Splitting on whitespace runs leaves an empty string only at an end (leading or trailing
    whitespace, or an empty text); removing empty strings gives ``str.split()`` without a
    separate strip pass over the text."""
    t = F.replace(_c(text), F.lit("<No Retrieval>"), F.lit(NO_RETRIEVAL_PLACEHOLDER))
    t = F.regexp_replace(t, SPECIAL_RE, " $1 ")
    return F.array_remove(F.split(t, SPLIT_RE), "")


def reserved_vocabulary(spark) -> DataFrame:
    rows = [(NO_RETRIEVAL_PLACEHOLDER if t == "<No Retrieval>" else t, i)
            for i, t in enumerate(RESERVED_TOKENS)]
    return spark.createDataFrame(rows, "token string, id int")


def build_vocabulary(df: DataFrame, tokens: str) -> DataFrame:
    """TOK-2: ``(token, id, n)``; reserved ids first, then ``FIRST_FREE_ID + rank`` by
    ``(n desc, token)`` over every (untruncated) token of ``tokens``.

    The token counts and the finished vocabulary are written as tables in the shared checkpoint
    folder: the corpus is tokenized once for the counts, the rank reads the counts table, and
    every later join reads the vocabulary table instead of re-deriving it from the text.
    ``(n desc, token)`` is unique but has no even bucket (most tokens share n = 1 and one
    prefix may hold a third of them), so the rank cuts its ranges by sampling
    (``plans.rank.range_rank``).
    """
    from parlance.sources.io import materialize
    spark = df.sparkSession
    reserved = reserved_vocabulary(spark)
    counts = materialize(explode_rows(df, [], _c(tokens), "token")
                         .groupBy("token").agg(F.count(F.lit(1)).alias("n")), "vocab-counts")
    ordinary = counts.join(F.broadcast(reserved), "token", "left_anti")
    ranked = range_rank(ordinary, [F.col("n").desc(), F.col("token")], "rank")
    ids = ranked.select("token", (F.col("rank") + FIRST_FREE_ID).cast("int").alias("id"), "n")
    res = reserved.join(counts, "token", "left").select(
        "token", "id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return materialize(ids.unionByName(res), "vocabulary")


def hashed_ids(tokens, vocab_size: int) -> Column:
    """Stateless ids: reserved ids for special tokens, else ``FIRST_FREE_ID + 1 + h % V`` with
    ``h = conv(substr(md5(tok),1,8),16,10)`` (same value in DuckDB and Python)."""
    reserved = F.create_map(*[x for i, t in enumerate(RESERVED_TOKENS)
                              for x in (F.lit(NO_RETRIEVAL_PLACEHOLDER if t == "<No Retrieval>" else t),
                                        F.lit(i))])
    return F.transform(_c(tokens), lambda t: F.coalesce(
        F.try_element_at(reserved, t),
        (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % vocab_size
         + FIRST_FREE_ID + 1).cast("int")))


#: Most frequent tokens that are looked up without a shuffle.
HOT_TOKENS = 4096


def look_up(df: DataFrame, table: DataFrame, by: str, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` left-joined to a vocabulary's ``token, id`` on ``by``, in two parts that together hold every row.

    Ids go by falling frequency, so the reserved ones and the next ``hot`` hold most occurrences, a
    marker that stands in every row included. That table is at most ``hot`` rows and a few long and is
    broadcast behind that bound; its tokens never meet in a shuffle. What it does not hold, the long
    tail without a heavy hitter, is joined to the rest of the vocabulary as Spark sees fit."""
    other = "id" if by == "token" else "token"
    first = F.col("id") <= FIRST_FREE_ID + (HOT_TOKENS if hot is None else hot)
    near = df.join(F.broadcast(table.where(first).select("token", "id")), by, "left")
    tail = near.where(F.col(other).isNull() & F.col(by).isNotNull()).drop(other)
    return (near.where(F.col(other).isNotNull() | F.col(by).isNull()),
            tail.join(table.where(~first).select("token", "id"), by, "left"))


def encode(df: DataFrame, key: list[str], tokens: str, vocab: DataFrame,
           max_len: int | None = None, out: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """TOK-1 ids: ``tokens`` (cut on the right at ``max_len``) -> vocabulary ids; unknown
    tokens map to ``<unk>``; rows with no tokens get ``[]``.

    Without ``carry`` the rows keep all their columns (the ids are joined back by ``key``).
    With ``carry`` (small per-row columns such as lengths) those ride along the explode and the
    result is ``key + carry + [out]`` straight from the regrouping: no join back, so the
    tokens are not computed a second time for the other side of such a join, and with a
    broadcast vocabulary the regrouping reuses the rows' partitioning by ``key``.
    """
    toks = _c(tokens) if max_len is None else F.slice(_c(tokens), 1, max_len)
    vid = F.struct("_pos", F.coalesce("id", F.lit(UNK_ID)).alias("id"))
    if carry is not None:
        # outer explode: a row without tokens keeps one null row (no inferred size filter either)
        ex = df.select(*key, *carry, F.posexplode_outer(toks).alias("_pos", "token"))
        near, tail = look_up(ex, vocab, "token")
        j = near.unionByName(tail)
        per_row = j.groupBy(*key, *carry).agg(
            F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), vid))).alias("_ids"))
        return per_row.select(*key, *carry, F.col("_ids.id").alias(out))
    near, tail = look_up(explode_rows(df, key, toks, "token", "_pos"), vocab, "token")
    j = near.unionByName(tail)
    per_row = j.groupBy(*key).agg(F.array_sort(F.collect_list(vid)).alias("_ids"))
    res = df.join(per_row, key, "left")
    return res.withColumn(out, F.coalesce(F.col("_ids.id"),
                                          F.array().cast("array<int>"))).drop("_ids")


def label_mask(ids, source_len) -> Column:
    """TOK-3: labels = ids with the first ``min(source_len, len(ids))`` set to -100."""
    ids = _c(ids)
    m = F.least(_c(source_len), F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), m), safe_slice(ids, m + 1, F.size(ids) - m))


def supervised_count(labels) -> Column:
    return F.size(F.array_remove(_c(labels), IGNORE_INDEX))


def truncate(ids, max_len: int) -> Column:
    """TOK-6: prompt ids cut to ``max_len`` (keep the first ones)."""
    return F.slice(_c(ids), 1, max_len)


def truncation_report(df: DataFrame, n_full: str, n_source: str, n_supervised: str,
                      max_len: int) -> DataFrame:
    """TOK-4: one-row report of what truncation at ``max_len`` cost.

    ``no_supervision`` = rows left without a supervised token, ``eos_lost`` = rows whose
    target (ending in eos) was cut, ``at_cap`` = rows cut at all; exact length quartiles.
    """
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(F.col(n_supervised) == 0, 1).otherwise(0)).cast("long").alias("no_supervision"),
        F.sum(F.when(F.col(n_full) > max_len, 1).otherwise(0)).cast("long").alias("eos_lost"),
        F.sum(F.when(F.col(n_source) >= max_len, 1).otherwise(0)).cast("long").alias("prompt_fills_cap"),
        F.sum(F.when(F.col(n_full) >= max_len, 1).otherwise(0)).cast("long").alias("at_cap"),
        F.percentile(F.col(n_full), 0.5).alias("median_len"),
        F.percentile(F.col(n_full), 0.9).alias("p90_len"),
        F.max(n_full).cast("long").alias("max_len"))


def decode(df: DataFrame, key: list[str], ids: str, vocab: DataFrame, out: str = "text",
           skip_special: bool = True, carry: list[str] | None = None) -> DataFrame:
    """TOK-5: ids -> text joined by spaces, special tokens skipped.

    Without ``carry`` the rows keep all their columns (the text is joined back by ``key``);
    with ``carry`` the result is ``key + carry + [out]`` straight from the regrouping, so the
    rows (often a whole tokenizing plan) are not computed a second time for a join back."""
    v = vocab.select("id", F.replace("token", F.lit(NO_RETRIEVAL_PLACEHOLDER), F.lit("<No Retrieval>")).alias("token"))
    if carry is not None:
        # outer explode keeps rows without ids; skipped and padding rows become nulls, which
        # collect_list drops
        ex = df.select(*key, *carry, F.posexplode_outer(_c(ids)).alias("_pos", "id"))
        keep = F.col("_pos").isNotNull()
        if skip_special:
            keep = keep & (F.col("id") >= len(RESERVED_TOKENS))
        near, tail = look_up(ex, v, "id")
        j = near.unionByName(tail)
        per_row = j.groupBy(*key, *carry).agg(
            F.array_sort(F.collect_list(F.when(keep, F.struct("_pos", "token")))).alias("_t"))
        return per_row.select(*key, *carry, F.array_join(F.col("_t.token"), " ").alias(out))
    near, tail = look_up(explode_rows(df, key, ids, "id", "_pos"), v, "id")
    j = near.unionByName(tail)
    if skip_special:
        j = j.filter(F.col("id") >= len(RESERVED_TOKENS))
    per_row = j.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_pos", "token"))).alias("_t"))
    res = df.join(per_row, key, "left")
    return res.withColumn(out, F.coalesce(F.array_join(F.col("_t.token"), " "),
                                          F.lit(""))).drop("_t")


def control_tag_counts(df: DataFrame, text: str) -> DataFrame:
    """TOK-7: occurrences of each control tag in ``text``."""
    pat = "(" + "|".join(_java_quote(t) for t in CONTROL_TAGS) + ")"
    return (df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pat), 1)).alias("tag"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("n")))
