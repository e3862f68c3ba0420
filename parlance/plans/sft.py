"""The flagship fine-tuning plan: conversations -> padded, masked, shuffled batches.

conversations -> PRJ-1 pairs -> PRJ-4 source + PRJ-6 target -> TOK-1 tokens -> TOK-2 vocabulary
-> TOK-1 ids (cut at ``max_len``) -> TOK-3 labels -> ORD-1 seeded order -> BAT-1 batches ->
BAT-2..4 padding and mask.

Text crosses the network once, into the sampled ranges of PRJ-1; there it is paired, rendered and
tokenized, and the tokens are written with a number for each row. Everything later reads that table:
the vocabulary counts (by token, partial first), the ids (by token, regrouped by row number), and
the seeded order, which ranks keys only and meets the ids by row number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import ints_to_text
from parlance.operators import batching, ordering, templates, tokens
from parlance.sources.io import materialize

KEY = ["conv_id", "turn"]


def sft_examples(conversations: DataFrame, mode: str = "qwen2", eos: str = templates.DEFAULT_EOS) -> DataFrame:
    """Rendered (source, target) text per user->assistant pair."""
    pairs = templates.conversation_pairs(conversations)
    return pairs.select(*KEY,
                        templates.render_source("instruction", mode, add_generation_prompt=True).alias("source"),
                        templates.render_target("output", mode, eos).alias("target"))


def lengths(examples: DataFrame) -> DataFrame:
    """Token counts only: ``KEY, n_full, n_source``."""
    return examples.select(*KEY, F.size(tokens.split_tokens(F.concat("source", "target"))).cast("long").alias("n_full"),
                           F.size(tokens.split_tokens("source")).cast("long").alias("n_source"))


def token_table(examples: DataFrame) -> DataFrame:
    """Each example's tokens, written once: ``row`` (a number of its own), ``KEY, full_tokens, n_full,
    n_source``."""
    tok = examples.select(*KEY, tokens.split_tokens("source").alias("s"),
                          tokens.split_tokens(F.concat("source", "target")).alias("full_tokens"))
    return materialize(tok.select(F.monotonically_increasing_id().alias("row"), *KEY, "full_tokens",
                                  F.size("full_tokens").cast("long").alias("n_full"),
                                  F.size("s").cast("long").alias("n_source")), "tokens")


def encoded(tok: DataFrame, vocab: DataFrame, max_len: int, facts: DataFrame | None = None) -> DataFrame:
    """TOK-1/3 over a token table: ids cut at ``max_len`` and labels with the prompt masked, beside
    ``facts`` (by ``row``; the table's keys and lengths unless given)."""
    if facts is None:
        facts = tok.select("row", *KEY, "n_full", "n_source")
    ids = tokens.encode(tok.select("row", "full_tokens"), ["row"], "full_tokens", vocab, max_len, "ids", carry=[])
    src_len = F.least(F.col("n_source").cast("int"), F.lit(max_len))
    return ids.join(facts, "row").withColumn("labels", tokens.label_mask("ids", src_len))


def tokenize_examples(examples: DataFrame, max_len: int = 128, vocab: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """TOK-1/2/3 of rendered examples: ``(rows, vocab)``, rows ``KEY, ids, labels, n_full, n_source``."""
    tok = token_table(examples)
    vocab = tokens.build_vocabulary(tok, "full_tokens") if vocab is None else vocab
    return encoded(tok, vocab, max_len).select(*KEY, "ids", "labels", "n_full", "n_source"), vocab


def ordered_batches(conversations: DataFrame, max_len: int = 128, seed: int = 42, batch_size: int = 8,
                    mode: str = "qwen2") -> DataFrame:
    """Encoded rows with their ``rank`` in seeded order and ``batch_id``."""
    tok = token_table(sft_examples(conversations, mode))
    ranked = ordering.seeded_shuffle(tok.select("row", *KEY, "n_full", "n_source"), KEY, seed, "rank")
    rows = encoded(tok, tokens.build_vocabulary(tok, "full_tokens"), max_len, ranked)
    return batching.assign_batches(rows, "rank", batch_size)


def sft_batches(conversations: DataFrame, max_len: int = 128, seed: int = 42, batch_size: int = 8,
                mode: str = "qwen2", pad_id: int = tokens.PAD_ID) -> DataFrame:
    batched = ordered_batches(conversations, max_len, seed, batch_size, mode).withColumn("n_tokens", F.size("ids").cast("long"))
    padded = batching.pad_batch(batched, "ids", "labels", "batch_id", pad_id)
    return padded.select(
        "conv_id", "turn", "batch_id",
        "n_tokens",
        tokens.supervised_count("labels").cast("long").alias("n_supervised"),
        ints_to_text("ids").alias("ids"),
        ints_to_text("labels").alias("labels"),
        ints_to_text("attention_mask").alias("mask"))
