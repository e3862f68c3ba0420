"""Registered queries: records, templates, filters, orders, tokens and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import ints_to_text, md5_key
from parlance.operators import batching, ordering, templates as T, tokens as K
from parlance.plans import inputs, sft
from parlance.plans.inputs import table
from parlance.plans.q_sft import PAIRS_SQL, SOURCE_SQL, tok_ctes
from parlance.plans.rank import rank_index
from parlance.plans.registry import query
from parlance.plans.spread import spread
from parlance.plans.sqltext import ints, lit, md5_key as md5_sql, tokens as tokens_sql

KEY = ["conv_id", "turn"]
IDX_SQL = f"{PAIRS_SQL},\nidxd AS (SELECT row_number() OVER (ORDER BY {md5_sql('conv_id', 'turn', seed=42)}, conv_id, turn) - 1 AS idx, * FROM pairs)"


# ---- PRJ ------------------------------------------------------------------------------------
@query("conversation_pairs", f"WITH {PAIRS_SQL} SELECT conv_id, turn, instruction, output FROM pairs")
def q_conversation_pairs(spark, sf):
    """PRJ-1: user turn directly followed by an assistant turn -> (instruction, output)."""
    return inputs.sft_records(spark, sf)


@query("user_messages", "SELECT conv_id, turn, CAST(to_json([{'role': 'user', 'content': text}]) AS VARCHAR) AS messages "
       "FROM conversations WHERE role = 'user'")
def q_user_messages(spark, sf):
    """PRJ-2: each user text as a one-message chat."""
    c = inputs.conversations(spark, sf).filter(F.col("role") == "user")
    return c.select(*KEY, F.to_json(T.user_messages("text")).alias("messages"))


@query("system_user_messages", """WITH s AS (SELECT conv_id, arg_min(text, turn) AS sys FROM conversations WHERE role = 'system' GROUP BY conv_id)
SELECT c.conv_id, c.turn, CAST(to_json(list_concat(CASE WHEN s.sys IS NOT NULL THEN [{'role': 'system', 'content': s.sys}] ELSE [] END,
       [{'role': 'user', 'content': c.text}])) AS VARCHAR) AS messages
FROM conversations c LEFT JOIN s USING (conv_id) WHERE c.role = 'user'""")
def q_system_user_messages(spark, sf):
    """PRJ-3: optional system message (the conversation's first system turn), then the user."""
    c = inputs.conversations(spark, sf)
    sys_ = c.filter(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("sys"))
    users = c.filter(F.col("role") == "user").join(sys_, "conv_id", "left")
    return users.select(*KEY, F.to_json(T.system_user_messages("text", F.col("sys"))).alias("messages"))


@query("chatml_source", f"WITH {PAIRS_SQL} SELECT conv_id, turn, {SOURCE_SQL} AS source FROM pairs")
def q_chatml_source(spark, sf):
    """PRJ-4: ChatML system + user prompt with the assistant header."""
    return inputs.sft_records(spark, sf).select(*KEY, T.render_source("instruction", "qwen2").alias("source"))


_INST_SYS = lit(T.INST_SYSTEM)


@query("inst_source", f"WITH {PAIRS_SQL} SELECT conv_id, turn, '<s>[INST] ' || instruction || ' [/INST]' AS source, "
       f"'<s>[INST] ' || {_INST_SYS} || instruction || ' [/INST]' AS source_with_system FROM pairs")
def q_inst_source(spark, sf):
    """PRJ-5: bracketed instruction form, without and with the <<SYS>> block."""
    r = inputs.sft_records(spark, sf)
    return r.select(*KEY, T.render_source("instruction", "llama2", with_system=False).alias("source"),
                    T.render_source("instruction", "llama2", with_system=True).alias("source_with_system"))


@query("target_with_eos", f"WITH {PAIRS_SQL} SELECT conv_id, turn, output || '</s>' AS qwen2_target, "
       f"' ' || output || ' </s>' AS llama2_target FROM pairs")
def q_target_with_eos(spark, sf):
    """PRJ-6: supervised target text with the end-of-sequence token."""
    r = inputs.sft_records(spark, sf)
    return r.select(*KEY, T.render_target("output", "qwen2").alias("qwen2_target"),
                    T.render_target("output", "llama2").alias("llama2_target"))


_TRAIN_SQL = (f"{lit(T.CHATML_SYSTEM)} || {lit('<|im_start|>user' + chr(10))} || instruction || "
              f"{lit('<|im_end|>' + chr(10))}")


@query("generation_prompt", f"WITH {PAIRS_SQL} SELECT conv_id, turn, {_TRAIN_SQL} AS train_source, "
       f"{SOURCE_SQL} AS infer_source FROM pairs")
def q_generation_prompt(spark, sf):
    """PRJ-7: the prompt without (fine-tuning) and with (inference) the assistant header."""
    r = inputs.sft_records(spark, sf)
    return r.select(*KEY, T.render_source("instruction", add_generation_prompt=False).alias("train_source"),
                    T.render_source("instruction", add_generation_prompt=True).alias("infer_source"))


@query("preference_triples", f"""WITH {IDX_SQL},
tr AS (SELECT instruction AS prompt, output AS chosen,
              coalesce(lead(output) OVER (ORDER BY idx), first_value(output) OVER (ORDER BY idx)) AS rejected FROM idxd)
SELECT CAST(to_json([{{'role': 'user', 'content': prompt}}]) AS VARCHAR) AS prompt,
       CAST(to_json([{{'role': 'assistant', 'content': chosen}}]) AS VARCHAR) AS chosen,
       CAST(to_json([{{'role': 'assistant', 'content': rejected}}]) AS VARCHAR) AS rejected FROM tr""")
def q_preference_triples(spark, sf):
    """PRJ-8: (prompt, chosen, rejected) as message arrays; other columns dropped. Stand-in
    input: chosen = the reply, rejected = the reply of the next pair in seeded order."""
    ix = inputs.record_index(spark, sf)
    r = ix.table
    nxt = r.select(F.pmod(F.col("idx") - 1, F.lit(max(ix.n, 1))).alias("idx"), F.col("output").alias("rejected"))
    trip = r.join(nxt, "idx").select(F.col("input").alias("prompt"), F.col("output").alias("chosen"), "rejected",
                                     "conv_id", "turn")
    out = T.preference_triples(trip)
    return out.select(*[F.to_json(c).alias(c) for c in ("prompt", "chosen", "rejected")])


_TURN_SQL = (f"{lit('<|im_start|>user' + chr(10))} || instruction || "
             f"{lit('<|im_end|>' + chr(10) + '<|im_start|>assistant' + chr(10))} || output || {lit('<|im_end|>' + chr(10))}")


@query("chatml_multi_turn", f"WITH {PAIRS_SQL} SELECT conv_id, count(*) AS n_pairs, "
       f"{lit(T.CHATML_SYSTEM)} || string_agg({_TURN_SQL}, '' ORDER BY turn) AS text FROM pairs GROUP BY conv_id")
def q_chatml_multi_turn(spark, sf):
    """PRJ-9: all pairs of a conversation in the multi-turn ChatML template."""
    return T.chatml_multi_turn(inputs.sft_records(spark, sf))


@query("attach_documents", """WITH rd AS (SELECT CAST(doc_id // 10 AS BIGINT) AS request_id, CAST(doc_id % 10 AS INTEGER) AS pos,
       regexp_extract(text, '^[^\\n]*') AS title, text FROM documents),
req AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT r.conv_id, r.turn, CAST(count(rd.pos) AS BIGINT) AS n_documents,
       CAST(coalesce(to_json(list({'title': rd.title, 'text': rd.text} ORDER BY rd.pos) FILTER (WHERE rd.pos IS NOT NULL)), '[]') AS VARCHAR) AS documents
FROM req r LEFT JOIN rd ON rd.request_id = r.conv_id GROUP BY r.conv_id, r.turn""")
def q_attach_documents(spark, sf):
    """PRJ-11: each request (first user turn of a conversation) gets its documents, ordered by
    ``pos``. Stand-in documents: ``documents`` rows keyed ``request_id = doc_id div 10``."""
    from parlance.operators.joins import attach_documents
    d = table(spark, sf, "documents")
    docs = d.select(F.floor(F.col("doc_id") / 10).cast("long").alias("request_id"),
                    F.pmod("doc_id", F.lit(10)).cast("int").alias("pos"),
                    F.regexp_extract("text", r"^[^\n]*", 0).alias("title"), "text")
    c = inputs.conversations(spark, sf).filter(F.col("role") == "user")
    req = c.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    out = attach_documents(req, docs, "conv_id")
    return out.select("conv_id", "turn", "n_documents", F.to_json("documents").alias("documents"))


@query("request_params", """SELECT conv_id, turn, CAST(1 AS INTEGER) AS n, CAST(50 AS INTEGER) AS top_k,
  CAST(CASE WHEN conv_id % 2 = 0 THEN 512 ELSE 1500 END AS INTEGER) AS max_tokens, 1.05 :: DOUBLE AS repetition_penalty,
  CASE WHEN turn % 3 = 0 THEN 0.2 ELSE 0.8 END :: DOUBLE AS temperature, false AS stream,
  CAST(to_json({'messages': [{'role': 'user', 'content': text}], 'n': 1, 'top_k': 50,
    'max_tokens': CASE WHEN conv_id % 2 = 0 THEN 512 ELSE 1500 END, 'repetition_penalty': 1.05 :: DOUBLE,
    'temperature': CASE WHEN turn % 3 = 0 THEN 0.2 ELSE 0.8 END :: DOUBLE, 'stream': false}) AS VARCHAR) AS body
FROM conversations WHERE role = 'user'""")
def q_request_params(spark, sf):
    """PRJ-12: request rows with per-row overrides (stand-in: max_tokens 512 on even
    conversations, temperature 0.2 on every third turn) over the defaults."""
    c = inputs.conversations(spark, sf).filter(F.col("role") == "user")
    c = c.select(*KEY, T.user_messages("text").alias("messages"),
                 F.when(F.col("conv_id") % 2 == 0, F.lit(512)).alias("mt"),
                 F.when(F.col("turn") % 3 == 0, F.lit(0.2)).alias("temp"))
    out = T.request_params(c, "messages", {"max_tokens": "mt", "temperature": "temp"})
    return out.select(*KEY, *T.REQUEST_DEFAULTS.keys(), "body")


# ---- FLT ------------------------------------------------------------------------------------
@query("subset_filter", "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def q_subset_filter(spark, sf):
    """FLT-1: rows of one dataset value (pushed down to the Parquet scan)."""
    from parlance.operators.filters import subset_filter
    return subset_filter(table(spark, sf, "documents"), "source", "src3").select("doc_id", "lang", "n_chars")


@query("human_agents", "SELECT c_custkey AS pos, c_name AS name FROM customer WHERE coalesce(c_acctbal < 0, false)")
def q_human_agents(spark, sf):
    """FLT-3: human participants only."""
    from parlance.operators.filters import human_agents
    return human_agents(inputs.group_agents(spark, sf)).select("pos", "name")


# ---- ORD ------------------------------------------------------------------------------------
@query("seeded_shuffle", f"WITH {PAIRS_SQL} SELECT conv_id, turn, row_number() OVER (ORDER BY "
       f"{md5_sql('conv_id', 'turn', seed=42)}, conv_id, turn) AS rank FROM pairs")
def q_seeded_shuffle(spark, sf):
    """ORD-1: seeded permutation of the SFT pairs (md5 order, distributed rank)."""
    return ordering.seeded_shuffle(inputs.sft_records(spark, sf), KEY, 42, "rank").select(*KEY, "rank")


@query("sort_by_idx", f"WITH {IDX_SQL} SELECT idx, conv_id, turn FROM idxd ORDER BY idx")
def q_sort_by_idx(spark, sf):
    """ORD-2: records in ``idx`` order."""
    return ordering.sort_by_idx(inputs.indexed_records(spark, sf).select("idx", *KEY))


@query("first_n", f"WITH {IDX_SQL} SELECT idx, conv_id, turn FROM idxd ORDER BY idx LIMIT 50")
def q_first_n(spark, sf):
    """ORD-3: the first 50 examples by ``idx`` (the limit is the feature)."""
    return ordering.first_n(inputs.indexed_records(spark, sf).select("idx", *KEY), 50)


# The reference's cut of fine-tuning rows (a parameter). ``tokenize_truncate`` and
# ``truncation_report`` show a shorter cut.
TRAIN_LEN = 4096


# ---- TOK ------------------------------------------------------------------------------------
def _tokens(spark, sf):
    return sft.token_table(sft.sft_examples(inputs.conversations(spark, sf)))


def _rows(spark, sf, max_len=128):
    tok = _tokens(spark, sf)
    vocab = K.build_vocabulary(tok, "full_tokens")
    return sft.encoded(tok, vocab, max_len), vocab


@query("tokenize_truncate", f"WITH {tok_ctes()} SELECT conv_id, turn, CAST(len(ids) AS BIGINT) AS n_tokens, "
       f"n_full, {ints('ids')} AS ids FROM lab")
def q_tokenize_truncate(spark, sf):
    """TOK-1: rendered pair -> whitespace tokens -> vocabulary ids, cut at 128."""
    rows, _ = _rows(spark, sf)
    return rows.select(*KEY, F.size("ids").cast("long").alias("n_tokens"), "n_full", ints_to_text("ids").alias("ids"))


@query("vocabulary", f"WITH {tok_ctes()} SELECT replace(token, chr(57344), ' ') AS token, id, CAST(n AS BIGINT) AS n FROM vocab")
def q_vocabulary(spark, sf):
    """TOK-2: reserved ids, then ids by (count desc, token) over every token of the corpus."""
    ex = sft.sft_examples(inputs.conversations(spark, sf))
    vocab = K.build_vocabulary(ex.select(K.split_tokens(F.concat("source", "target")).alias("full_tokens")), "full_tokens")
    return vocab.select(F.replace("token", F.lit(K.NO_RETRIEVAL_PLACEHOLDER), F.lit("<No Retrieval>")).alias("token"),
                        "id", "n")


@query("label_mask", f"WITH {tok_ctes(TRAIN_LEN)} SELECT conv_id, turn, {ints('labels')} AS labels, "
       f"CAST(len(list_filter(labels, lambda x: x != -100)) AS BIGINT) AS n_supervised FROM lab")
def q_label_mask(spark, sf):
    """TOK-3: labels = ids with the prompt part set to -100."""
    rows, _ = _rows(spark, sf, TRAIN_LEN)
    return rows.select(*KEY, ints_to_text("labels").alias("labels"),
                       K.supervised_count("labels").cast("long").alias("n_supervised"))


@query("truncation_report", f"""WITH {tok_ctes()}, s AS (SELECT *, len(list_filter(labels, lambda x: x != -100)) AS sup FROM lab)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN sup = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_supervision,
  CAST(sum(CASE WHEN n_full > 128 THEN 1 ELSE 0 END) AS BIGINT) AS eos_lost,
  CAST(sum(CASE WHEN n_source >= 128 THEN 1 ELSE 0 END) AS BIGINT) AS prompt_fills_cap,
  CAST(sum(CASE WHEN n_full >= 128 THEN 1 ELSE 0 END) AS BIGINT) AS at_cap,
  quantile_cont(n_full, 0.5) AS median_len, quantile_cont(n_full, 0.9) AS p90_len, CAST(max(n_full) AS BIGINT) AS max_len FROM s""")
def q_truncation_report(spark, sf):
    """TOK-4: what the 128-token cut costs: rows without supervision, lost eos, quantiles. Lengths
    are enough for it: no vocabulary, no ids."""
    rows = sft.lengths(sft.sft_examples(inputs.conversations(spark, sf)))
    kept = F.least("n_full", F.lit(128))
    return K.truncation_report(rows.withColumn("n_sup", kept - F.least("n_source", kept)), "n_full", "n_source", "n_sup", 128)


@query("decode_tokens", f"""WITH {tok_ctes(TRAIN_LEN)},
d AS (SELECT conv_id, turn, unnest(range(1, len(ids) + 1)) AS pos, unnest(ids) AS id FROM lab)
SELECT l.conv_id, l.turn, coalesce((SELECT string_agg(replace(v.token, chr(57344), ' '), ' ' ORDER BY d.pos) FROM d JOIN vocab v ON v.id = d.id
   WHERE d.conv_id = l.conv_id AND d.turn = l.turn AND d.id >= 7), '') AS text FROM lab l""")
def q_decode_tokens(spark, sf):
    """TOK-5: ids -> text via the vocabulary, special tokens skipped."""
    rows, vocab = _rows(spark, sf, TRAIN_LEN)
    return K.decode(rows.select(*KEY, "ids"), KEY, "ids", vocab, "text", carry=[]).select(*KEY, "text")


_DOC_PROMPT = f"{lit('<|im_start|>user' + chr(10))} || text || {lit('<|im_end|>' + chr(10) + '<|im_start|>assistant' + chr(10))}"
_HASH = "CAST(CAST(('0x' || substr(md5(t), 1, 8)) AS UBIGINT) % 50000 + 7 AS INTEGER)"


@query("prompt_truncate", f"""WITH t AS (SELECT doc_id, {tokens_sql(_DOC_PROMPT)} AS toks FROM documents)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(least(len(toks), 1536) AS BIGINT) AS n_kept,
  len(toks) > 1536 AS truncated,
  {ints(f"list_transform(toks[1:1536], lambda t: CASE t WHEN '<pad>' THEN 0 WHEN '</s>' THEN 1 WHEN '<unk>' THEN 2 WHEN '<Retrieval>' THEN 3 WHEN '<No' || chr(57344) || 'Retrieval>' THEN 4 WHEN '<Relevant>' THEN 5 WHEN '<Irrelevant>' THEN 6 ELSE {_HASH} END)")} AS ids
FROM t""")
def q_prompt_truncate(spark, sf):
    """TOK-6: document prompts tokenized with stateless hashed ids (V = 50,000) and cut to
    ``max_input_length`` = 1536 tokens, with the truncation flag."""
    d = spread(table(spark, sf, "documents"), "doc_id")
    toks = K.split_tokens(T.render_source("text", with_system=False))
    d = d.select("doc_id", toks.alias("toks"))
    return d.select("doc_id", F.size("toks").cast("long").alias("n_tokens"),
                    F.least(F.size("toks"), F.lit(1536)).cast("long").alias("n_kept"),
                    (F.size("toks") > 1536).alias("truncated"),
                    ints_to_text(K.hashed_ids(K.truncate("toks", 1536), 50000)).alias("ids"))


_TAGGED = ("CASE turn % 5 WHEN 0 THEN '<Retrieval>' || text WHEN 1 THEN text || ' <No Retrieval>' "
           "WHEN 2 THEN '<Relevant> ' || text || '<Irrelevant>' WHEN 3 THEN text ELSE '<Relevant>' || text || '<Relevant>' END")


@query("control_tags", f"""SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(regexp_extract_all({_TAGGED}, '(<Retrieval>|<No Retrieval>|<Relevant>|<Irrelevant>)', 1)) AS tag
  FROM conversations WHERE role = 'assistant') GROUP BY tag""")
def q_control_tags(spark, sf):
    """TOK-7: control-tag counts in replies (stand-in: tags placed by ``turn % 5``)."""
    c = inputs.conversations(spark, sf).filter(F.col("role") == "assistant")
    m = F.pmod("turn", F.lit(5))
    tagged = (F.when(m == 0, F.concat(F.lit("<Retrieval>"), "text"))
              .when(m == 1, F.concat("text", F.lit(" <No Retrieval>")))
              .when(m == 2, F.concat(F.lit("<Relevant> "), "text", F.lit("<Irrelevant>")))
              .when(m == 3, F.col("text"))
              .otherwise(F.concat(F.lit("<Relevant>"), "text", F.lit("<Relevant>"))))
    return K.control_tag_counts(c.select(tagged.alias("t")), "t")


# ---- BAT ------------------------------------------------------------------------------------
def _batched(spark, sf):
    return sft.ordered_batches(inputs.conversations(spark, sf), TRAIN_LEN)


_BATCH_CTE = f"""WITH {tok_ctes(TRAIN_LEN)},
rk AS (SELECT *, row_number() OVER (ORDER BY {md5_sql('conv_id', 'turn', seed=42)}, conv_id, turn) AS rnk FROM lab),
b AS (SELECT *, CAST((rnk - 1) // 8 AS BIGINT) AS batch_id, max(len(ids)) OVER (PARTITION BY (rnk - 1) // 8) AS width FROM rk)"""


@query("assign_batches", f"WITH {IDX_SQL} SELECT conv_id, turn, idx + 1 AS rank, CAST(idx // 8 AS BIGINT) AS batch_id FROM idxd")
def q_assign_batches(spark, sf):
    """BAT-1: contiguous batches of 8 in seeded order; the last one may be short."""
    r = ordering.seeded_shuffle(inputs.sft_records(spark, sf).select(*KEY), KEY, 42, "rank")
    return batching.assign_batches(r, "rank", 8).select(*KEY, "rank", "batch_id")


@query("pad_right", f"{_BATCH_CTE} SELECT conv_id, turn, batch_id, "
       f"{ints('list_concat(ids, list_resize([]::INTEGER[], width - len(ids), 0))')} AS ids FROM b")
def q_pad_right(spark, sf):
    """BAT-2: ids right-padded with pad id 0 to the batch maximum."""
    b = _batched(spark, sf).withColumn("_w", batching.batch_width("ids"))
    return b.select(*KEY, "batch_id", ints_to_text(batching.pad_right("ids", "_w", K.PAD_ID)).alias("ids"))


@query("pad_labels", f"{_BATCH_CTE} SELECT conv_id, turn, batch_id, "
       f"{ints('list_concat(labels, list_resize([]::INTEGER[], width - len(labels), -100))')} AS labels FROM b")
def q_pad_labels(spark, sf):
    """BAT-3: labels right-padded with -100."""
    b = _batched(spark, sf).withColumn("_w", batching.batch_width("ids"))
    return b.select(*KEY, "batch_id", ints_to_text(batching.pad_right("labels", "_w", K.IGNORE_INDEX)).alias("labels"))


@query("attention_mask", f"""{_BATCH_CTE}, p AS (SELECT *, list_concat(ids, list_resize([]::INTEGER[], width - len(ids), 0)) AS pids FROM b)
SELECT conv_id, turn, batch_id, {ints('list_transform(pids, lambda x: CASE WHEN x != 0 THEN 1 ELSE 0 END)')} AS mask,
  {ints('list_transform(range(width), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END)')} AS mask_by_length FROM p""")
def q_attention_mask(spark, sf):
    """BAT-4: mask = id != pad (parity with the reference) and the by-length mask."""
    b = _batched(spark, sf).withColumn("_w", batching.batch_width("ids"))
    ids = batching.pad_right("ids", "_w", K.PAD_ID)
    parity = F.transform(ids, lambda x: F.when(x != K.PAD_ID, 1).otherwise(0))
    by_length = F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), F.col("_w") - F.size("ids")))
    return b.select(*KEY, "batch_id", ints_to_text(parity).alias("mask"), ints_to_text(by_length).alias("mask_by_length"))


@query("pad_left", f"{_BATCH_CTE} SELECT conv_id, turn, batch_id, "
       f"{ints('list_concat(list_resize([]::INTEGER[], width - len(ids), 0), ids)')} AS ids, "
       f"{ints('list_transform(range(width), lambda i: CASE WHEN i >= width - len(ids) THEN 1 ELSE 0 END)')} AS mask FROM b")
def q_pad_left(spark, sf):
    """BAT-5: ids left-padded for generation, and the mask of their real positions."""
    b = batching.pad_batch(_batched(spark, sf).select(*KEY, "batch_id", "ids"), labels=None, pad_id=K.PAD_ID, side="left", mask_mode="by_length")
    return b.select(*KEY, "batch_id", ints_to_text("ids").alias("ids"), ints_to_text("attention_mask").alias("mask"))


@query("strided_shard", f"WITH {IDX_SQL} SELECT idx, conv_id, turn, CAST(idx % 4 AS INTEGER) AS shard FROM idxd "
       f"WHERE idx < (SELECT count(*) // 4 * 4 FROM idxd)")
def q_strided_shard(spark, sf):
    """BAT-6: world size 4, rank r takes idx r, r+4, ...; the n % 4 tail is dropped."""
    ix = rank_index(inputs.indexed_records(spark, sf).select("idx", *KEY), "idx")
    return batching.strided_shard(ix.table, "idx", 4, n=ix.n)
