"""Registered queries: the fine-tuning data plan (PRJ-1, TOK-*, ORD-1, BAT-*)."""

from __future__ import annotations

from parlance.operators import templates as T
from parlance.operators.tokens import RESERVED_TOKENS, NO_RETRIEVAL_PLACEHOLDER
from parlance.plans import sft
from parlance.plans.inputs import table
from parlance.plans.registry import query
from parlance.plans.sqltext import ints, lit, md5_key, tokens

# ---- shared oracle fragments -----------------------------------------------------------------
PAIRS_SQL = """
pairs AS (
  SELECT conv_id, turn, text AS instruction, nxt AS output FROM (
    SELECT conv_id, turn, role, text,
           lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
           lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt
    FROM conversations) WHERE role = 'user' AND nrole = 'assistant')"""

SOURCE_SQL = (f"{lit(T.CHATML_SYSTEM)} || {lit('<|im_start|>user' + chr(10))} || instruction || "
              f"{lit('<|im_end|>' + chr(10) + '<|im_start|>assistant' + chr(10))}")
TARGET_SQL = "output || '</s>'"

_reserved = ", ".join(f"('{NO_RETRIEVAL_PLACEHOLDER if t == '<No Retrieval>' else t}', {i})"
                      for i, t in enumerate(RESERVED_TOKENS))


LLAMA2_SOURCE_SQL = f"'<s>[INST] ' || {lit(T.INST_SYSTEM)} || instruction || ' [/INST]'"
LLAMA2_TARGET_SQL = "' ' || output || ' </s>'"


def tok_ctes(max_len: int = 128, source: str = SOURCE_SQL, target: str = TARGET_SQL) -> str:
    return f"""{PAIRS_SQL},
recs AS (SELECT conv_id, turn, {source} AS src, {target} AS tgt FROM pairs),
tok AS (SELECT conv_id, turn, {tokens('src')} AS st, {tokens('src || tgt')} AS ft FROM recs),
reserved AS (SELECT * FROM (VALUES {_reserved}) r(token, id)),
counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(ft) AS token FROM tok) GROUP BY token),
vocab AS (
  SELECT token, CAST({len(RESERVED_TOKENS) - 1} + row_number() OVER (ORDER BY n DESC, token) AS INTEGER) AS id, n
  FROM counts WHERE token NOT IN (SELECT token FROM reserved)
  UNION ALL SELECT r.token, CAST(r.id AS INTEGER), coalesce(c.n, 0) FROM reserved r LEFT JOIN counts c USING (token)),
ex AS (SELECT conv_id, turn, unnest(range(1, len(ft[1:{max_len}]) + 1)) AS pos, unnest(ft[1:{max_len}]) AS token FROM tok),
idl AS (SELECT conv_id, turn, list(coalesce(v.id, 2) ORDER BY pos) AS ids FROM ex LEFT JOIN vocab v USING (token) GROUP BY conv_id, turn),
enc AS (
  SELECT t.conv_id, t.turn, coalesce(i.ids, []::INTEGER[]) AS ids, len(t.ft) AS n_full, len(t.st) AS n_source,
         least(least(len(t.st), {max_len}), len(coalesce(i.ids, []::INTEGER[]))) AS m
  FROM tok t LEFT JOIN idl i USING (conv_id, turn)),
lab AS (SELECT conv_id, turn, ids, n_full, n_source,
               list_concat(list_resize([]::INTEGER[], m, -100), ids[m + 1:]) AS labels FROM enc)"""


def batches_sql(ctes: str) -> str:
    return f"""WITH {ctes},
rk AS (SELECT *, row_number() OVER (ORDER BY {md5_key('conv_id', 'turn', seed=42)}, conv_id, turn) AS rnk FROM lab),
b AS (SELECT *, CAST((rnk - 1) // 8 AS BIGINT) AS batch_id FROM rk),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS width FROM b),
p AS (SELECT conv_id, turn, batch_id, CAST(len(ids) AS BIGINT) AS n_tokens,
             CAST(len(list_filter(labels, lambda x: x != -100)) AS BIGINT) AS n_supervised,
             list_concat(ids, list_resize([]::INTEGER[], width - len(ids), 0)) AS pids,
             list_concat(labels, list_resize([]::INTEGER[], width - len(labels), -100)) AS plabels
      FROM w)
SELECT conv_id, turn, batch_id, n_tokens, n_supervised, {ints('pids')} AS ids, {ints('plabels')} AS labels,
       {ints('list_transform(pids, lambda x: CASE WHEN x != 0 THEN 1 ELSE 0 END)')} AS mask
FROM p"""


@query("sft_batches", batches_sql(tok_ctes(128)))
def q_sft_batches(spark, sf_dir):
    """conversations -> pairs -> ChatML -> tokens/vocabulary -> masked labels -> seeded
    shuffle -> batches of 8 -> right padding and attention mask."""
    return sft.sft_batches(table(spark, sf_dir, "conversations"))


@query("sft_batches_4096", batches_sql(tok_ctes(4096)))
def q_sft_batches_4096(spark, sf_dir):
    """The same at the training length, 4096 tokens."""
    return sft.sft_batches(table(spark, sf_dir, "conversations"), 4096)


@query("sft_batches_llama2", batches_sql(tok_ctes(4096, LLAMA2_SOURCE_SQL, LLAMA2_TARGET_SQL)))
def q_sft_batches_llama2(spark, sf_dir):
    """The same in the instruction form with a system block, at 4096 tokens."""
    return sft.sft_batches(table(spark, sf_dir, "conversations"), 4096, mode="llama2")
