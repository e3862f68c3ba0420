"""Registered queries: answer metrics (AGG-4..8). Stand-in input: gold = the reply of each SFT
pair, prediction = its whole instruction, or the reply itself when ``conv_id % 5 = 0``."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import WS_CLASS
from parlance.operators import metrics as M
from parlance.plans import inputs
from parlance.plans.q_prep import IDX_SQL
from parlance.plans.registry import query
from parlance.plans.sqltext import strip


def predictions(spark, sf):
    r = inputs.indexed_records(spark, sf)
    pred = F.when(F.pmod("conv_id", F.lit(5)) == 0, F.col("output")).otherwise(F.col("input"))
    return r.select("idx", pred.alias("prediction"), F.col("output").alias("gold"))


def _ws(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split_regex({s}, '{WS_CLASS}+') END)"


_PUNCT = M.ASCII_PUNCT_RE.replace("'", "''")


def _norm(x: str) -> str:
    return f"list_filter({_ws(f'regexp_replace(lower({x}), {chr(39)}{_PUNCT}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}, lambda t: t NOT IN ('a', 'an', 'the'))"


PRED_SQL = f"""{IDX_SQL},
recs AS (SELECT idx, CASE WHEN conv_id % 5 = 0 THEN output ELSE instruction END AS prediction,
  output AS gold FROM idxd)"""

SCORES_SQL = f"""{PRED_SQL},
tk AS (SELECT idx, {_norm('prediction')} AS pt, {_norm('gold')} AS gt FROM recs),
gr AS (SELECT idx, unnest(pt) AS tok, 1 AS a, 0 AS b FROM tk UNION ALL SELECT idx, unnest(gt) AS tok, 0 AS a, 1 AS b FROM tk),
cm AS (SELECT idx, sum(least(na, nb)) AS common FROM (SELECT idx, tok, sum(a) AS na, sum(b) AS nb FROM gr GROUP BY ALL) GROUP BY idx),
sc AS (SELECT t.idx, len(pt) AS pred_len, len(gt) AS gold_len, CAST(coalesce(common, 0) AS BIGINT) AS common,
  CAST(array_to_string(pt, ' ') = array_to_string(gt, ' ') AS INTEGER) AS exact_match FROM tk t LEFT JOIN cm USING (idx)),
sc2 AS (SELECT *,
  CASE WHEN pred_len = 0 OR gold_len = 0 THEN CAST(pred_len = 0 AND gold_len = 0 AS DOUBLE) ELSE common / pred_len END AS precision,
  CASE WHEN pred_len = 0 OR gold_len = 0 THEN CAST(pred_len = 0 AND gold_len = 0 AS DOUBLE) ELSE common / gold_len END AS recall,
  CASE WHEN pred_len = 0 OR gold_len = 0 THEN CAST(pred_len = 0 AND gold_len = 0 AS DOUBLE) WHEN common = 0 THEN 0.0
       ELSE 2 * common / (pred_len + gold_len) END AS f1 FROM sc)"""


def _scores(spark, sf):
    return M.token_overlap(predictions(spark, sf), "idx", "prediction", "gold")


def _r(c, d=9):
    return F.round(c, d)


@query("exact_match", f"WITH {SCORES_SQL} SELECT idx, exact_match FROM sc2")
def q_exact_match(spark, sf):
    """AGG-4: normalized prediction equals normalized gold (per example)."""
    return _scores(spark, sf).select("idx", "exact_match")


@query("token_recall", f"WITH {SCORES_SQL} SELECT idx, common, CAST(gold_len AS INTEGER) AS gold_len, round(recall, 9) AS recall FROM sc2")
def q_token_recall(spark, sf):
    """AGG-5: share of gold tokens found in the prediction (multiset overlap)."""
    return _scores(spark, sf).select("idx", "common", "gold_len", _r(F.col("recall")).alias("recall"))


@query("token_f1", f"WITH {SCORES_SQL} SELECT idx, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM sc2")
def q_token_f1(spark, sf):
    """AGG-6: token precision, recall and F1 per example."""
    s = _scores(spark, sf)
    return s.select("idx", _r(F.col("precision")).alias("precision"), _r(F.col("recall")).alias("recall"),
                    _r(F.col("f1")).alias("f1"))


@query("avg_length", f"""WITH {SCORES_SQL} SELECT CAST(count(*) AS BIGINT) AS examples, round(avg(exact_match), 9) AS exact_match,
  round(avg(recall), 9) AS token_recall, round(avg(f1), 9) AS token_f1, round(avg(pred_len), 9) AS avg_length FROM sc2""")
def q_avg_length(spark, sf):
    """AGG-7 (+ the means of AGG-4..6): mean prediction length and mean scores, one row."""
    s = M.qa_summary(_scores(spark, sf))
    return s.select("examples", *[_r(F.col(c)).alias(c) for c in ("exact_match", "token_recall", "token_f1", "avg_length")])


def _grams_sql(side: str, n_max: int, char: bool) -> str:
    if char:
        body = f"CASE WHEN length({side}) >= n THEN list_transform(range(1, length({side}) - n + 2), lambda i: substr({side}, i, n)) ELSE [] END"
    else:
        body = (f"CASE WHEN len({side}) >= n THEN list_transform(range(1, len({side}) - n + 2), "
                f"lambda i: array_to_string({side}[i:i + n - 1], ' ')) ELSE [] END")
    return body


def _stats_sql(n_max: int, char: bool) -> str:
    pg, gg = _grams_sql("p", n_max, char), _grams_sql("g", n_max, char)
    ns = ", ".join(str(i) for i in range(1, n_max + 1))
    return f"""tn AS (SELECT idx, p, g, unnest([{ns}]) AS n FROM tk),
gr AS (SELECT idx, n, unnest({pg}) AS gram, 1 AS a, 0 AS b FROM tn UNION ALL SELECT idx, n, unnest({gg}) AS gram, 0 AS a, 1 AS b FROM tn),
cl AS (SELECT idx, n, gram, sum(a) AS np, sum(b) AS ng FROM gr GROUP BY ALL),
st AS (SELECT n, sum(np) AS hyp, sum(ng) AS ref, sum(least(np, ng)) AS match FROM cl GROUP BY n)"""


@query("corpus_bleu", f"""WITH {PRED_SQL}, tk AS (SELECT idx, {_ws('prediction')} AS p, {_ws('gold')} AS g FROM recs),
{_stats_sql(4, False)},
ln AS (SELECT sum(len(p)) AS sys_len, sum(len(g)) AS ref_len FROM tk),
o AS (SELECT n, hyp, match, sum(CASE WHEN hyp > 0 AND match = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS k,
  min(CASE WHEN hyp > 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS alive FROM st),
pr AS (SELECT n, alive, match, CASE WHEN match = 0 THEN 100.0 / (pow(2.0, k) * hyp) ELSE 100.0 * match / hyp END AS prec FROM o),
fin AS (SELECT sum(CASE WHEN alive = 1 THEN 1 ELSE 0 END) AS eff, sum(CASE WHEN alive = 1 THEN ln(prec) ELSE 0 END) AS tot,
  max(CASE WHEN n = 1 THEN match END) AS m1, max(CASE WHEN n = 1 THEN prec END) AS p1, max(CASE WHEN n = 2 THEN prec END) AS p2, max(CASE WHEN n = 3 THEN prec END) AS p3,
  max(CASE WHEN n = 4 THEN prec END) AS p4 FROM pr),
bp AS (SELECT sys_len, ref_len, CASE WHEN sys_len >= ref_len THEN 1.0 WHEN sys_len = 0 THEN 0.0 ELSE exp(1 - ref_len / sys_len) END AS bp FROM ln)
SELECT round(CASE WHEN eff < 4 OR m1 = 0 THEN 0.0 ELSE bp * exp(tot / eff) END, 9) AS bleu, round(bp, 9) AS bp, CAST(sys_len AS BIGINT) AS sys_len,
  CAST(ref_len AS BIGINT) AS ref_len, round(p1, 9) AS p1, round(p2, 9) AS p2, round(p3, 9) AS p3, round(p4, 9) AS p4 FROM fin, bp""")
def q_corpus_bleu(spark, sf):
    """AGG-8: corpus BLEU of predictions against gold replies (one row)."""
    b = M.corpus_bleu(predictions(spark, sf), "idx", "prediction", "gold")
    return b.select(*[_r(F.col(c)).alias(c) if c not in ("sys_len", "ref_len") else F.col(c) for c in b.columns])


@query("corpus_chrf", f"""WITH {PRED_SQL}, tk AS (SELECT idx, regexp_replace(prediction, '{WS_CLASS}', '', 'g') AS p,
  regexp_replace(gold, '{WS_CLASS}', '', 'g') AS g FROM recs),
{_stats_sql(6, True)},
pa AS (SELECT avg(match / hyp) AS P, avg(match / ref) AS R FROM st WHERE hyp > 0 AND ref > 0)
SELECT round(CASE WHEN coalesce(P + R, 0) = 0 THEN 0.0 ELSE 100.0 * 5 * P * R / (4 * P + R) END, 9) AS chrf,
  round(coalesce(P, 0.0), 9) AS char_precision, round(coalesce(R, 0.0), 9) AS char_recall FROM pa""")
def q_corpus_chrf(spark, sf):
    """AGG-8: corpus chrF (character 6-grams, beta 2) of predictions against gold (one row)."""
    c = M.corpus_chrf(predictions(spark, sf), "idx", "prediction", "gold")
    return c.select(*[_r(F.col(x)).alias(x) for x in c.columns])
