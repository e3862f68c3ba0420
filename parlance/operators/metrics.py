"""Answer-quality metrics (AGG-4..8).

Definitions (the scorer itself is not in the reference; the published ones are used):

* **normalize** (SQuAD): lower case, drop ASCII punctuation, split on whitespace, drop the
  tokens ``a``, ``an``, ``the``.
* **exact match**: normalized token lists equal.
* **token precision / recall / F1**: multiset overlap ``sum(min(n_pred, n_gold))`` over
  tokens; if either side has no tokens the score is 1 when both are empty, else 0.
* **corpus BLEU**: whitespace tokens, n = 1..4, clipped n-gram matches and totals summed over
  the corpus, brevity penalty ``exp(1 - ref/sys)`` when ``sys < ref``, ``exp`` smoothing for
  an order without matches (precision ``100 / (2^k * total)``), geometric mean.
* **corpus chrF**: characters with whitespace removed, n = 1..6, clipped matches summed over
  the corpus; precision and recall per order averaged over orders that occur on both sides;
  ``F_beta`` with beta = 2, times 100.

Overlaps are counted inside the row and no gram leaves it. Token scores stay in the JVM: both sides'
tokens, tagged by side, are sorted together and one pass over them with a scalar state counts the
matches. Corpus scores take every order's grams of many rows at a time as sorted integer arrays
(Arrow batches, numpy); a task sends one row, three sums an order. Each scorer first spreads its input rows by ``idx`` over the shuffle partitions
(``plans.spread``), so normalizing, splitting and sorting run after that exchange in parallel, never
in the few tasks a small coalesced input arrives in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import WS_CLASS
from parlance.plans.spread import spread

# ---- Fixed values ---------------------------------------------------------------------------
ARTICLES = ["a", "an", "the"]
ASCII_PUNCT_RE = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"
BLEU_ORDER = 4
CHRF_ORDER = 6
CHRF_BETA = 2
# ---------------------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_tokens(text) -> Column:
    """``str.split()``: whitespace tokens, ``[]`` for a blank text (a split on whitespace runs
    leaves empty strings only at the ends; they are removed instead of stripping first)."""
    return F.array_remove(F.split(_c(text), WS_CLASS + "+"), "")


def normalize_tokens(text) -> Column:
    """SQuAD normalization to a token list."""
    t = F.regexp_replace(F.lower(_c(text)), ASCII_PUNCT_RE, "")
    return F.filter(ws_tokens(t), lambda x: ~x.isin(*ARTICLES))


def matches(pred, gold) -> Column:
    """``sum(min(n_pred, n_gold))`` over the elements of two string arrays: sorted together, an
    element's gold copies come before its predicted ones, and each predicted copy uses up a gold
    one while any is left."""
    def tag(x: Column, p: int) -> Column:
        return F.arrays_zip(x.alias("g"), F.array_repeat(F.lit(p), F.size(x)).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        left = F.when(acc["g"] == x["g"], acc["left"]).otherwise(0)
        is_pred = x["p"] == 1
        return F.struct(x["g"].alias("g"), F.when(is_pred, F.greatest(left - 1, F.lit(0))).otherwise(left + 1).alias("left"),
                        (acc["n"] + F.when(is_pred & (left > 0), 1).otherwise(0)).alias("n"))

    zero = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("left"), F.lit(0).alias("n"))
    both = F.sort_array(F.concat(tag(_c(gold), 0), tag(_c(pred), 1)))
    return F.aggregate(both, zero, step, lambda acc: acc["n"])


def token_overlap(df: DataFrame, idx: str, pred: str, gold: str) -> DataFrame:
    """Per example: ``idx, pred_len, gold_len, common, exact_match, precision, recall, f1``
    on normalized tokens. ``pred`` / ``gold`` are text columns."""
    toks = spread(df, idx).select(idx, normalize_tokens(pred).alias("_pt"), normalize_tokens(gold).alias("_gt"))
    j = toks.select(idx, F.size("_pt").alias("pred_len"), F.size("_gt").alias("gold_len"),
                    matches("_pt", "_gt").cast("long").alias("common"),
                    (F.array_join("_pt", " ") == F.array_join("_gt", " ")).cast("int").alias("exact_match"))
    either_empty = (F.col("pred_len") == 0) | (F.col("gold_len") == 0)
    both_empty = ((F.col("pred_len") == 0) & (F.col("gold_len") == 0)).cast("double")
    prec = F.when(either_empty, both_empty).otherwise(F.col("common") / F.col("pred_len"))
    rec = F.when(either_empty, both_empty).otherwise(F.col("common") / F.col("gold_len"))
    f1 = F.when(either_empty, both_empty).when(F.col("common") == 0, F.lit(0.0)).otherwise(
        2 * F.col("common") / (F.col("pred_len") + F.col("gold_len")))
    return j.select(idx, "pred_len", "gold_len", "common", "exact_match",
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def qa_summary(scores: DataFrame) -> DataFrame:
    """AGG-4..7 over per-example scores: one row of means (``avg_length`` = mean prediction
    length in normalized tokens)."""
    return scores.agg(F.count(F.lit(1)).alias("examples"),
                      F.avg("exact_match").alias("exact_match"), F.avg("recall").alias("token_recall"),
                      F.avg("f1").alias("token_f1"), F.avg("pred_len").alias("avg_length"))


def gram_sums(symbols: np.ndarray, row_side: np.ndarray, order: int) -> np.ndarray:
    """``(hyp, ref, match)`` of every order 1..``order``, summed over rows. ``symbols``: the rows' tokens or
    characters as integers, one after the other; ``row_side``: ``2 * row``, plus 1 on the gold side."""
    out = np.zeros((order, 3), np.int64)
    kinds, first = np.unique(symbols, return_inverse=True)
    gram = first
    for n in range(1, order + 1):
        if n > len(first):
            break
        if n > 1:  # a gram is the one a symbol shorter and its last symbol
            gram = np.unique(gram[:-1] * len(kinds) + first[n - 1:], return_inverse=True)[1]
        inside = row_side[:len(gram)] == row_side[n - 1:]
        where, g = row_side[:len(gram)][inside], gram[inside]
        key, gold = (where >> 1) * (len(gram) + 1) + g, (where & 1).astype(bool)
        (kp, cp), (kg, cg) = (np.unique(key[side], return_counts=True) for side in (~gold, gold))
        _, ip, ig = np.intersect1d(kp, kg, assume_unique=True, return_indices=True)
        out[n - 1] = cp.sum(), cg.sum(), np.minimum(cp[ip], cg[ig]).sum()
    return out


def _symbols(batch: pa.RecordBatch, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their ``row_side`` and their number in each row, both sides."""
    parts, sides, sizes = [], [], np.zeros(batch.num_rows, np.int64)
    for side, name in enumerate(("_p", "_g")):
        col = batch.column(name)
        if words:
            n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts.append(col.flatten())
        else:
            raw = [(t or "").encode("utf-32-le") for t in col.to_pylist()]
            n = np.array([len(r) // 4 for r in raw], np.int64)
            parts.append(np.frombuffer(b"".join(raw), "<u4").astype(np.int64))
        sizes += n
        sides.append(np.repeat(2 * np.arange(batch.num_rows) + side, n))
    if words:
        coded = pa.concat_arrays(parts).dictionary_encode()
        symbols = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        symbols = np.concatenate(parts)
    return symbols, np.concatenate(sides), sizes


#: Symbols of the rows that are counted together (one row is never cut).
_TOGETHER = 1 << 20


def _order_sums(t: DataFrame, order: int, words: bool) -> DataFrame:
    """One row of corpus sums over the columns ``_p`` and ``_g`` (token lists, or texts of characters):
    ``hyp<n>, ref<n>, match<n>`` for every order, and ``sys_len, ref_len``; nulls without rows."""
    names = [f"{c}{n}" for n in range(1, order + 1) for c in ("hyp", "ref", "match")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((order, 3), np.int64), False
        for b in batches:
            seen = seen or b.num_rows > 0
            symbols, row_side, sizes = _symbols(b, words)
            group = np.cumsum(sizes) // _TOGETHER
            for k in np.unique(group):
                rows = np.flatnonzero(group == k)
                mine = (row_side >= 2 * rows[0]) & (row_side <= 2 * rows[-1] + 1)
                total += gram_sums(symbols[mine], row_side[mine], order)
        if seen:
            yield pa.RecordBatch.from_pydict({c: [int(v)] for c, v in zip(names, total.ravel())})

    per_task = t.select("_p", "_g").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    sums = per_task.agg(*[F.sum(c).alias(c) for c in names])
    return sums.select(F.col("hyp1").alias("sys_len"), F.col("ref1").alias("ref_len"), "*")


def corpus_bleu(df: DataFrame, idx: str, pred: str, gold: str, order: int = BLEU_ORDER) -> DataFrame:
    """AGG-8 BLEU: one row ``(bleu, bp, sys_len, ref_len, p1..p4)``."""
    j = _order_sums(spread(df, idx).select(ws_tokens(pred).alias("_p"), ws_tokens(gold).alias("_g")), order, True)
    # exp smoothing: the k-th order without matches gets 100 / (2^k * total)
    precs, k = [], F.lit(0)
    for n in range(1, order + 1):
        hyp, match = F.coalesce(F.col(f"hyp{n}"), F.lit(0)), F.coalesce(F.col(f"match{n}"), F.lit(0))
        k = k + F.when((hyp > 0) & (match == 0), 1).otherwise(0)
        precs.append(F.when(hyp == 0, F.lit(None)).when(match == 0, 100.0 / (F.pow(F.lit(2.0), k) * hyp))
                     .otherwise(100.0 * match / hyp))
    # effective order: orders up to the first one with no n-grams at all
    logs = [F.log(p) for p in precs]
    avail = [F.coalesce(F.col(f"hyp{n}"), F.lit(0)) > 0 for n in range(1, order + 1)]
    eff, tot = F.lit(0), F.lit(0.0)
    alive = F.lit(True)
    for a, lg in zip(avail, logs):
        alive = alive & a
        eff = eff + F.when(alive, 1).otherwise(0)
        tot = tot + F.when(alive, lg).otherwise(0.0)
    sys_len, ref_len = F.col("sys_len"), F.col("ref_len")
    bp = F.when(sys_len >= ref_len, F.lit(1.0)).when(sys_len == 0, F.lit(0.0)).otherwise(F.exp(1 - ref_len / sys_len))
    # without a matching word, or without n-grams of some order, there is no score
    none = (eff < order) | (F.coalesce(F.col("match1"), F.lit(0)) == 0)
    bleu = F.when(none, F.lit(0.0)).otherwise(bp * F.exp(tot / eff))
    return j.select(bleu.alias("bleu"), bp.alias("bp"), sys_len.cast("long").alias("sys_len"),
                    ref_len.cast("long").alias("ref_len"), *[p.alias(f"p{n}") for n, p in enumerate(precs, 1)])


def corpus_chrf(df: DataFrame, idx: str, pred: str, gold: str, order: int = CHRF_ORDER,
                beta: float = CHRF_BETA) -> DataFrame:
    """AGG-8 chrF: one row ``(chrf, char_precision, char_recall)``."""
    t = spread(df, idx).select(F.regexp_replace(_c(pred), WS_CLASS, "").alias("_p"),
                               F.regexp_replace(_c(gold), WS_CLASS, "").alias("_g"))
    j = _order_sums(t, order, False)
    both = [(F.col(f"hyp{n}") > 0) & (F.col(f"ref{n}") > 0) for n in range(1, order + 1)]
    rates = lambda total: F.filter(F.array(*[F.when(ok, F.col(f"match{n}") / F.col(f"{total}{n}"))
                                             for n, ok in enumerate(both, 1)]), lambda x: x.isNotNull())
    mean = lambda r: F.when(F.size(r) > 0, F.aggregate(r, F.lit(0.0), lambda a, x: a + x) / F.size(r))
    avg = j.select(mean(rates("hyp")).alias("P"), mean(rates("ref")).alias("R"))
    b2 = beta * beta
    chrf = F.when(F.coalesce(F.col("P") + F.col("R"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(
        100.0 * (1 + b2) * F.col("P") * F.col("R") / (b2 * F.col("P") + F.col("R")))
    return avg.select(chrf.alias("chrf"), F.coalesce("P", F.lit(0.0)).alias("char_precision"),
                      F.coalesce("R", F.lit(0.0)).alias("char_recall"))
