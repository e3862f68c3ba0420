"""Quality rules: base statistics of a text, and a decision list learned from labelled rows.

Everything is Spark SQL: statistics are expressions over the text, a rule is grown from one
histogram aggregation per condition, and the list leaves as one ``CASE`` expression. The driver
sees only histograms (features x ``BINS`` rows) and never a document.

Defined results: a null or empty text has no words and fails the base test; a document with
several labels counts by their mean (below one half: bad); labels without a document, and null
labels, are ignored; rows with a null or repeated doc_id are judged by their own text; without
both classes among the labels the list is empty and only the base test rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import let, materialize

#: White space of the word rule (words are ``[^\x20\x09-\x0D]+``).
SPACE_RE, WORD_RE = r"[ \t-\r]+", r"[^ \t-\r]"
SYMBOLS_RE = r"[#*$%&|<>]+"
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: Thresholds tried per feature (quantiles of the labelled rows).
BINS = 32
MAX_RULES, MAX_CONDITIONS = 12, 4
#: A rule is kept if at least this share of the held-out rows it rejects are bad, and at least
#: this share of all bad rows that rules grow on is newly covered.
MIN_PRECISION, MIN_SHARE = 0.9, 0.005


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array. Window positions are
    sorted by the window's 64-bit hash; equal neighbours are repeats."""
    windows = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(by_hash, lambda s: F.filter(s, lambda p, j: F.coalesce(
            p["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(p["h"] == F.get(s, j + 1)["h"], F.lit(False))))
        starts = F.sort_array(F.transform(again, lambda p: p["i"]))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - p, F.lit(3)))),
            F.lit(0), lambda a, x: a + x))

    h = F.slice(windows, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return let(h, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(covered(v)))


def text_stats(text: Column) -> Column:
    """Struct of the base statistics (all long)."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def stats(words: Column, lines: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"),
                        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS_RE, ""))).cast("long").alias("n_symbols"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                        n_repeat_words(words).cast("long").alias("n_repeat_words"),
                        F.size(lines).cast("long").alias("n_lines"))
    words = F.array_remove(F.split(text, SPACE_RE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_RE))
    return let(words, lambda w: let(lines, lambda ln: stats(w, ln)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def features() -> dict[str, Column]:
    """Integer features of the statistics' columns (shares per thousand)."""
    c, w = F.col, F.greatest(F.col("n_words"), F.lit(1))
    share = lambda a, b: F.floor(1000 * a / b)
    return {"n_words": c("n_words"), "word_length": share(c("word_chars"), w), "symbols": share(c("n_symbols"), w),
            "dup_lines": share(c("n_dup_lines"), F.greatest(c("n_lines"), F.lit(1))),
            "repeats": share(c("n_repeat_words"), w), "line_words": share(w, F.greatest(c("n_lines"), F.lit(1)))}


Rule = list[tuple[str, str, int]]  # conditions (feature, "<=" or ">", threshold)


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, op, at in rule:
        f = features()[name]
        out = out & ((f > at) if op == ">" else (f <= at))
    return out


def any_of(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | holds(r)
    return out


def decision(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule of the list that holds, else 0."""
    out = F.lit(0)
    for i in range(len(rules), 0, -1):
        out = F.when(holds(rules[i - 1]), i).otherwise(out)
    return out


def _below(value: Column):
    return lambda cut: cut < value


def _counts(rows: DataFrame, cuts: dict[str, list[int]]) -> dict[str, list[tuple[int, int]]]:
    """``{feature: [(bad, good) per bin]}`` by one partial aggregation over (feature, bin)."""
    fs = features()
    bins = [F.struct(F.lit(n).alias("f"), F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in cuts[n]]),
            _below(fs[n]))).alias("b")) for n in cuts]
    got = (rows.select("bad", F.explode(F.array(*bins)).alias("s")).groupBy("s.f", "s.b")
           .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect())
    out = {n: [(0, 0)] * (len(cuts[n]) + 1) for n in cuts}
    for r in got:
        out[r["f"]][r["b"]] = (r["p"], r["n"])
    return out


def _best(counts: dict[str, list[tuple[int, int]]], cuts: dict[str, list[int]]) -> tuple[float, tuple | None]:
    """The condition with the largest gain (bad rows kept x growth of the log share of bad rows)."""
    from math import log2
    first = next(iter(counts.values()))
    p0, n0 = sum(p for p, _ in first), sum(n for _, n in first)
    best, ties = 0.0, []
    if not p0:
        return best, None
    for name, bins in counts.items():
        p = n = 0
        for i, x in enumerate(cuts[name]):
            p, n = p + bins[i][0], n + bins[i][1]
            for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                gain = a * (log2(a / (a + b)) - log2(p0 / (p0 + n0))) if a else 0.0
                if gain > best + 1e-9:
                    best, ties = gain, []
                if gain > 1e-9 and abs(gain - best) <= 1e-9 and (not ties or ties[0][:2] == (name, op)):
                    ties.append((name, op, x))
    # equal thresholds: the middle of the gap between the classes
    return best, ties[len(ties) // 2] if ties else None


def learn(stats: DataFrame, labels: DataFrame, max_rules: int = MAX_RULES,
          min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Sequential covering: grow a conjunction condition by condition on two thirds of the
    labelled rows, prune trailing conditions on the rest, keep it if it is precise there, remove
    the rows it covers, repeat. ``stats``: a written table with doc_id and the statistics."""
    votes = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").alias("_label_id")).agg((F.avg("quality") < 0.5).cast("int").alias("bad")))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    rows = stats.where(~base_failed()).join(votes, F.col("doc_id") == F.col("_label_id")).select(
        "bad", *cols, (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"))
    rows = materialize(rows, "labelled")
    grow, held = rows.where(~F.col("held")), rows.where("held")
    fs = features()
    names, share = list(fs), [i / BINS for i in range(BINS)]
    q = grow.agg(F.sum("bad").alias("bad"), *[F.percentile_approx(fs[n], share, 1000).alias(f"q_{n}") for n in names]).first()
    if not q["bad"]:
        return []
    cuts = {n: sorted({int(x) for x in q[f"q_{n}"]}) for n in names}
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rest = grow.where(~any_of(rules))
        rule: Rule = []
        while len(rule) < MAX_CONDITIONS:
            counts = _counts(rest.where(holds(rule)), cuts)
            first = next(iter(counts.values()))
            if not sum(n for _, n in first):
                break
            gain, at = _best(counts, cuts)
            if at is None:
                break
            rule.append(at)
        if not rule:
            break
        ends = range(1, len(rule) + 1)
        open_ = held.where(~any_of(rules))
        got = open_.agg(*[F.sum(F.when(holds(rule[:k]), F.col("bad"))).alias(f"p{k}") for k in ends],
                        *[F.sum(F.when(holds(rule[:k]), 1 - F.col("bad"))).alias(f"n{k}") for k in ends]).first()
        worth = lambda k: ((got[f"p{k}"] or 0) - (got[f"n{k}"] or 0)) / max(1, (got[f"p{k}"] or 0) + (got[f"n{k}"] or 0))
        k = max(ends, key=lambda k: (round(worth(k), 3), -k))
        p, n = got[f"p{k}"] or 0, got[f"n{k}"] or 0
        if p < MIN_SHARE * q["bad"] / 2 or p < min_precision * (p + n):
            break
        rules.append(rule[:k])
    return rules


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``rule`` (the rule that rejects, or 0)
    and ``kept`` per row of ``docs``."""
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.expr("text").alias("text")).select("doc_id", text_stats(F.col("text")).alias("s"))
    stats = materialize(stats.select("doc_id", "s.*"), "text-stats")
    rules = learn(stats, labels.select("doc_id", "quality"))
    return (stats.withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Rows are written once with
    their statistics: the rules are learned from the written statistics and applied to the same
    table, so no text is measured twice and nothing is joined back."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      F.col("doc_id").cast("long").alias("doc_id"), text_stats(F.col("text")).alias("s"))
    measured = materialize(row.select("row", "doc_id", "s.*"), "text-stats")
    rules = learn(measured.drop("row"), labels.select("doc_id", "quality"))
    return measured.where(~base_failed() & (decision(rules) == 0)).select("row.*")
