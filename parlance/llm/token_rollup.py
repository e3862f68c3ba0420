"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A store is two Parquet folders: ``totals`` holds, for every commit, the sums of its signed rows;
``log`` names the commits that count. A commit writes its sums under an attempt of its own and
only then its log line, so a job that dies half-way leaves sums that no reader uses; a batch that
is already in the log is not written again, and if two writers race, readers use one attempt per
batch. Totals are additive: inserts add, deletes subtract, a revised count subtracts the old row
and adds the new one.

Defined results: null source, language or tokenizer are keys of their own; null counts are 0;
repeated rows count as often as they occur; groups whose documents and tokens are both 0 are left
out; a store without commits has no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import encoder, id_in, id_out

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "batch string, attempt string, source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_each(docs: DataFrame, counts: list[tuple[str, str, bool, Column | None]]) -> DataFrame:
    """``doc_id, source, lang`` and a count of ids per entry ``(name, vocabulary file, words, condition)``,
    all in one pass over the texts (a null text has none). Where a condition is given and does not
    hold, the text is not encoded and the count is null."""
    files = [(name, path, words) for name, path, words, _ in counts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encs = [(name, encoder(path, words)) for name, path, words in files]
        for pdf in batches:
            text = pdf.pop("text").tolist()
            for name, enc in encs:
                on = pdf[name].tolist()
                got = iter(enc.batch([t for t, k in zip(text, on) if k]))
                pdf[name] = pd.array([len(next(got)) // 4 if k else None for k in on], "Int64")
            yield pdf
    on = [F.lit(True) if c is None else F.coalesce(c, F.lit(False)) for _, _, _, c in counts]
    d = docs.select(id_in(), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                    *[c.alias(name) for (name, *_), c in zip(counts, on)], F.col("text").cast("string").alias("text"))
    return d.mapInPandas(run, "doc_id long, source string, lang string, " + ", ".join(f"{n} long" for n, *_ in counts)).withColumn(
        "doc_id", id_out())


def count_tokens(docs: DataFrame, vocab_file: str, words: bool, name: str = "n_tokens") -> DataFrame:
    """``doc_id, source, lang`` and the ids of each text (null: none)."""
    return count_each(docs, [(name, vocab_file, words, None)])


def inserts(rows: DataFrame, tokenizer: str, tokens: str = "n_tokens") -> DataFrame:
    """Signed rows ``source, lang, tokenizer, n_docs, n_tokens`` that add ``rows``."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"),
                       F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("n_tokens"))


def deletes(rows: DataFrame, tokenizer: str, tokens: str = "n_tokens") -> DataFrame:
    """Signed rows that take ``rows`` back."""
    return inserts(rows, tokenizer, tokens).select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(rows: DataFrame, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """Signed rows that replace counts: ``old`` and ``new`` are (tokenizer, column)."""
    return deletes(rows, *old).unionByName(inserts(rows, *new))


def create(spark: SparkSession, store: str) -> str:
    """An empty store."""
    spark.createDataFrame([], TOTALS).write.mode("overwrite").parquet(f"{store}/totals")
    spark.createDataFrame([], "batch string, attempt string").write.mode("overwrite").parquet(f"{store}/log")
    return store


def commit(store: str, batch: str, signed: DataFrame) -> bool:
    """Add a batch of signed rows once; False if the store has the batch already."""
    spark = signed.sparkSession
    log = spark.read.schema("batch string, attempt string").parquet(f"{store}/log")
    if not log.where(F.col("batch") == batch).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    sums = signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sums.select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), *KEYS, "n_docs", "n_tokens"
                ).write.mode("append").parquet(f"{store}/totals")
    spark.createDataFrame([(batch, attempt)], "batch string, attempt string").write.mode("append").parquet(f"{store}/log")
    return True


def rollup(spark: SparkSession, store: str) -> DataFrame:
    """Current totals ``source, lang, tokenizer, n_docs, n_tokens``."""
    log = spark.read.schema("batch string, attempt string").parquet(f"{store}/log").groupBy("batch").agg(F.min("attempt").alias("attempt"))
    t = spark.read.schema(TOTALS).parquet(f"{store}/totals").join(log, ["batch", "attempt"])
    return (t.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where("n_docs <> 0 or n_tokens <> 0"))
