"""Batches, padding, masks and shards (BAT-*). One window by ``batch_id`` serves all pads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.tokens import IGNORE_INDEX, PAD_ID


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def assign_batches(df: DataFrame, index: str, size: int, out: str = "batch_id",
                   one_based: bool = True) -> DataFrame:
    """BAT-1: contiguous batches of ``size`` rows in ``index`` order; the last may be short."""
    i = F.col(index) - (1 if one_based else 0)
    return df.withColumn(out, F.floor(i / size).cast("long"))


def batch_width(ids, batch: str = "batch_id") -> Column:
    """Longest row of the batch (window over one batch: at most ``size`` rows)."""
    return F.max(F.size(_c(ids))).over(Window.partitionBy(batch))


def pad_right(arr, width, value) -> Column:
    """BAT-2 / BAT-3: append ``value`` up to ``width``."""
    arr = _c(arr)
    return F.concat(arr, F.array_repeat(F.lit(value), F.greatest(_c(width) - F.size(arr), F.lit(0))))


def pad_left(arr, width, value) -> Column:
    """BAT-5: prepend ``value`` up to ``width`` (generation-side padding)."""
    arr = _c(arr)
    return F.concat(F.array_repeat(F.lit(value), F.greatest(_c(width) - F.size(arr), F.lit(0))), arr)


def attention_mask(padded_ids, pad_id: int = PAD_ID, mode: str = "parity", length=None) -> Column:
    """BAT-4: 1 where attended.

    ``parity``: ``id != pad_id`` like the reference (when pad = eos, real eos tokens are masked
    too); ``by_length``: the first ``length`` positions (right padding) are 1.
    """
    ids = _c(padded_ids)
    if mode == "parity":
        return F.transform(ids, lambda x: (x != pad_id).cast("int"))
    if mode == "by_length":
        return F.transform(ids, lambda x, i: (i < _c(length)).cast("int"))
    raise ValueError(mode)


def pad_batch(df: DataFrame, ids: str = "ids", labels: str | None = "labels",
              batch: str = "batch_id", pad_id: int = PAD_ID, side: str = "right",
              mask_mode: str = "parity") -> DataFrame:
    """BAT-2..5 in one window: padded ids, labels (-100) and attention mask."""
    pad = pad_right if side == "right" else pad_left
    out = df.withColumn("_width", batch_width(ids, batch)).withColumn("_len", F.size(ids))
    out = out.withColumn(ids, pad(ids, "_width", pad_id))
    if labels:
        out = out.withColumn(labels, pad(labels, "_width", IGNORE_INDEX))
    if mask_mode == "by_length" and side == "left":
        mask = F.transform(F.col(ids), lambda x, i: (i >= F.col("_width") - F.col("_len")).cast("int"))
    else:
        mask = attention_mask(ids, pad_id, mask_mode, "_len")
    return out.withColumn("attention_mask", mask).drop("_width", "_len")


def strided_shard(df: DataFrame, index: str, world: int, keep_tail: bool = False,
                  out: str = "shard", n: int | None = None) -> DataFrame:
    """BAT-6: rank r takes rows ``i*W + r`` (0-based ``index``); the last ``n % W`` rows are
    dropped like the reference unless ``keep_tail``. ``n``: the number of rows where it is known (a
    rank index has it); else ``df`` is counted, which runs its plan once more."""
    res = df.withColumn(out, F.pmod(F.col(index), F.lit(world)).cast("int"))
    if keep_tail:
        return res
    if n is not None:
        return res.filter(F.col(index) < n // world * world)
    total = df.agg(F.count(F.lit(1))).scalar()  # scalar subquery: one value, no row fan-out
    return res.filter(F.col(index) < F.floor(total / world) * world)
