"""Integer vectors and sums over them, shared by centroid clustering and whitening."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(vector: Column, scale: int) -> Column:
    """``floor(scale * c)`` of every component, each taken as double, as longs."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def whole(vector: Column, scale: int, bound: float) -> Column:
    """Whether a vector is there, has no null or non-finite component, and its scaled components
    stay under ``bound``. NaN is above every number in Spark's order, so it fails the test too."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < bound, F.lit(False))),
                      F.lit(False))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """The batch's vectors, all of one length, as rows."""
    col = batch.column(column)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def summed(df: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], kind: str) -> np.ndarray | None:
    """Sum of ``partial`` (numbers of one shape) over the batches of ``df``; None without rows.
    A task sends one row, rows are added by position in Spark, and the driver reads as many
    numbers as ``partial`` has. ``kind``: ``long`` (added exactly, returned as Python ints; a
    task's own sums must fit a long) or ``double``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                p = partial(b)
                total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total], pa.list_(pa.int64() if kind == "long" else pa.float64()))})

    each = df.mapInArrow(run, f"v array<{kind}>").select(F.posexplode("v").alias("pos", "v"))
    got = each.groupBy("pos").agg(F.sum(F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")).alias("v")).collect()
    if not got:
        return None
    out = [0] * len(got)
    for r in got:
        out[r["pos"]] = int(r["v"]) if kind == "long" else r["v"]
    return np.array(out, object if kind == "long" else np.float64)
