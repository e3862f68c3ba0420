"""The user-function surface (UDF-2; UDF-1 is ``tools.ToolRegistry``, UDF-3 the generator
factory of ``generate``).

``batched_map`` runs a pandas function over fixed-size batches of rows - Arrow transfer, one
Python worker per task, never per-row calls - and replaces the input columns with the
function's output (``remove_columns`` of a batched dataset map).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def batched_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                batch_size: int = 1000) -> DataFrame:
    """UDF-2: ``fn`` sees batches of ``batch_size`` rows of a partition (the last may be
    short) and returns rows of ``schema``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buf = None
        for pdf in batches:
            buf = pdf if buf is None else pd.concat([buf, pdf], ignore_index=True)
            while len(buf) >= batch_size:
                yield fn(buf.iloc[:batch_size].reset_index(drop=True))
                buf = buf.iloc[batch_size:].reset_index(drop=True)
        if buf is not None and len(buf):
            yield fn(buf)
    return df.mapInPandas(run, schema)
