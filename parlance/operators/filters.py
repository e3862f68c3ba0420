"""Filters and predicates (FLT-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Error text that marks a terminal (non-retryable) content-filter failure.
CONTENT_FILTER_PATTERN = "InvalidRequestError|filtered"


def subset_filter(df: DataFrame, column: str, value) -> DataFrame:
    """FLT-1: keep the rows of one dataset value (a Parquet pushed filter)."""
    return df.filter(F.col(column) == F.lit(value))


def empty_user_guard(last_role, last_content) -> Column:
    """FLT-2: true when the call must be skipped: the last message is a user message whose
    content is null (an empty string still calls)."""
    r = F.col(last_role) if isinstance(last_role, str) else last_role
    c = F.col(last_content) if isinstance(last_content, str) else last_content
    return F.coalesce((r == "user") & c.isNull(), F.lit(False))


def human_agents(agents: DataFrame, flag: str = "is_human") -> DataFrame:
    """FLT-3: human participants only (a null flag is not human)."""
    return agents.filter(F.coalesce(F.col(flag), F.lit(False)))


def is_content_filtered(error) -> Column:
    """FLT-4: the error text marks a content-filter refusal (terminal, no retry)."""
    e = F.col(error) if isinstance(error, str) else error
    return F.coalesce(e.rlike(CONTENT_FILTER_PATTERN), F.lit(False))
