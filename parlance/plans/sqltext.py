"""Helpers that write DuckDB SQL text for the oracle checks (the SQL mirrors each operator)."""

from __future__ import annotations

from parlance.functions.text import STRIP_RE, WS_CLASS


def lit(s: str) -> str:
    """A DuckDB string expression for ``s`` (newlines via ``chr(10)``)."""
    parts = s.split("\n")
    q = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(q) + ")" if len(q) > 1 else q[0]


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{STRIP_RE}', '', 'g')"


def md5_key(*parts: str, seed=None) -> str:
    pieces = ([f"'{seed}:'"] if seed is not None else [])
    for i, p in enumerate(parts):
        if i:
            pieces.append("':'")
        pieces.append(f"CAST({p} AS VARCHAR)")
    return "md5(" + " || ".join(pieces) + ")"


def tokens(expr: str) -> str:
    """DuckDB twin of ``operators.tokens.split_tokens``."""
    from parlance.operators.tokens import NO_RETRIEVAL_PLACEHOLDER, SPECIAL_RE
    ph = NO_RETRIEVAL_PLACEHOLDER.replace(" ", "' || chr(160) || '")
    t = f"replace({expr}, '<No Retrieval>', '{ph}')"
    t = strip(f"regexp_replace({t}, '{SPECIAL_RE}', ' \\1 ', 'g')")
    return (f"(CASE WHEN {t} = '' THEN []::VARCHAR[] "
            f"ELSE string_split_regex({t}, '{WS_CLASS}+') END)")


def ints(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"
