"""String and array helpers with Python semantics, built from Spark SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes (``str.isspace``), written as a
# regex class both Java regex and RE2 accept.
WS_CLASS = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

# The same class for DuckDB oracle SQL (RE2 needs the 'g' flag to replace globally).
STRIP_RE = f"^{WS_CLASS}+|{WS_CLASS}+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace (Spark ``trim`` drops spaces only)."""
    return F.regexp_replace(_c(c), STRIP_RE, "")


def strip_newlines(c) -> Column:
    """Python ``str.strip("\\n")``."""
    return F.regexp_replace(_c(c), r"^\n+|\n+$", "")


def safe_slice(arr, start, length) -> Column:
    """``arr[start-1 : start-1+length]`` with Python clamping.

    Spark's ``slice`` raises on a negative length and returns ``[]`` past the end; the length
    is clamped to ``greatest(size - start + 1, 0)`` and to ``>= 0``.
    """
    arr = _c(arr)
    start = start if isinstance(start, Column) else F.lit(start)
    length = length if isinstance(length, Column) else F.lit(length)
    room = F.greatest(F.size(arr) - start + 1, F.lit(0))
    return F.slice(arr, start, F.greatest(F.least(length, room), F.lit(0)))


def ints_to_text(arr, sep: str = " ") -> Column:
    """Join an int array into text (oracle-friendly rendering of id/label/mask arrays)."""
    return F.array_join(_c(arr).cast("array<string>"), sep)


def md5_key(*parts, seed=None) -> Column:
    """Deterministic order key ``md5('<seed>:p1:p2...')``; same value in DuckDB."""
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    pieces = []
    if seed is not None:
        pieces.append(F.lit(f"{seed}:"))
    for i, c in enumerate(cols):
        if i:
            pieces.append(F.lit(":"))
        pieces.append(c.cast("string"))
    return F.md5(F.concat(*pieces))


def url_quote(c) -> Column:
    """Python ``urllib.parse.quote(s)`` (safe '/'): form-encoding plus four fixes."""
    e = F.url_encode(_c(c))
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("%2F"), F.lit("/"))
    e = F.replace(e, F.lit("%7E"), F.lit("~"))
    return F.replace(e, F.lit("*"), F.lit("%2A"))


def explode_rows(df: DataFrame, keep: list, arr, value: str, pos: str | None = None) -> DataFrame:
    """``df.select(*keep, explode(arr))`` (or ``posexplode`` when ``pos`` is named), without
    moving the work that computes ``arr``.

    For an inner ``explode`` Catalyst infers ``size(arr) > 0`` and pushes that filter down
    through projections and repartitions, so an expensive ``arr`` (tokens, n-grams) is also
    evaluated below a ``spread`` exchange, in the few tasks it was meant to avoid. The outer
    form infers no filter; the one row it emits for an empty or null array (position null)
    is dropped right after, which leaves exactly ``explode``'s rows.
    """
    p = pos or "_xr_pos"
    out = df.select(*keep, F.posexplode_outer(_c(arr)).alias(p, value)).filter(F.col(p).isNotNull())
    return out if pos else out.drop(p)
