"""Column-level helpers shared by all operators (JVM-side, codegen friendly)."""

from parlance.functions.text import (  # noqa: F401
    WS_CLASS, py_strip, strip_newlines, safe_slice, ints_to_text, md5_key, url_quote,
)
