"""One JSON array file read by many tasks.

A byte range of a JSON array can't be read by itself: whether its first byte lies inside a string, and
how deeply, depends on everything before it. So two passes go over the ranges, both in parallel:

1. each range gives what it does to the state of a reader that enters it outside a string, inside one,
   or after a backslash: the state at its end and the change of depth. These three facts compose, so
   the state at the start of every range follows from one sweep over one small row a range;
2. each range skips to the first record that begins in it and gives out the records that do, reading
   on past its end for the last one.

Borders may fall anywhere, also inside strings, escapes and characters of several bytes. Records are
the array's elements, objects as a rule; their text is handed to ``from_json``, so types and nulls are
Spark's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: A range is at most this long, and at least that long unless the file ends. A task holds a range about
#: seven times over (bytes, text, records), so the bound is also that of its memory.
MOST_BYTES, LEAST_BYTES = 4 << 20, 4 << 10
OUT, IN, ESCAPE = 0, 1, 2
_STRING = re.compile(rb'"(?:[^"\\]|\\.)*"', re.DOTALL)
_REST = re.compile(rb'(?:[^"\\]|\\.)*"', re.DOTALL)
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.DOTALL)


def open_store(path: str):
    """The file system of a path or address, and the path inside it."""
    if "://" in path or path.startswith("file:"):
        store, inner = fs.FileSystem.from_uri(path)
    else:
        store, inner = fs.LocalFileSystem(), path
    return store, inner


def can_open(path: str) -> bool:
    """Whether pyarrow knows the store of a path (it need not exist)."""
    try:
        store, inner = open_store(path)
        store.get_file_info(inner)
    except (ValueError, OSError):
        return False
    return True


def splittable(path: str) -> list[tuple[str, int]] | None:
    """``(path, bytes)`` of the files under ``path``; None where they are compressed or can't be opened here."""
    try:
        store, inner = open_store(path)
        info = store.get_file_info(inner)
    except (ValueError, OSError):
        return None
    if info.type == fs.FileType.NotFound:
        return None
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
    files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    if any(f.base_name.rsplit(".", 1)[-1] in ("gz", "bz2", "zst", "snappy", "lz4", "xz", "deflate") for f in files):
        return None
    return sorted((prefix + f.path, f.size) for f in files)


def effect(raw: bytes, state: int) -> tuple[int, int]:
    """The state at the end of ``raw`` and the change of depth, entering it in ``state``."""
    at = 0
    if state != OUT:
        at = min(len(raw), 1) if state == ESCAPE else 0
        if state == ESCAPE and not raw:
            return ESCAPE, 0
        m = _REST.match(raw, at)
        if m is None:
            return _inside(raw[at:]), 0
        at = m.end()
    bare = _STRING.sub(b"", raw[at:])
    cut = bare.find(b'"')
    end = OUT
    if cut >= 0:  # a string that does not end here
        end, bare = _inside(bare[cut + 1:]), bare[:cut]
    return end, bare.count(b"{") + bare.count(b"[") - bare.count(b"}") - bare.count(b"]")


def _inside(tail: bytes) -> int:
    """The state after part of a string without its end."""
    return ESCAPE if (len(tail) - len(tail.rstrip(b"\\"))) % 2 else IN


def _first(raw: bytes, state: int, depth: int) -> int | None:
    """Where the first element that begins in ``raw`` begins; None: in none of its bytes, as far as they go."""
    at = 0
    if state != OUT:
        m = _REST.match(raw, 1 if state == ESCAPE else 0)
        if m is None:
            return None
        at = m.end()
    for m in _TOKEN.finditer(raw, at):
        t = m.group()
        if t in (b"{", b"["):
            if depth == 1:
                return m.start()
            depth += 1
        elif t in (b"}", b"]"):
            depth -= 1
    return None


@dataclass
class _Text:
    """Bytes of a file from ``start`` on, read as far as needed."""
    source: object
    start: int
    size: int
    raw: bytes = b""

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.start + len(self.raw)
        if end > have:
            self.source.seek(have)
            self.raw += self.source.read(end - have)

    def more(self) -> bool:
        have = self.start + len(self.raw)
        self.upto(have + max(len(self.raw), LEAST_BYTES))
        return self.start + len(self.raw) > have


def records(source, size: int, start: int, end: int, state: int, depth: int) -> Iterator[str]:
    """Texts of the array's elements (objects or arrays) whose first byte lies in ``[start, end)``."""
    text = _Text(source, start, size)
    text.upto(end)
    at = _first(text.raw, state, depth)
    if at is None:
        return
    decode = json.JSONDecoder().raw_decode
    limit = len(text.raw[at:end - start].decode("utf-8", "ignore"))
    chars, i = text.raw[at:].decode("utf-8", "ignore"), 0
    while i < limit:
        try:
            _, stop = decode(chars, i)
        except json.JSONDecodeError:
            if not text.more():
                raise ValueError(f"not a JSON array of records near byte {start + at} of {size}") from None
            chars = text.raw[at:].decode("utf-8", "ignore")
            continue
        yield chars[i:stop]
        i = stop
        while i < limit and chars[i] in ", \t\r\n":
            i += 1
        if i < limit and chars[i] == "]":
            return


def ranges(files: list[tuple[str, int]], parallelism: int, range_bytes: int | None) -> list[tuple[str, int, int, int]]:
    """``(path, size, start, end)``: by bytes, a few ranges a core, within the two bounds."""
    total = sum(n for _, n in files)
    step = range_bytes or max(LEAST_BYTES, min(MOST_BYTES, total // (4 * parallelism) + 1))
    return [(p, n, a, min(n, a + step)) for p, n in files for a in range(0, n, step)]


def _pieces(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl).repartitionByRange(max(1, min(len(rows), 4096)), "i")


def read_records(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int | None = None) -> DataFrame:
    """``value``: the text of every record of the files."""
    cut = [(i, *r) for i, r in enumerate(ranges(files, spark.sparkContext.defaultParallelism, range_bytes))]
    if not cut:
        return spark.createDataFrame([], "value string")

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, path, a, b in zip(pdf["i"], pdf["path"], pdf["start"], pdf["stop"]):
                store, inner = open_store(path)
                with store.open_input_file(inner) as f:
                    f.seek(a)
                    raw = f.read(b - a)
                out.append((i, *[x for s in (OUT, IN, ESCAPE) for x in effect(raw, s)]))
            yield pd.DataFrame(out, columns=["i", "s0", "d0", "s1", "d1", "s2", "d2"])

    ddl = "i long, path string, size long, start long, stop long"
    seen = _pieces(spark, cut, ddl).mapInPandas(effects, "i long, s0 int, d0 long, s1 int, d1 long, s2 int, d2 long")
    does = {r["i"]: ((r["s0"], r["d0"]), (r["s1"], r["d1"]), (r["s2"], r["d2"])) for r in seen.collect()}  # a row a range
    entered, state, depth = [], OUT, 0
    for i, path, size, a, b in cut:
        if a == 0:
            state, depth = OUT, 0
        entered.append((i, path, size, a, b, state, depth))
        state, change = does[i][state]
        depth += change

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                store, inner = open_store(r.path)
                with store.open_input_file(inner) as f:
                    held, n = [], 0
                    for t in records(f, r.size, r.start, r.stop, r.state, r.depth):
                        held.append(t)
                        n += len(t)
                        if n > 4 << 20:
                            yield pd.DataFrame({"value": held})
                            held, n = [], 0
                    if held:
                        yield pd.DataFrame({"value": held})

    return _pieces(spark, entered, ddl + ", state int, depth long").mapInPandas(read, "value string")
