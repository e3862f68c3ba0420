"""What the operators share: session preparation, input columns, cached chunk encoders."""

from __future__ import annotations

import re
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import ship_package
from parlance.sources.io import materialize  # noqa: F401  (written table in spark.checkpoint.dir)

#: Rows per Arrow batch: bounds a worker's memory when texts are long.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the Python workers and bound Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_NO_ID = -(1 << 63)


def id_in(c: str = "doc_id") -> Column:
    """A long id without nulls, so that pandas keeps it whole (null: the least long)."""
    return F.coalesce(F.col(c).cast("long"), F.lit(_NO_ID)).alias(c)


def id_out(c: str = "doc_id") -> Column:
    return F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: it becomes a lambda variable, so nested
    lambdas read it instead of carrying a copy of its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokenizer_path(name: str) -> str:
    """Place of an installed public vocabulary file (an absolute path is returned as it is)."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


#: White space outside ASCII, where the chunk rule below is not used.
_WIDE_SPACE = re.compile("[" + "".join(map(chr, (
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
#: Runs of non-space with the one space before them; of ASCII letters with symbols after them, the letters
#: apart, as no token joins the two.
_SPACED = re.compile(rb" ?[A-Za-z]++(?=[!-/:-@\[-`{-~]*+(?:\s|\Z))| ?[^\s]+|\s+(?!\S)|\s+")


_LETTERS = re.compile(rb" ?[A-Za-z]+")
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: What stands for a space in byte-level vocabularies (fixed value).
_SPACE_SIGN = "\u0120"
#: ASCII symbols at the end of a chunk.
_TAIL = re.compile(rb"[!-/:-@\[-`{-~]+$")


class ChunkEncoder:
    """Whole texts to ids, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Neither vocabulary has a token across white space, so a text's ids are those of its chunks
    (``words``: runs of non-space; otherwise runs with the one space before them), and chunks
    are encoded once as long as the worker remembers them. ASCII symbols after a run of ASCII letters are a
    chunk of their own (not for ``words``), so a word is remembered once whatever follows it. It remembers the chunks met since the
    last two times that ``limit`` new ones had come in, so rare chunks pass and memory stays
    bounded. A new chunk of ASCII letters is one word to the tokenizer's pre-tokenizer, so its model
    is asked directly; others go through the whole tokenizer, many at a time. Texts in which the chunk rule may not hold (a special token's string, wide white
    space) are encoded whole.
    """

    def __init__(self, path: str, words: bool, limit: int = 800_000):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_path(path))
        self.words, self.limit = words, limit
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # encoded by itself beside any chunk, as it has no letter and ends at white space
        self.mark = b"\x01" if words else b"\n"
        self.between = b" \x01 " if words else b"\n"
        self.mark_id, = self.tok.encode(self.mark.decode(), add_special_tokens=False).ids
        self.special = [a.content.encode() for a in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        probe = ["hello", "zqxjk"] if words else ["hello", " hello", " Zqxjk", "ZQ"]
        self.direct = all(self._word(w.encode()) == self._pack([w])[0] for w in probe)

    def _word(self, chunk: bytes) -> bytes:
        """Ids of ASCII letters, with one space before them or not, by the model alone."""
        text = chunk.decode()
        if text[0] == " ":
            text = _SPACE_SIGN + text[1:]
        ids = [t.id for t in self.model.tokenize(text)]
        return _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else np.array(ids, "<u4").tobytes()

    def _pack(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, chunk: bytes) -> tuple[bytes, ...]:
        """A chunk as word and the symbols after it, which no token joins to a letter or digit."""
        m = _TAIL.search(chunk)
        if m and m.start() and (last := chunk[:m.start()].decode()[-1]).isalpha() | (last.isascii() and last.isdigit()):
            core = chunk[:m.start()]
            return core.lower() if self.words else core, m.group()
        return (chunk.lower() if self.words else chunk,)

    def _learn(self, chunks: set[bytes]) -> None:
        """Put the chunks' ids into ``new``, from ``old`` or by the tokenizer, many at a time."""
        new, old = self.new, self.old
        letters = _LETTERS.fullmatch if self.direct else lambda c: None
        made, need = {}, set()
        for c in chunks:
            if (v := old.get(c)) is not None:
                new[c] = v
            elif letters(c):
                low = c.lower() if self.words else c
                if (v := new.get(low) or old.get(low)) is None:
                    v = self._word(low)
                new[c] = new[low] = v
            else:
                made[c] = p = self._parts(c)
                need.update(p)
        todo = []
        for c in need:
            if c not in new:
                if (v := old.get(c)) is not None:
                    new[c] = v
                else:
                    todo.append(c)
        if self.direct:
            plain = [c for c in todo if letters(c)]
            new.update(zip(plain, map(self._word, plain)))
            todo = [c for c in todo if c not in new]
        alone = [c for c in todo if self.mark in c or c.isspace()]
        new.update(zip(alone, self._pack([c.decode() for c in alone])))
        if alone:
            todo = [c for c in todo if c not in new]
        if todo:
            # many at once, told apart by the mark's one id
            texts = [self.between.join(todo[i:i + 500]).decode() for i in range(0, len(todo), 500)]
            some = iter(todo)
            for e in self.tok.encode_batch_fast(texts, add_special_tokens=False):
                ids = np.array(e.ids, "<u4")
                raw, at = ids.tobytes(), 0
                for end in np.flatnonzero(ids == self.mark_id).tolist():
                    new[next(some)] = raw[at:4 * end]
                    at = 4 * end + 4
                new[next(some)] = raw[at:]
        for c, p in made.items():
            new[c] = b"".join([new[x] for x in p])

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none)."""
        out: list[bytes] = []
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size > 2_000_000:
                out += self._some(held)
                held, size = [], 0
        return out + self._some(held)

    def _some(self, texts: list[str | None]) -> list[bytes]:
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        known, cut, whole = self.new, [], []
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            if any(s in raw for s in self.special) or \
                    (not self.words and len(raw) != len(text or "") and _WIDE_SPACE.search(text)):
                whole.append(i)
                raw = b""
            cut.append(raw.split() if self.words else _SPACED.findall(raw))
        if missing := set().union(*cut).difference(known):
            self._learn(missing)
        get = known.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in cut]
        for i in whole:
            out[i] = self._pack([texts[i]])[0]
        return out


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, words: bool) -> ChunkEncoder:
    """The worker's encoder of a vocabulary file (Python workers are used for many tasks)."""
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = ChunkEncoder(path, words)
    return _ENCODERS[path, words]
