"""SentencePiece encoding and decoding, giant texts by a max-plus parallel scan.

A unigram model's ids are the path of largest score through the pieces that match the text. A
giant text is cut into chunks. For a chunk, the state at its edge is how many of its first
characters a piece from the chunk before has taken; the chunk's transfer matrix holds the best
score from every entry state to every exit state. Matrices combine associatively in the max-plus
semiring, the best states at all edges follow, and every chunk is backtraced by itself between
its two states. Scores are added in double precision; of equal scores the path whose last piece
is longer wins, as in the library.

No path crosses a place between two characters that no piece holds side by side, so within a chunk
the parts between such places are solved alone and remembered.

A BPE model (merges ranked by score) is not a sum of scores: its ids are not a best path, and the
scan cannot give them. For such a model ``ids`` are made by its merges, word by word, by the
library, and ``path`` holds the best path over the same pieces and scores, which the scan gives.

Defined results: a null or empty text has no ids; characters without a piece become their bytes'
pieces, if the model has them, else the unknown id; equal texts give equal rows; null doc_ids stay
null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import id_in, id_out, materialize, tokenizer_path

SPACE = "▁"
#: Characters of a chunk; longer texts are scanned in chunks.
CHUNK = 1 << 15
_LOW = -1e300
# fixed values of the model file's format: kinds of pieces, and of models
_NORMAL, _UNKNOWN, _USER, _BYTE, _UNIGRAM, _BPE = 1, 2, 4, 6, 1, 2
#: What the library subtracts from the least score for a character without a piece.
_UNKNOWN_PENALTY = 10.0
#: Characters with a column in the table of the trie (the most frequent in pieces), words that are solved at
#: once in it, and their most characters; other words are solved one by one.
COLUMNS, TOGETHER, SHORT = 127, 4096, 64
#: Characters of the texts whose words are learned at a time.
TEXTS = 1_000_000


class Model:
    """Pieces, scores and the path solver of a model file whose normalizer is the identity."""

    def __init__(self, path: str, limit: int = 200_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        raw = open(tokenizer_path(path), "rb").read()
        m = pb.ModelProto()
        m.ParseFromString(raw)
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are read")
        self.bpe, self.prefix = m.trainer_spec.model_type == _BPE, m.normalizer_spec.add_dummy_prefix
        if not self.bpe and m.trainer_spec.model_type != _UNIGRAM:
            raise ValueError("only unigram and BPE models are read")
        m.normalizer_spec.add_dummy_prefix = False  # parts of an escaped text are encoded as they are
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString()) if self.bpe else None
        self.piece = {p.piece: (float(p.score), i) for i, p in enumerate(m.pieces) if p.type in (_NORMAL, _USER)}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == _BYTE}
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.encode() if p.type in (_NORMAL, _USER) else b""
                         for p in m.pieces]
        self.bytes_in = np.array([len(x) for x in self.bytes_of])
        self.unknown = next((i for i, p in enumerate(m.pieces) if p.type == _UNKNOWN), 0)
        # a node: its children by character, and the piece that ends there
        self.trie: list = [{}, None]
        for p, got in self.piece.items():
            node = self.trie
            for c in p:
                node = node[0].setdefault(c, [{}, None])
            node[1] = got
        # no path and no merge crosses a place between two characters that no piece holds side by side
        self.inner = {p[i:i + 2] for p in self.piece for i in range(len(p) - 1)}
        self.longest = max(map(len, self.piece), default=1)
        self.penalty = min((s for s, _ in self.piece.values()), default=0.0) - _UNKNOWN_PENALTY
        # a word's start (a space after another character) is never inside a piece
        self.words = not any(x[0] != SPACE and x[1] == SPACE for x in self.inner)
        self.limit, self.new, self.old = limit, {}, {}
        self._tabulate()

    def _tabulate(self) -> None:
        """The trie as a table (node and column of the character to the node below; 0: none, 1: the root),
        and which columns some piece holds side by side."""
        chars = [c for c, _ in Counter(c for p in self.piece for c in p).most_common(COLUMNS)]
        self.column = np.zeros(0x110000, np.uint8)
        self.column[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        nodes, below = [self.trie], []
        for at, node in enumerate(nodes, 1):
            for c, child in node[0].items():
                if k := self.column[ord(c)]:
                    nodes.append(child)
                    below.append((at, k, len(nodes)))
        self.below = np.zeros((len(nodes) + 1, len(chars) + 1), np.int32)
        if below:
            at, k, child = np.array(below).T
            self.below[at, k] = child
        self.at_node = np.array([-1] + [n[1][1] if n[1] else -1 for n in nodes], np.int32)
        self.node_score = np.array([0.0] + [n[1][0] if n[1] else 0.0 for n in nodes])
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for x in self.inner:
            self.beside[self.column[ord(x[0])], self.column[ord(x[1])]] = True

    def escaped(self, text: str | None) -> str:
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def arcs(self, text: str, i: int) -> list[tuple[int, float, int]]:
        """``(end, score, id)`` of the pieces that start at ``i`` (id -1: a character without one)."""
        out, node, single = [], self.trie, False
        for j in range(i, min(len(text), i + self.longest)):
            node = node[0].get(text[j])
            if node is None:
                break
            if (got := node[1]) is not None:
                out.append((j + 1, *got))
                single |= j == i
        if not single:
            out.append((i + 1, self.penalty, -1))
        return out

    def spell(self, text: str, i: int, j: int, id_: int) -> list[int]:
        if id_ >= 0:
            return [id_]
        return [self.byte[b] for b in text[i:j].encode()] if len(self.byte) == 256 else [self.unknown]

    def best(self, text: str, start: int, end: int) -> tuple[float, list[int]]:
        """Best path over ``text[start:end]``."""
        n, root, longest = end - start, self.trie[0], self.longest
        score, back, piece = [_LOW] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        for i in range(n):
            s = score[i]
            if s == _LOW:
                continue
            below, j, single = root, i, False
            for c in text[start + i:min(end, start + i + longest)]:
                node = below.get(c)
                if node is None:
                    break
                j += 1
                below, got = node
                if got is not None:
                    if (x := s + got[0]) > score[j]:
                        score[j], back[j], piece[j] = x, i, got[1]
                    if j == i + 1:
                        single = True
            if not single and s + self.penalty > score[i + 1]:
                score[i + 1], back[i + 1], piece[i + 1] = s + self.penalty, i, -1
        out, at = [], n
        while at > 0:
            if back[at] < 0:
                return _LOW, []
            out.append((back[at], at, piece[at]))
            at = back[at]
        ids = []
        for i, j, id_ in reversed(out):
            ids += [id_] if id_ >= 0 else self.spell(text, start + i, start + j, id_)
        return score[-1], ids

    def best_many(self, parts: list[str]) -> list[tuple[float, bytes]]:
        """``best`` of whole parts, ids packed: short parts of characters with a column step through the
        table together, some of similar length at a time."""
        out: list = [None] * len(parts)
        if len(parts) >= 16:
            size = np.array([len(p) for p in parts])
            cols = self.column[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
            start = np.cumsum(size) - size
            none = np.r_[0, np.cumsum(cols == 0)]
            some = np.flatnonzero((size > 0) & (size <= SHORT) & (none[start + size] == none[start]))
            some = some[np.argsort(-size[some], kind="stable")]
            for k in range(0, len(some), TOGETHER):
                at = some[k:k + TOGETHER]
                for i, got in zip(at.tolist(), self._together(cols, start[at], size[at])):
                    out[i] = got
        for i, p in enumerate(parts):
            if out[i] is None:
                score, path = self.best(p, 0, len(p))
                out[i] = score, np.array(path, "<u4").tobytes()
        return out

    def _together(self, cols: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[float, bytes] | None]:
        """Best paths of parts in order of falling size (None: over a character without a piece)."""
        w, n = len(size), int(size[0])
        text = np.zeros((n + self.longest, w), np.uint8)
        for i in range(n):
            k = int(np.searchsorted(-size, -i))
            text[i, :k] = cols[start[:k] + i]
        score, back, piece = np.full((n + 1, w), _LOW), np.zeros((n + 1, w), np.int32), np.full((n + 1, w), -1, np.int32)
        score[0] = 0.0
        unknown = np.zeros(w, bool)
        for i in range(n):
            k = int(np.searchsorted(-size, -i))
            s, idx, node = score[i], np.arange(k), np.ones(k, np.int32)
            single = np.zeros(k, bool)
            for j in range(i, i + self.longest):
                node = self.below[node, text[j, idx]]
                live = np.flatnonzero(node)
                if len(live) < len(node):
                    idx, node = idx[live], node[live]
                    if not len(idx):
                        break
                got = self.at_node[node]
                ends = np.flatnonzero(got >= 0)
                if not len(ends):
                    continue
                to = idx[ends]
                if j == i:
                    single[to] = True
                x = s[to] + self.node_score[node[ends]]
                more = np.flatnonzero(x > score[j + 1, to])
                to = to[more]
                score[j + 1, to], back[j + 1, to], piece[j + 1, to] = x[more], i, got[ends[more]]
            if not single.all():
                to = np.flatnonzero(~single)
                to = to[s[to] + self.penalty > score[i + 1, to]]
                score[i + 1, to], back[i + 1, to], piece[i + 1, to] = s[to] + self.penalty, i, -1
        ids, count = np.zeros((w, n), "<u4"), np.zeros(w, np.int64)
        at, live = size.copy(), np.arange(w)
        while len(live):
            p = piece[at[live], live]
            unknown[live[p < 0]] = True
            count[live] += 1
            ids[live, n - count[live]] = p
            at[live] = back[at[live], live]
            live = live[at[live] > 0]
        raw = ids.tobytes()
        return [None if u else (s, raw[4 * (i * n + n - c):4 * (i + 1) * n]) for i, (s, c, u) in enumerate(
            zip(score[size, np.arange(w)].tolist(), count.tolist(), unknown.tolist()))]

    def _parts(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The parts of all texts in order, and how many each has: no piece holds the two characters at a
        cut side by side."""
        text, size = "".join(texts), np.array([len(t) for t in texts], np.int64)
        if not text:
            return [], np.zeros(len(texts), np.int64)
        code, end = np.frombuffer(text.encode("utf-32-le"), np.uint32), np.cumsum(size)
        cols = self.column[code]
        apart = np.r_[~self.beside[cols[:-1], cols[1:]], True]
        # a pair with a character without a column is looked up
        unsure = np.flatnonzero((cols[:-1] == 0) | (cols[1:] == 0))
        pairs, which = np.unique(code[unsure].astype(np.int64) << 32 | code[unsure + 1], return_inverse=True)
        apart[unsure] = np.array([chr(x >> 32) + chr(x & 0xFFFFFFFF) not in self.inner for x in pairs.tolist()], bool)[which]
        apart[end[size > 0] - 1] = True  # from one text to the next
        cut = np.flatnonzero(apart) + 1
        at = cut.tolist()
        return [text[i:j] for i, j in zip([0, *at], at)], np.diff(np.r_[0, np.searchsorted(cut, end, side="right")])

    def _spell_all(self, ids: np.ndarray, count: np.ndarray, parts: list[str]) -> list[bool]:
        """Whether each part is spelled by its ``count`` of the ids: all at once, or one by one if any is not."""
        raw = "".join(parts).encode()
        ends, own = np.r_[0, np.cumsum(self.bytes_in[ids])][np.cumsum(count)], [len(p.encode()) for p in parts]
        if (ends == np.cumsum(own)).all() and self.spelled(ids.tolist()) == raw:
            return [True] * len(parts)
        return [self.spelled(x.tolist()) == p.encode() for x, p in zip(np.split(ids, np.cumsum(count)[:-1]), parts)]

    def _learn(self, parts: set[str]) -> None:
        """Solve new parts and remember them: score, packed ids of the best path, ids by merges (or the
        path again), whether both spell the part."""
        new, old, todo = self.new, self.old, []
        for u in parts:
            if (v := old.get(u)) is not None:
                new[u] = v
            else:
                todo.append(u)
        if not todo:
            return
        solved = self.best_many(todo)
        paths = [x[1] for x in solved]
        ids, count = np.frombuffer(b"".join(paths), "<u4"), np.array([len(x) // 4 for x in paths])
        merged, ok = paths, self._spell_all(ids, count, todo)
        if self.bpe:
            own = self.lib.encode(todo, num_threads=1)
            count = np.array([len(x) for x in own])
            ids, end = np.array(list(chain.from_iterable(own)), "<u4"), (4 * np.cumsum(count)).tolist()
            raw = ids.tobytes()
            merged = [raw[a:b] for a, b in zip([0, *end], end)]
            ok = [a and b for a, b in zip(ok, self._spell_all(ids, count, todo))]
        new.update(zip(todo, zip([x[0] for x in solved], paths, merged, ok)))

    def _found(self, texts: list[str]) -> Iterator[list[tuple[float, bytes, bytes, bool]]]:
        """What is remembered of the parts of each text; new parts are learned together."""
        parts, count = self._parts(texts)
        if not (some := set(parts)) <= self.new.keys():
            if len(self.new) > self.limit:
                self.new, self.old = {}, self.new
            self._learn(some.difference(self.new))
        get, parts = self.new.__getitem__, iter(parts)
        for n in count.tolist():
            yield list(map(get, islice(parts, n)))

    def solve_many(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, bool]]:
        """``solve`` of many escaped texts without their scores."""
        held, size = [], 0
        for k, t in enumerate(texts):
            held.append(t)
            size += len(t)
            if size > TEXTS or k == len(texts) - 1:
                for found in self._found(held):
                    _, path, own, ok = zip(*found) if found else ((),) * 4
                    yield b"".join(path), b"".join(own), all(ok)
                held, size = [], 0

    def solve(self, text: str) -> tuple[float, bytes, bytes, bool]:
        """Of an escaped text: score and packed ids of its best path, its ids by merges, and
        whether both spell it."""
        found = next(self._found([text]))
        if not found:
            return 0, b"", b"", True
        score, path, own, ok = zip(*found)
        return sum(score), b"".join(path), b"".join(own), all(ok)

    def spelled(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    # chunks: text is the chunk and up to ``longest - 1`` characters after it

    def _inner(self, text: str, size: int) -> tuple[int, int]:
        """First and last word start in the chunk after its first ``longest`` characters."""
        if not self.words:
            return -1, -1
        m = re.compile(f"[^{SPACE}]{SPACE}").search(text, self.longest - 1, size)
        a, b = m.start() + 1 if m else -1, text.rfind(SPACE, 0, size)
        while b > 0 and text[b - 1] == SPACE:
            b -= 1
        return (a, b) if 0 <= a <= b else (-1, -1)

    def _rows(self, text: str, size: int, start: int) -> np.ndarray:
        """``m[e, x]`` for entries ``start + e``: best score to ``size + x`` by pieces that start in
        the chunk, all entries at once."""
        s = self.longest
        score = np.full((size + s, s), _LOW)
        for e in range(s):
            if start + e < size + s:
                score[start + e, e] = 0.0
        for i in range(start, size):
            if score[i].max() > _LOW:
                for j, x, _ in self.arcs(text, i):
                    np.maximum(score[j], score[i] + x, out=score[j])
        out = score[size:size + s].T.copy()
        out[out < _LOW / 2] = _LOW
        return out

    def solved(self, text: str, size: int) -> tuple[np.ndarray, str, bytes | None, str, int]:
        """Transfer matrix: entry state (characters taken) to exit state (characters taken from
        the next chunk); and what a backtrace needs: the text before the first inner word, the ids from
        there to the last word (None: no such place, the text is whole), the text from there on and
        how many of its characters are the chunk's."""
        a, b = self._inner(text, size)
        if a < 0:
            return self._rows(text, size, 0), "", None, text, size
        into = np.array([self.best(text, e, a)[0] for e in range(self.longest)])
        between, ids, _, _ = self.solve(text[a:b])
        out = self._rows(text[b:], size - b, 0)[0]
        m = into[:, None] + between + out[None, :]
        m[m < _LOW / 2] = _LOW
        return m, text[:a], ids, text[b:], size - b

    def matrix(self, text: str, size: int) -> np.ndarray:
        return self.solved(text, size)[0]

    def backtrace(self, text: str, size: int, entry: int, exit_: int) -> bytes:
        """Ids of the chunk's best path between its two states."""
        return self.trace(*self.solved(text, size)[1:], entry, exit_)

    def trace(self, head: str, ids: bytes | None, tail: str, left: int, entry: int, exit_: int) -> bytes:
        """The same from what ``solved`` gives."""
        if ids is None:
            return np.array(self._between(tail, entry, left, exit_), "<u4").tobytes()
        first = np.array(self.best(head, entry, len(head))[1], "<u4").tobytes()
        return first + bytes(ids) + np.array(self._between(tail, 0, left, exit_), "<u4").tobytes()

    def _between(self, text: str, entry: int, size: int, exit_: int) -> list[int]:
        if entry >= size + exit_:
            return []
        # the last piece starts in the chunk
        end, score, back = size + exit_, {entry: 0.0}, {}
        for i in range(entry, size):
            if i in score:
                for j, x, id_ in self.arcs(text, i):
                    if score[i] + x > score.get(j, _LOW):
                        score[j], back[j] = score[i] + x, (i, id_)
        ids, at = [], end
        while at > entry:
            i, id_ = back[at]
            ids.append(self.spell(text, i, at, id_))
            at = i
        return [x for part in reversed(ids) for x in part]

    def decode(self, ids) -> str:
        """The text of ids: byte pieces joined, spaces restored, the added first space dropped."""
        text = self.spelled(ids).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def combine(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Prefix products in the max-plus semiring of the rows reached from entry state 0."""
    row, out = np.full(len(matrices[0]), _LOW), []
    row[0] = 0.0
    for m in matrices:
        row = np.maximum((row[:, None] + m).max(0), _LOW)
        out.append(row)
    return out


def edge_states(matrices: list[np.ndarray]) -> list[int]:
    """Best state at every chunk edge, ``0`` first and last."""
    rows = [np.r_[0.0, np.full(len(matrices[0]) - 1, _LOW)], *combine(matrices)]
    state, out = 0, [0]
    for m, row in zip(reversed(matrices), reversed(rows[:-1])):
        state = int((row + m[:, state]).argmax())
        out.append(state)
    return out[::-1]


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def scan(texts: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """``texts(tid, text)``, distinct: ``tid, path binary`` (little-endian 32-bit ids) by the scan."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for pdf in batches:
            for tid, text in zip(pdf["tid"].tolist(), pdf["text"].tolist()):
                t = m.escaped(text)
                at = range(0, len(t), chunk)
                yield pd.DataFrame({"tid": tid, "i": list(at), "size": [min(chunk, len(t) - a) for a in at],
                                    "part": [t[a:a + chunk + m.longest - 1] for a in at]})
    parts = materialize(texts.mapInPandas(cut, "tid long, i long, size int, part string").repartition("tid", "i"), "scan-chunks")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for pdf in batches:
            got = [m.solved(t, s) for t, s in zip(pdf["part"], pdf["size"])]
            yield pdf[["tid", "i"]].assign(m=[x[0].ravel() for x in got], **{c: pd.Series([x[k] for x in got], index=pdf.index, dtype=object)
                                           for k, c in enumerate(("head", "mid", "tail", "left"), 1)})
    solved = materialize(parts.mapInPandas(matrices, "tid long, i long, m array<double>, head string, mid binary, tail string, left int"),
                         "scan-solved")
    per = solved.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("l"))

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tid, rows in zip(pdf["tid"].tolist(), pdf["l"]):
                ms = [np.asarray(r["m"]).reshape(int(len(r["m"]) ** 0.5), -1) for r in rows]
                at = edge_states(ms)
                yield pd.DataFrame({"tid": tid, "i": [r["i"] for r in rows], "entry": at[:-1], "exit": at[1:]})
    edges = per.mapInPandas(states, "tid long, i long, entry int, exit int")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for pdf in batches:
            yield pdf[["tid", "i"]].assign(ids=[m.trace(*x) for x in zip(
                *[pdf[c].tolist() for c in ("head", "mid", "tail", "left", "entry", "exit")])])
    ids = solved.join(edges, ["tid", "i"]).select("tid", "i", "head", "mid", "tail", "left", "entry", "exit").mapInPandas(
        trace, "tid long, i long, ids binary")
    whole = F.transform(F.sort_array(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])
    return ids.groupBy("tid").agg(F.aggregate(whole, F.lit(b""), lambda a, x: F.concat(a, x)).alias("path"))


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, ids binary, path binary, decoded`` (whether both decode to the text) per row."""
    d = docs.select(id_in(), F.col("text").cast("string").alias("text")).withColumn("tid", F.xxhash64("text"))
    giant = F.coalesce(F.char_length("text"), F.lit(0)) >= chunk

    def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for pdf in batches:
            own, best, same, texts = [], [], [], pdf["text"].tolist()
            for text, got, (p, o, spells) in zip(texts, pdf["path"].tolist(), m.solve_many(list(map(m.escaped, texts)))):
                if got is not None:
                    p = bytes(got)
                    spells = spells and m.decode(np.frombuffer(p, "<u4").tolist()) == text
                own.append(o if m.bpe else p)
                best.append(p)
                same.append(spells)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": own, "path": best, "decoded": same})
    paths = scan(d.where(giant).select("tid", "text").dropDuplicates(["tid"]), path, chunk)
    rows = d.where(~giant).select("doc_id", "text", F.lit(None).cast("binary").alias("path")).unionByName(
        d.where(giant).join(paths, "tid").select("doc_id", "text", "path"))
    return rows.mapInPandas(direct, "doc_id long, ids binary, path binary, decoded boolean").withColumn("doc_id", id_out())


def digests(encoded: DataFrame) -> DataFrame:
    n = lambda c: (F.octet_length(c) / 4).cast("long")
    return encoded.select("doc_id", n("ids").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                          n("path").alias("n_path_ids"), F.crc32("path").alias("path_crc32"), "decoded")
