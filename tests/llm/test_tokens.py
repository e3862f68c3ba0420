"""op3, op4, op5, op8, op9, op10 and the pipeline against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from parlance.llm import ann, chat_format, packing, sentencepiece_scan, token_files, token_rollup
from parlance.llm.common import ChunkEncoder, tokenizer_path
from tests.llm.conftest import ODD
from tests.llm.test_filters import texts

STRANGE = ["", "  a  b\n\n c\t\td ", "x<|endoftext|>y it's  ok\r\n\x1c z", "café   q r", "́a b", "ΑΣ ΣΑΣ. 1234 ab12!!",
           "\n", " ", "a\x85b c", " \n x", "x \n\n", "a\x01b \x01 c\x01", "Word, word. WORD!! don't dogs' x' 's a… é, É. №. 5, ²., a_b_",
           "“q.” 中. ①. á, $5. x́́.", "٠, ١.", "a  b  c"]


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_chunk_encoder_equals_the_tokenizer(path, words):
    tok = Tokenizer.from_file(tokenizer_path(path))
    many = STRANGE + [t for _, t in texts(8, 40)]
    for limit in (100_000, 3):
        enc = ChunkEncoder(path, words, limit)
        for some in (many, many[::-1]):
            assert [np.frombuffer(x, "<u4").tolist() for x in enc.batch(some)] == [ids_of(tok, t) for t in some]


def test_token_files(docs, llm, tmp_dir):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in ODD if i is not None and i != 7] + [(-5, "first"), (100, STRANGE[2])]
    got = {r.doc_id: tuple(r)[1:] for r in token_files.token_table(docs(rows), "byte_bpe_50k.json", 50257, 2).collect()}
    start, want = 0, {}
    for i, t in sorted(rows):
        ids = ids_of(tok, t) + [2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    twice = token_files.token_table(docs(ODD), "byte_bpe_50k.json", 50257, 2).collect()
    assert len(twice) == len(ODD) and sum(r.doc_id is None for r in twice) == 2
    assert sorted(r.start for r in twice)[0] == 0
    assert token_files.token_table(docs([]), "byte_bpe_50k.json", 50257, 2).count() == 0


def test_files_are_closed(docs, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    rows = texts(9, 30)
    got = token_files.token_table(docs(rows), "byte_bpe_50k.json", 50257, 2).orderBy("doc_id").collect()
    n = [r.n_tokens for r in got]
    assert [r.start for r in got] == np.cumsum([0] + n)[:-1].tolist()


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 20])
def test_bit_packing_round_trip_and_random_access(bits):
    r = np.random.default_rng(bits)
    ids = r.integers(0, 1 << bits, 10_001).astype(np.uint32)
    data = token_files.write_file(ids, bits, 1000)
    assert np.array_equal(token_files.read_file(data), ids)
    assert len(data) <= 24 + 8 * 11 + (10_001 * bits + 7) // 8 + 11
    for a, n in ((0, 1), (999, 2), (3000, 1000), (9_990, 100), (10_001, 5), (5, 0)):
        assert np.array_equal(token_files.read_file(data, a, n), ids[a:a + n])
    assert len(token_files.read_file(token_files.write_file(ids[:0], bits))) == 0
    assert token_files.bits_for(50257) == 16 and token_files.bits_for(65537) == 17 and token_files.bits_for(1) == 1


def test_packing(docs):
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [(i, t) for i, t in ODD if i is not None and i != 7] + [(1000 + i, t) for i, t in texts(10, 120)]
    got = packing.pack(packing.token_pieces(docs(rows), "word_bpe_49k.json")).collect()
    want = {}
    for i, t in rows:
        ids = ids_of(tok, t) + [0]
        for p, a in enumerate(range(0, len(ids), 2048)):
            want[i, p] = (a, len(ids[a:a + 2048]), zlib.crc32(np.array(ids[a:a + 2048], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 2048
    bound = math.ceil(sum(r.length for r in got) / 2048)
    assert bound <= len(seqs) <= bound + 1
    assert packing.pack(packing.token_pieces(docs([]), "word_bpe_49k.json")).count() == 0
    assert packing.pack(packing.token_pieces(docs(ODD), "word_bpe_49k.json")).where("doc_id is null").count() == 2


def test_fullest_is_the_best_subset_sum():
    r = random.Random(3)
    for _ in range(200):
        counts = {r.randrange(1, 40): r.randrange(1, 4) for _ in range(5)}
        room = r.randrange(0, 80)
        reach = {0}
        for n, c in counts.items():
            reach = {s + k * n for s in reach for k in range(c + 1)}
        got = packing.fullest(counts, room)
        assert sum(n * k for n, k in got.items()) == max(s for s in reach if s <= room)
        assert all(k <= counts[n] for n, k in got.items())


def test_plan_uses_up_the_histogram():
    r = random.Random(4)
    hist = {n: r.randrange(1, 10_000) for n in r.sample(range(1, 2049), 300)}
    plan, left = packing.plan_bins(hist), dict(hist)
    for bins, pattern in plan:
        assert sum(n * k for n, k in pattern.items()) <= 2048
        for n, k in pattern.items():
            left[n] -= bins * k
    assert not any(left.values()) and len(plan) < 3000


CONV = "conv_id long, turn int, role string, text string, turns string, before string, target int"


def test_chat(llm):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\<|b"), (1, 2, "user", "x"), (1, 3, "assistant", "\\n<\\|"), (1, 4, "user", "end"),
            (2, 0, "system\n\\n<|", None), (3, 0, "assistant", said), (3, None, "user", said), (4, 1, None, "q"), (4, 1, None, "q"),
            (None, 0, "assistant", ""), (5, 0, "assistant", "<|im_end|>\n<|im_start|>user\n\U0001F600")]
    t = llm.createDataFrame([(*r, "t", "b", 9) for r in rows], CONV)
    ex = chat_format.prefix_examples(t)
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((-1 if turn is None else turn, role or "", text or ""))
    want = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss),
                   hashlib.sha256(loss.encode()).hexdigest())
    assert {r.conv_id: tuple(r)[1:5] for r in chat_format.digests(ex).collect()} == want
    one = sorted((r.n_context, r.target, r.text[r.loss_start:r.loss_start + r.loss_chars] if r.target is not None else None)
                 for r in ex.where("conv_id = 1").collect())
    assert one == [(1, 1, "a\\\\<\\|b"), (3, 3, "\\\\n<\\\\|"), (4, None, None)]
    assert chat_format.prefix_examples(t.limit(0)).count() == 0


def test_rollup(docs, llm, tmp_dir):
    rows = llm.createDataFrame([(1, "a", "en", 5, 7), (2, "a", "en", 3, 4), (2, "a", "en", 3, 4), (3, None, "fr", None, 2)],
                               "doc_id long, source string, lang string, n long, m long")
    store = token_rollup.create(llm, tmp_dir + "/store")

    def now():
        return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in token_rollup.rollup(llm, store).collect()}
    assert now() == {}
    load = token_rollup.inserts(rows, "v1", "n")
    assert token_rollup.commit(store, "load", load) and not token_rollup.commit(store, "load", load)
    assert now() == {("a", "en", "v1"): (3, 11), (None, "fr", "v1"): (1, 0)}
    assert token_rollup.commit(store, "out", token_rollup.deletes(rows.where("doc_id = 1"), "v1", "n"))
    assert token_rollup.commit(store, "new", token_rollup.revisions(rows.where("doc_id <> 1"), ("v1", "n"), ("v2", "m")))
    assert now() == {("a", "en", "v2"): (2, 8), (None, "fr", "v2"): (1, 2)}
    # sums that no log line names do not count
    lost = load.groupBy("source", "lang", "tokenizer").agg({"n_docs": "sum"}).selectExpr(
        "'lost' as batch", "'x' as attempt", "source", "lang", "tokenizer", "`sum(n_docs)` as n_docs", "1L as n_tokens")
    lost.write.mode("append").parquet(store + "/totals")
    assert now() == {("a", "en", "v2"): (2, 8), (None, "fr", "v2"): (1, 2)}
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = token_rollup.count_tokens(docs(ODD), "word_bpe_49k.json", True).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(ids_of(tok, t)) for _, t in ODD)


@pytest.mark.parametrize("empty", [False, True])
def test_rollup_query_equals_brute_force(llm, tmp_dir, empty):
    from parlance.llm.queries import QUERIES
    langs, sources = ["en", "fr", None, ""], ["a", None, "b"]
    rows = [] if empty else [(i, t, langs[k % 4], sources[k % 3], 0) for k, (i, t) in enumerate(ODD + texts(3, 30))]
    labels = [] if empty else [(i, 1, k % 4 == 0) for k, (i, *_) in enumerate(rows)] + [(12345, 0, True)]
    llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_dir}/documents.parquet")
    llm.createDataFrame([(i, q, int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    toxic = {i for i, _, t in labels if t and i is not None}
    tok = {n: Tokenizer.from_file(tokenizer_path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k")}
    want = collections.defaultdict(lambda: [0, 0])
    for i, t, lang, source, _ in rows:
        if i not in toxic:
            name = "byte_bpe_50k" if lang == "en" else "word_bpe_49k"
            w = want[source, lang, name]
            w[0] += 1
            w[1] += len(ids_of(tok[name], t))
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in QUERIES["op9_token_rollup"](llm, tmp_dir).collect()}
    assert got == dict(want)


@pytest.fixture(scope="module")
def models(tmp_path_factory):
    """The given model, and its pieces and scores as a unigram model."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    path = tokenizer_path("piece_bpe_32k.model")
    m = pb.ModelProto()
    m.ParseFromString(open(path, "rb").read())
    m.trainer_spec.model_type = 1
    out = str(tmp_path_factory.mktemp("m") / "unigram.model")
    open(out, "wb").write(m.SerializeToString())
    return path, out


def test_sentencepiece_equals_the_library(docs, models):
    from sentencepiece import SentencePieceProcessor
    merges, unigram = models
    lib, uni = SentencePieceProcessor(model_file=merges), SentencePieceProcessor(model_file=unigram)
    rows = ODD + list(enumerate(STRANGE + ["日本語 テキスト", "x\x00y\U0001F600 ▁▁ z"], 50))
    got = sentencepiece_scan.encode(docs(rows), merges).collect()
    assert all(r.decoded for r in got if r.doc_id not in (67,))  # U+2581 in a text comes back as a space
    want = sorted(zlib.crc32(np.array(lib.encode(t or ""), "<u4").tobytes()) for _, t in rows)
    assert sorted(zlib.crc32(bytes(r.ids)) for r in got) == want
    m = sentencepiece_scan.Model(unigram)
    # the library's lattice (its n-best list) holds no better path than ours
    for t in ["the cat", "a  b", "Hello, World! 123"] + [t[:60].strip() for _, t in texts(11, 30)]:
        score, path, _, spells = m.solve(m.escaped(t))
        ids = np.frombuffer(path, "<u4").tolist()
        assert spells and m.decode(ids) == uni.decode(ids) == t
        assert score <= sum(uni.get_score(i) for i in ids) == sum(uni.get_score(i) for i in uni.nbest_encode(t, nbest_size=2)[0])
    assert sentencepiece_scan.encode(docs([]), merges).count() == 0


@pytest.mark.parametrize("words", [True, False])
def test_scan_equals_one_pass(models, words):
    m = sentencepiece_scan.Model(models[1])
    m.words = words and m.words
    for _, t in texts(12, 12) + list(enumerate(STRANGE)) + [(0, "x" * 300), (0, "日" * 200)]:
        e = m.escaped(t)[:1500]
        for size in (40, 97):
            if not e:
                continue
            parts = [(e[a:a + size + m.longest - 1], min(size, len(e) - a)) for a in range(0, len(e), size)]
            ms = [m.matrix(p, n) for p, n in parts]
            at = sentencepiece_scan.edge_states(ms)
            ids = np.concatenate([np.frombuffer(m.backtrace(p, n, a, b), "<u4") for (p, n), a, b in zip(parts, at[:-1], at[1:])])
            score, _ = m.best(e, 0, len(e))
            assert sentencepiece_scan.combine(ms)[-1][0] == pytest.approx(score)
            assert m.decode(ids.tolist()) == m.decode(m.best(e, 0, len(e))[1])


def test_scan_as_a_job(docs, models):
    rows = texts(13, 30)
    a = {r.doc_id: bytes(r.path) for r in sentencepiece_scan.encode(docs(rows), models[0], chunk=200).collect()}
    m = sentencepiece_scan.Model(models[0])
    for i, t in rows:
        ids = np.frombuffer(a[i], "<u4").tolist()
        assert m.decode(ids) == t
    same = sum(a[i] == m.solve(m.escaped(t))[1] for i, t in rows)
    assert same >= len(rows) - 3  # equal scores may part at an edge


def test_scan_with_clashing_columns_and_repeated_rows(docs, models):
    from pyspark.sql import functions as F
    rows = texts(16, 6) + [(None, None), (3, ""), (7, "a b " * 200), (7, "a b " * 200)]
    plain = docs(rows)
    names = ("tid", "path", "ids", "decoded", "chunk", "state", "id")
    odd = plain.select(*[F.lit("x").alias(c) for c in names], *plain.columns)
    want, got = (sorted((x.doc_id or -1, bytes(x.ids), bytes(x.path), x.decoded) for x in sentencepiece_scan.encode(d, models[0], chunk=200).collect())
                 for d in (plain, odd))
    assert got == want and len(got) == len(rows)


def test_nearest(llm, monkeypatch):
    monkeypatch.setattr(ann, "HUBS", 50)  # the graph has to find the rest
    r = np.random.default_rng(1)
    v = r.standard_normal((700, 16))
    v[3] = v[5]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    bad = [(None, [1.0] * 16, 0), (9000, None, 0), (9020, [0.0] * 16, 0), (9040, [float("nan")] + [1.0] * 15, 0), (9060, [1.0, None], 0),
           (9080, [1.0] * 3, 0), (9100, [float("inf")] * 16, 0)]
    t = llm.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<double>, id int")
    vs = ann.valid_vectors(t)
    got = collections.defaultdict(list)
    for x in ann.search(vs, vs.where("id % 20 = 0").select("id"), 20).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    assert sorted(got) == list(range(0, 700, 20))
    hit = []
    for q, found in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(700), -s))[:20]
        hit.append(len({x[1] for x in found} & set(want.tolist())) / 20)
        assert [x[0] for x in found] == list(range(1, 21)) and q not in {x[1] for x in found}
        assert all(abs(x[2] - s[x[1]]) < 1e-9 for x in found) and [x[2] for x in found] == sorted((x[2] for x in found), reverse=True)
    assert np.mean(hit) >= 0.9
    few = ann.valid_vectors(t.where("vec_id < 5"))
    small = ann.search(few, few.where("id = 0").select("id"), 20).collect()
    assert sorted(x.vec_id for x in small) == [1, 2, 3, 4]
    none = ann.valid_vectors(t.where("vec_id > 8999"))
    assert ann.search(none.where("id < 0"), none.select("id"), 20).count() == 0


@pytest.mark.parametrize("sigma", [0.5, 1.0])
def test_nearest_of_unequal_lengths(llm, monkeypatch, sigma):
    """Recall at 20 with lognormal lengths; hubs are a twentieth of the vectors."""
    monkeypatch.setattr(ann, "HUBS", 500)
    n, r = 10_000, np.random.default_rng(4)
    v = r.standard_normal((n, 64))
    v *= np.exp(sigma * r.standard_normal((n, 1))) / np.linalg.norm(v, axis=1, keepdims=True)
    t = llm.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    vs = ann.valid_vectors(t)
    got = ann.search(vs, vs.where("id % 20 = 0").select("id"), 20).collect()
    assert len(got) == n // 20 * 20
    s = v[::20] @ v.T
    s[np.arange(n // 20), np.arange(0, n, 20)] = -np.inf
    last = np.sort(s, axis=1)[:, -20]
    assert np.mean([x.score >= last[x.query_id // 20] - 1e-9 for x in got]) >= 0.9


def test_a_giant_vector_leaves_the_others_found(llm, monkeypatch):
    monkeypatch.setattr(ann, "HUBS", 30)
    n, r = 600, np.random.default_rng(5)
    v = r.standard_normal((n, 16))
    v[7] *= 1e200
    t = llm.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    vs = ann.valid_vectors(t)
    got = collections.defaultdict(set)
    for x in ann.search(vs, vs.where("id % 20 = 0").select("id"), 20).collect():
        got[x.query_id].add(x.vec_id)
    hit = []
    for q, found in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        hit.append(len(found & set(np.lexsort((np.arange(n), -s))[:20].tolist())) / 20)
    assert len(got) == n // 20 and np.mean(hit) >= 0.9


def test_pipeline_stages(docs, llm, tmp_dir):
    import corpus_pipeline as cp
    rows = texts(14, 80)
    r = random.Random(3)
    junk = [(500 + i, " ".join(f"{r.choice('abcdefgh')}{r.randrange(999)}***" for _ in range(80))) for i in range(40)]
    d = docs(rows + junk + [(900, None), (901, "")]).drop("key", "row", "sid")
    labels = llm.createDataFrame([(i, 1, 0) for i, _ in rows] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int")
    labels.write.parquet(tmp_dir + "/labels.parquet")
    d.write.parquet(tmp_dir + "/documents.parquet")
    cur = llm.read.parquet(tmp_dir + "/documents.parquet")
    for name, stage in cp.STAGES:
        new = stage(llm, cur, tmp_dir)
        if name != "best_fit_packing":
            assert new.dtypes == d.dtypes
            assert new.where("n_chars <> length(text) and n_chars <> 0").count() == 0
        new.write.parquet(f"{tmp_dir}/{name}")
        cur = llm.read.parquet(f"{tmp_dir}/{name}")
        if name == "quality_rules":
            assert not {x.doc_id for x in cur.collect()} & {i for i, _ in junk}
    assert {"doc_id", "sequence_id", "offset"} <= set(cur.columns) and cur.count() > 0
    assert cp.run(llm, tmp_dir).count() == cur.count()


def test_pipeline_of_odd_rows_and_clashing_columns(docs, llm, tmp_dir):
    import corpus_pipeline as cp
    clean = texts(15, 30)
    d = docs(ODD + [(100 + i, t) for i, t in clean])
    d.write.parquet(tmp_dir + "/documents.parquet")
    llm.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(tmp_dir + "/labels.parquet")
    cur = llm.read.parquet(tmp_dir + "/documents.parquet")
    for name, stage in cp.STAGES:
        new = stage(llm, cur, tmp_dir)
        if name != "best_fit_packing":
            assert new.dtypes == d.dtypes
        new.write.parquet(f"{tmp_dir}/{name}")
        cur = llm.read.parquet(f"{tmp_dir}/{name}")
    places = collections.defaultdict(list)
    for x in cur.collect():
        places[x.sequence_id].append((x.offset, x.length))
    for p in places.values():
        p.sort()
        ends = np.cumsum([n for _, n in p]).tolist()
        assert [o for o, _ in p] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_pipeline_of_an_empty_table(docs, llm, tmp_dir):
    import corpus_pipeline as cp
    docs([]).write.parquet(tmp_dir + "/documents.parquet")
    llm.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(tmp_dir + "/labels.parquet")
    assert cp.run(llm, tmp_dir).count() == 0


def test_words_solved_together_are_those_solved_alone(models, monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["", " ", "\n.a", *("".join(rng.choice(list("aeinost. \n\u00e9\u65e5\u0378\u2581Z9"), rng.integers(0, 90))) for _ in range(300))]
    for path in models:
        m, calls = sentencepiece_scan.Model(path), []
        real = m.best
        monkeypatch.setattr(m, "best", lambda *a: (calls.append(a), real(*a))[1])
        got = list(m.solve_many([m.escaped(t) for t in texts]))
        assert len(got) == len(texts) and len(calls) < len(m.new) // 2
        for p, (score, ids, _, _) in m.new.items():
            if all(p[i:i + 2] in m.inner for i in range(len(p) - 1)):
                want = real(p, 0, len(p))
                assert (score, np.frombuffer(ids, "<u4").tolist()) == want
        one = sentencepiece_scan.Model(path)
        assert got == [one.solve(one.escaped(t))[1:] for t in texts]


def test_words_of_known_parts_are_not_learned_again(models):
    """Only the parts between places that no piece crosses are remembered, in any number of generations."""
    rng = np.random.default_rng(6)
    texts = ["", *(" ".join("".join(rng.choice(["the", "\u00e9\u0378", "Zq9", ".", "\u65e5"], 6)) for _ in range(40)) for _ in range(30))]
    for path in models:
        m, few = sentencepiece_scan.Model(path), sentencepiece_scan.Model(path, limit=3)
        want = [m.solve(m.escaped(t)) for t in texts]
        assert [x[1:] for x in want] == list(m.solve_many([m.escaped(t) for t in texts])) and all(x[3] for x in want)
        assert m.new and all(p[i:i + 2] in m.inner for p in m.new for i in range(len(p) - 1))
        assert [few.solve(few.escaped(t)) for t in texts] == want
        for t, (score, ids, _, _) in zip(texts, want):
            best, path_ = m.best(m.escaped(t), 0, len(m.escaped(t)))
            assert score == pytest.approx(best) and np.frombuffer(ids, "<u4").tolist() == path_


def test_a_giant_text_is_solved_once_for_its_scan(models):
    m = sentencepiece_scan.Model(models[0])
    text = m.escaped("some words of a giant text, one after another. " * 20)
    size = len(text) - m.longest
    matrix, head, ids, tail, left = m.solved(text, size)
    assert ids and text.startswith(head) and text.endswith(tail) and (matrix == m.matrix(text, size)).all()
    m.solve = None  # a trace solves nothing between the edges again
    for entry in range(3):
        assert m.trace(head, ids, tail, left, entry, 0)


def test_a_word_is_remembered_once_whatever_symbols_follow():
    e = ChunkEncoder("byte_bpe_50k.json", False)
    texts = [f"a word{x} and{x}" for x in ("", ".", ",", "!?", "...", ")", ";")] + ["don't", "x.y. z", "caf\u00e9, a1. _b_ \x0b.", "a.\u00a0b", "A--B-- "]
    want = [np.array(e.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.batch(texts) == want
    assert sum(c.startswith(b" word") for c in e.new) == 1 and sum(c.startswith(b" and") for c in e.new) == 1
