"""op1, op2, op6, op7 against brute force, and on odd rows."""

import collections
import hashlib
import random

import numpy as np
import pytest

from parlance.llm import line_dedup, ngram_join, quality_rules, suffix_dedup
from parlance.llm.components import components
from tests.llm.conftest import LONG, ODD

WORDS = [f"{a}{b}" for a in ("ba", "de", "ki", "lo", "mu", "ra", "se", "ti") for b in ("n", "r", "st", "x", "m", "l")]


def texts(seed, n):
    """Random texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    passage = " ".join(r.choice(WORDS) for _ in range(80))
    out = []
    for _ in range(n):
        kind = r.random()
        t = [r.choice(WORDS) for _ in range(r.choice((1, 2, 5, 40, 150, 300)))]
        if out and kind < 0.15:
            out.append(r.choice(out))
            continue
        if out and kind < 0.45:
            t = r.choice(out).split(" ")
            for _ in range(r.choice((1, 1, 2, 6))):
                t[r.randrange(len(t))] = r.choice(WORDS)
        text = " ".join(t)
        if kind > 0.85:
            text += "\n" + passage + " " + r.choice(WORDS)
        out.append(text)
    return list(enumerate(out))


def union(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def shingles(text, n):
    w = (text or "").encode().translate(ngram_join.LOWER).split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_components_equal_all_pairs(docs, n, percent):
    rows = texts(3, 150)
    sets = {i: shingles(t, n) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = union(links, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(rows), n, percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(links) > 20


def test_keep_one_equals_all_pairs_under_null_and_repeated_ids(docs):
    """Unlike texts stay, whatever ids they share."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in texts(9, 90)] + [(None, None), (7, ""), (7, " ")]
    sets = {k: shingles(t, 5) for k, (_, t) in enumerate(rows)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = union(links, sets)
    size = collections.Counter(group[k] for k in sets if sets[k])
    got = [(r.doc_id, r.text) for r in ngram_join.keep_one(docs(rows), 5, 80).collect()]
    assert len([x for x in got if not shingles(x[1], 5)]) == 3
    of = {(i, t): group[k] for k, (i, t) in enumerate(rows) if sets[k]}
    worded = [x for x in got if shingles(x[1], 5)]
    assert sorted(of[x] for x in worded) == sorted(size)
    least = {g: min(-1 if i is None else i for k, (i, _) in enumerate(rows) if sets[k] and group[k] == g) for g in size}
    assert all((-1 if i is None else i) == least[of[i, t]] for i, t in worded)
    assert len({of[x] for x in worded if x[0] is None}) > 5 and len({of[x] for x in worded if x[0] == 7}) > 5


def test_pigeonhole_meets_every_link():
    """Linked sets share an index key under any allocation, also with weight-2 segments."""
    r = np.random.default_rng(5)
    for sets in ({}, {k: 10 ** 9 for k in range(200)}):
        bands = ngram_join.Bands(80, 500).allocate(sets)
        for _ in range(300):
            a = np.unique(r.integers(0, 2 ** 63, r.integers(1, 120)).astype(np.uint64))
            keep = a[r.random(len(a)) > 0.1]
            b = np.unique(np.r_[keep, r.integers(0, 2 ** 63, r.integers(0, 8)).astype(np.uint64)])
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= 80 * (len(a) + len(b) - common):
                assert len(np.intersect1d(bands.keys(a), bands.keys(b)))
    assert any(d for _, d in bands.segments)


def test_wide_sketch_is_a_lower_bound():
    r = np.random.default_rng(8)
    for _ in range(100):
        a = np.unique(r.integers(0, 2 ** 63, r.integers(900, 6000)).astype(np.uint64))
        b = np.unique(np.r_[a[r.random(len(a)) > r.random() * 0.4], r.integers(0, 2 ** 63, r.integers(0, 900)).astype(np.uint64)])
        x, y = (ngram_join.wide_sketch(s, 80) for s in (a, b))
        assert x is not None and ngram_join.wide_differ(x, y) <= len(np.setxor1d(a, b))
    c = np.unique(r.integers(0, 2 ** 63, 3000).astype(np.uint64))
    d = np.unique(r.integers(0, 2 ** 63, 3000).astype(np.uint64))
    assert ngram_join.wide_differ(*(ngram_join.wide_sketch(s, 80) for s in (c, d))) > 6000 * 20 // 180


def test_across_in_blocks(llm, monkeypatch):
    """A key with more sets than a block holds still compares all of them."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    sets = llm.createDataFrame([(i, 10, 0) for i in range(10)], "sid long, n int, s long")
    shared = llm.createDataFrame([(1, i) for i in range(10)], "key long, sid long")
    none = llm.createDataFrame([], "id long, component long")
    got = ngram_join.across(shared, sets, none, lambda d, a, b: d < 1, ["s"], False)
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in range(10) for b in range(a + 1, 10)}


def test_components(llm):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(50)] + [(7, 7)]
    ids = {x for p in pairs for x in p if p[0] != p[1]}
    got = {r.id: r.component for r in components(llm.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: c for i, c in union([p for p in pairs if p[0] != p[1]], ids).items()}
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0


def removed(rows, length):
    count = collections.Counter(t[i:i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = {}
    for d, t in rows:
        runs = []
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        gone = {i for a, b in runs for i in range(a, b)}
        kept = bytes(c for i, c in enumerate(t) if i not in gone)
        out[d] = (len(t), len(gone), len(runs), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group", [4000, 2])
def test_repeated_strings_equal_brute_force(docs, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = texts(4, 60) + [(1000, "ab" * 700), (1001, "x" * 199), (1002, "é" * 150 + "q"), (1003, "z" * 201)]
    want = removed([(i, t.encode()) for i, t in rows], 200)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs(rows)).collect()}
    assert got == want


def test_triggers_belong_to_the_string():
    """Equal strings have their trigger at the same place, whatever surrounds them."""
    r = random.Random(1)
    s = bytes(r.randrange(97, 100) for _ in range(200))
    for _ in range(20):
        a = bytes(r.randrange(97, 100) for _ in range(r.randrange(300)))
        assert suffix_dedup.trigger_of(a + s + a[:50], 200)[len(a)] - len(a) == suffix_dedup.trigger_of(s, 200)[0]


def test_edit_distance_bound():
    r = random.Random(7)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]
    for _ in range(2000):
        a, b = ("".join(r.choices("abé", k=r.randrange(0, 14))) for _ in "ab")
        d = distance(a, b)
        for most in (0, 1, d - 1, d, d + 1):
            assert line_dedup.within(a, b, most) == (d <= most)


def test_line_dedup_keeps_one_of_each_group(docs):
    base = [" ".join(random.Random(i).choices(WORDS, k=40)) for i in range(12)]
    near = [b + "." for b in base[:4]] + [b.upper() for b in base[4:8]] + [b + " Q" for b in base[8:]]
    rows = [(0, "\n".join(base)), (1, "\n".join(near)), (2, "short line\nshort line"), (3, base[0] + "\n" + base[0])]
    got = {r.doc_id: r for r in line_dedup.report(docs(rows)).collect()}
    assert got[0].kept_text == rows[0][1] and got[0].n_removed == 0
    assert got[2].kept_text == "short line" and got[2].n_removed == 1  # equal lines of any length are one
    assert got[1].n_removed >= 8 and got[3].n_removed == 2 and got[3].kept_text == ""


def test_odd_rows(docs, llm):
    d = docs(ODD)
    c = sorted(ngram_join.jaccard_components(d, 3, 90).select("doc_id", "n_shingles", "component_id").collect(), key=str)
    by = collections.defaultdict(list)
    for r in c:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[1] == [(0, 1)] and by[3] == [(0, 3)] and by[4] == [(1, 4)] and len(by[7]) == 2
    assert {x[1] for x in by[6] + by[7]} == {6}
    assert (0, None) in by[None]
    kept = ngram_join.keep_one(d, 3, 90)
    assert kept.columns == d.columns
    assert collections.Counter(r.doc_id for r in kept.collect())[7] == 0
    s = collections.defaultdict(list)
    for r in suffix_dedup.digests(d).collect():
        s[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans))
    n = len(LONG)
    assert s[6] == [(n, n, 1)] and s[7] == [(n, n, 1)] * 2 and s[9] == [(5000, 5000, 1)] and s[1] == [(0, 0, 0)]
    assert s[10] == [(602, 600, 1)]
    cut = suffix_dedup.remove_repeats(d)
    assert cut.columns == d.columns and cut.count() == len(ODD)
    lines = line_dedup.dedup_lines(d)
    assert lines.columns == d.columns and lines.count() == len(ODD)
    got = {(r.doc_id, r.text) for r in lines.collect()}
    assert (None, None) in got and (1, None) in got and (2, "") in got and (8, "other") in got
    assert (None, "same line of text here") in got  # a null id is the least


def test_empty_table(docs):
    d = docs([])
    assert ngram_join.jaccard_components(d, 3, 90).count() == 0
    assert ngram_join.keep_one(d).count() == 0
    assert suffix_dedup.digests(d).count() == 0
    assert line_dedup.report(d).count() == 0


def base_stats(text):
    text = text or ""
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_base_statistics(docs):
    rows = ODD + [(20, "a b c a b c a b\nx\nx\n\n \n"), (21, "#a |b| <c> $% & *\x0b d\x0ce\rf\x1cg"), (22, "a b a b a b a")]
    d = docs(rows).select("doc_id", quality_rules.text_stats(__import__("pyspark.sql.functions", fromlist=["col"]).col("text")).alias("s"))
    got = sorted((r.doc_id is None, r.doc_id or 0, tuple(r.s)[:5]) for r in d.collect())
    assert got == sorted((i is None, i or 0, base_stats(t)) for i, t in rows)


def test_rules_learn_a_threshold(docs, llm):
    r = random.Random(6)
    rows = []
    for i in range(400):
        w = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(80)]
        if i % 3 == 0:
            w = [x + "***" if j % 2 else x for j, x in enumerate(w)]
        rows.append((i, " ".join(w)))
    d = docs(rows + [(None, None), (900, "too short")])
    labels = llm.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)] + [(None, 0), (5, None), (7777, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.quality(d, labels).collect()}
    held_out = [got[i] == (i % 3 != 0) for i in range(300, 400)]
    assert sum(held_out) >= 98
    assert got[900] is False and got[None] is False
    kept = quality_rules.keep_good(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    none = quality_rules.quality(d, labels.where("quality = 1"))
    assert none.where("rule <> 0").count() == 0
    assert quality_rules.quality(docs([]), labels).count() == 0


def test_near_lines_are_found_at_any_length(docs):
    """Of 60 pairs a length with one word changed, most are found (4-bit SimHashes of words: 9 to 62 %)."""
    r = random.Random(11)
    for words, least in ((12, 48), (20, 54), (40, 57)):
        first = [[r.choice(WORDS) + r.choice(WORDS) for _ in range(words)] for _ in range(60)]
        other = [list(x) for x in first]
        for x in other:
            k = r.randrange(words)
            x[k] = x[k][:-2] + "zq"
        rows = [(0, "\n".join(map(" ".join, first))), (1, "\n".join(map(" ".join, other)))]
        got = {x.doc_id: x.n_removed for x in line_dedup.report(docs(rows)).collect()}
        assert got[0] == 0 and got[1] >= least, (words, got)


def test_lines_of_any_length_and_script_are_grouped_when_equal(docs):
    long = "".join(chr(0x4E00 + random.Random(5).randrange(3000) + i) for i in range(60))
    rows = [(0, f"ok\n\n----\n\n{long}\nไทย\nthree short words"), (1, f"OK.\n\n----\n\n{long[:30]}字{long[30:]}\nไทย\nthree  short words\n===="),
            (None, "three short words")]
    got = {x.doc_id: x.kept_text for x in line_dedup.report(docs(rows)).collect()}
    assert got == {0: f"ok\n\n----\n\n{long}\nไทย", 1: "\n\n====", None: "three short words"}


def test_a_block_of_near_copies_is_dealt_out(docs, llm, monkeypatch):
    """A block above ``HOT`` is compared in parts, and its near copies are one group all the same."""
    monkeypatch.setattr(line_dedup, "HOT", 40)
    monkeypatch.setattr(line_dedup, "HUBS", 4)
    r = random.Random(3)
    base = [r.choice(WORDS) for _ in range(60)]
    lines = []
    for i in range(300):
        x = list(base)
        x[r.randrange(60)] = f"v{chr(97 + i % 26)}{chr(97 + i // 26)}"
        lines.append(" ".join(x))
    found, shared = line_dedup.block_neighbours(line_dedup.line_table(docs([(0, "\n".join(lines))])).withColumnRenamed("lid", "sid"))
    assert found.count() <= 300 * 16 * 2 * 8  # a row's nearest in each part, not all pairs (300 * 299 / 2 a block)
    assert shared.groupBy("key").count().where("count > 40").count() >= 1
    got = line_dedup.report(docs([(i, t) for i, t in enumerate(lines)])).where("n_removed = 1").count()
    assert got >= 297


def test_pieces_never_tell_near_lines_apart():
    """What the pieces rule out is not alike, whatever the edits; most of what is far apart is ruled out."""
    r = random.Random(4)
    xs, ys = [], []
    for _ in range(1500):
        x = r.choices("abcé😀 ", k=r.randrange(1, 90))
        y = list(x)
        for _ in range(r.randrange(0, 10)):
            k = r.randrange(len(y) + 1)
            y[k:k + r.randrange(2)] = r.choice(["", "z", "q"])
        xs.append("".join(x))
        ys.append("".join(y) or "q")
    ok = line_dedup.may_be_near(xs, ys)
    assert all(o or not line_dedup.alike(x, y) for o, x, y in zip(ok, xs, ys))
    far = [" ".join(r.choices(WORDS, k=60)) for _ in range(200)]
    assert line_dedup.may_be_near(far[:100], far[100:]).sum() <= 5
    assert line_dedup.may_be_near([], []).sum() == 0 and line_dedup.may_be_near(["ab"], ["c"]).all()


def test_sketches_never_tell_near_lines_apart():
    """Lines with as many edits as may be stay a pair, lines of the same words in another order do not; lines
    without a sketch stay one."""
    r = random.Random(6)
    xs, ys = [], []
    for n in (9, 10, 15, 30, 75, 150, 400, 900):
        for kind in range(60):
            x = "ab " * (n // 3) + "c" * (n % 3) if kind < 10 else " ".join(r.choices(WORDS, k=n))[:n]
            y = list(x)
            for k in range(n // 10):  # evenly, or anywhere
                k = 10 * k + 5 if kind % 2 else r.randrange(len(y))
                y[k:k + 1] = r.choice(["", "z", "é", "qq"]) if kind % 3 else "z"
            xs.append(x)
            ys.append("".join(y))
    near = np.array([line_dedup.alike(x, y) for x, y in zip(xs, ys)])

    def may(xs, ys):
        rows = [line_dedup.sketch_rows(line_dedup.sketches(x)) for x in (xs, ys)]
        return line_dedup.may_share(*rows, *[np.array([len(t) for t in x]) for x in (xs, ys)])
    assert near.sum() > 250 and may(xs, ys)[near].all()
    some = [["".join(r.choices("abcdefghijklmnop", k=3)) for _ in range(100)] for _ in range(200)]
    assert may([" ".join(x) for x in some], [" ".join(r.sample(x, 100)) for x in some]).sum() <= 4
    assert may(["", "ab", "x" * 300_000], ["a", "cd", "y" * 300_000]).all() and line_dedup.sketches([]) == []


def test_lines_of_the_same_words_are_not_read_as_pairs(docs, monkeypatch):
    """Lines with like SimHashes that are not alike; their texts are not fetched pair by pair."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnop", k=3)) for _ in range(80)]
    lines = [" ".join(r.sample(words, 80)) for _ in range(40)]
    lines.append(lines[3].replace(words[0], words[0] + "x"))
    read, real = [], line_dedup.LineVerifier.links

    def links(self, pairs):
        read.append(pairs.count())
        return real(self, pairs)
    monkeypatch.setattr(line_dedup.LineVerifier, "links", links)
    got = line_dedup.report(docs([(i, t) for i, t in enumerate(lines)])).where("n_removed = 1").collect()
    assert [x.doc_id for x in got] == [40] and sum(read) <= 30  # 780 pairs


def test_lines_of_one_language_seldom_meet(docs, monkeypatch):
    """Lines of the same words, whose SimHashes share blocks, have few index rows; near ones of any length meet."""
    monkeypatch.setattr(line_dedup, "DEPTHS", (0, 0, 0, 30_000_000), raising=False)
    r = random.Random(21)
    words = ["".join(r.choices("abcdefghijklmnop", k=3)) for _ in range(80)]
    lines = [" ".join(r.sample(words, 80)) for _ in range(300)]
    pairs = [(x, x.replace(x[4:7], "zzz", 1)) for x in lines[:20]] + [
        (x := "".join(r.choices("abcdefgh ", k=n)).strip().ljust(n, "x"), x[:-1] + "z") for n in (30, 60, 64, 68, 70, 74, 90)]
    d = docs([(0, "\n".join(lines)), (1, "\n".join(y for _, y in pairs)), (2, "\n".join(x for x, _ in pairs[20:]))])
    found, shared = line_dedup.block_neighbours(line_dedup.line_table(d).withColumnRenamed("lid", "sid"))
    assert shared.count() <= 3000  # each line with 40 of 299 others under some SimHash block before
    sid = {t: line_dedup._long(line_dedup.xxhash.xxh3_64_intdigest(t.encode())) for p in pairs for t in map(line_dedup.normal, p)}
    keys = collections.defaultdict(set)
    for x in shared.collect():
        keys[x.sid].add(x.key)
    assert all(keys[sid[line_dedup.normal(x)]] & keys[sid[line_dedup.normal(y)]] for x, y in pairs)


def test_short_lines_are_hashed_in_small_batches():
    lines = [f"line {i:05d}" for i in range(20_000)]
    some = list(line_dedup._batches(lines, 10, 70))
    assert [i for x in some for i in x] == list(range(20_000)) and max(map(len, some)) <= 2000
    sketches, keys = line_dedup.sketches_and_keys(lines[:50] + ["x" * 67, "short", "y" * 200_001], 24, 4)
    assert [len(k) for k in keys] == [96] * 50 + [192, 0, 96] and sketches[-1] == sketches[-2] == b"" and keys[0] != keys[1]


def test_a_walk_along_lines_never_needs_fewer_edits_than_there_are():
    r = random.Random(13)
    for _ in range(3000):
        a = "".join(r.choices("abc ", k=r.randrange(60)))
        b = list(a)
        for _ in range(r.randrange(8)):
            k = r.randrange(len(b) + 1)
            b[k:k + r.randrange(3)] = r.choice(["", "z", "ab"])
        most = r.randrange(10)
        assert not line_dedup.few_edits(a, "".join(b), most) or line_dedup.within(a, "".join(b), most)


def test_pairs_in_passes_give_the_same_links(docs, monkeypatch):
    r = random.Random(12)
    base = [" ".join(r.choices(WORDS, k=30)) for _ in range(4)]
    rows = [(0, "\n".join(base)), (1, "\n".join(b + " x" for b in base)), (2, "\n".join("y " + b for b in base))]
    passes, real = [], line_dedup.write
    monkeypatch.setattr(line_dedup, "PAIRS", 1)
    monkeypatch.setattr(line_dedup, "write", lambda df, *a: (passes.append(a), real(df, *a)))
    d = docs(rows)
    lines = line_dedup.line_table(d).selectExpr("lid AS sid", "struct(doc_id, tid, line) AS first")
    ids = [x.sid for x in lines.collect()]
    pairs = d.sparkSession.createDataFrame([(a, b) for a in ids for b in ids if a < b], "a long, b long")
    got = line_dedup.LineVerifier(d, lines).links(pairs).collect()
    assert len(passes) == 3 and len(got) == len(set(got)) == 12  # three versions of each of four lines


def test_tables_of_a_stage_go_when_its_result_is_written(docs, llm):
    """What line dedup and the n-gram join leave under the checkpoint folder is their result, not every table on the way."""
    import os

    from parlance.session import checkpoint_dir

    def left():
        return {f for f in os.listdir(checkpoint_dir(llm).removeprefix("file:")) if not f.startswith("passing-") or os.listdir(
            os.path.join(checkpoint_dir(llm).removeprefix("file:"), f))}
    d = docs([(i, f"{t}\none line more that is the same") for i, t in texts(9, 30)]).cache()
    for stage in (line_dedup.dedup_lines, lambda d: ngram_join.keep_one(d, 5, 80)):
        had = left()
        got = stage(d)
        first, again = sorted(got.collect()), sorted(got.collect())
        assert first == again and len(left() - had) == 1


def test_a_written_table_leaves_no_shuffle_files(llm):
    import time

    from parlance.sources.io import materialize
    disk, key = llm._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def files():
        x = disk.getAllFiles()
        return {f for i in range(x.size()) if (f := x.apply(i).getName()).startswith("shuffle_")}
    had, before = files(), llm.conf.get(key)
    made = materialize(llm.range(5000).repartition(7, "id").groupBy("id").count(), "shuffled")
    for _ in range(50):
        if not files() - had:
            break
        time.sleep(0.2)
    assert not files() - had and llm.conf.get(key) == before and made.count() == 5000
