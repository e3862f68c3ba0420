"""op12: the law, the levels of the tree, slots, and odd rows."""

import collections
import zlib

import pytest
from pyspark.sql import functions as F

from parlance.llm import sharding
from parlance.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD
from tests.oracle_check import compare, duck


def placed(df, tree, grown=None):
    cols = ["region", "rack", "shard"] + (["grown_shard"] if grown else [])
    return {r.doc_id: tuple(r)[1:] for r in sharding.assign(df, tree, grown).select("doc_id", *cols).collect()}


@pytest.fixture(scope="module")
def keys(llm):
    return llm.range(20_000).withColumnRenamed("id", "doc_id")


def test_sql(spark):
    name = "op12_weighted_hash_tree"
    problems, n, _, _ = compare(spark, duck(SF_SMALL), name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert not problems and n == 200


@pytest.mark.parametrize("n", [1, 4, 5, 20, 40])
def test_one_more_shard_takes_rows_only_into_itself(keys, n):
    got = placed(keys, sharding.even_tree(n), sharding.even_tree(n + 1))
    moved = [r for r in got.values() if r[3] != r[2]]
    assert all(r[3] == n for r in moved)
    assert abs(len(moved) / 20_000 * (n + 1) - 1) < 0.15
    count = collections.Counter(r[2] for r in got.values())
    assert set(count) == set(range(n)) and max(count.values()) < 1.2 * 20_000 / n


def test_every_level_takes_its_share_by_weight(keys):
    weights = [1.0, 3.0, 0.0, 2.0, 2.0, 4.0, 1.0, 5.0, 2.0]
    tree = sharding.Tree(tuple(weights), (0, 3, 5, 6, 8), (0, 2, 4))
    got = placed(keys, tree)
    inside = {s: (sum(b <= a for b in tree.regions) - 1, a) for s in range(9) for a in [sum(b <= s for b in tree.racks) - 1]}
    assert all((r, k) == inside[s] for r, k, s in got.values())
    for level in range(3):
        want = collections.Counter()
        for s, w in enumerate(weights):
            want[(*inside[s], s)[level]] += w / 20
        have = collections.Counter(v[level] for v in got.values())
        assert all(abs(have[c] / 20_000 - share) < 0.012 for c, share in want.items())
        assert have.keys() <= want.keys()


def test_a_changed_weight_moves_rows_only_over_its_own_path(keys):
    before = sharding.Tree((1.0,) * 12, (0, 3, 6, 9), (0, 2))
    for w in (2.0, 0.25, 0.0):
        after = sharding.Tree((1.0,) * 7 + (w,) + (1.0,) * 4, (0, 3, 6, 9), (0, 2))
        a, b = placed(keys, before), placed(keys, after)
        moved = [(a[k][2], b[k][2]) for k in a if a[k][2] != b[k][2]]
        assert moved and all((y if w > 1 else x) == 7 for x, y in moved)


def test_bad_trees():
    for args in (((), (0,), (0,)), ((1.0,), (1,), (0,)), ((1.0, 1.0), (0, 2), (0,)), ((0.0,), (0,), (0,)),
                 ((float("nan"),), (0,), (0,)), ((-1.0, 2.0), (0,), (0,)), ((1.0, 1.0), (0, 0), (0,))):
        with pytest.raises(ValueError):
            sharding.Tree(*args)


def test_odd_rows(docs, llm):
    rows = ODD + [(50, "same")] * 400 + [(None, f"text {i}") for i in range(300)] + [(-9, "x"), (1 << 62, "y")]
    got = sharding.report(docs(rows)).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.doc_id == 50}) == 1
    again = sharding.report(docs(rows[::-1]).repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert sharding.report(docs([])).count() == 0


def test_shards_are_written_whole(docs, llm, tmp_dir):
    rows = [(i, f"text {i}") for i in range(500)]
    tree = sharding.even_tree(7)
    out = sharding.assign(docs(rows), tree)
    assert out.columns == docs(rows).columns + ["region", "rack", "shard"]
    sharding.write_shards(out, f"{tmp_dir}/s", 3)
    back = llm.read.parquet(f"{tmp_dir}/s")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == rows
    files = back.select("shard", F.input_file_name().alias("f")).distinct().groupBy("shard").count().collect()
    assert len(files) == 7 and all(r["count"] <= 3 for r in files)
