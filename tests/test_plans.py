"""Plan checks and the driver contract."""

import pytest

from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def entry_module():
    import __spark_entry__ as E
    return E


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark, entry_module):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert {"conv_id", "turn", "batch_id", "ids", "labels", "mask"} <= set(df.columns)


def test_every_query_has_an_oracle(entry_module):
    from parlance.plans.registry import ORACLE, QUERIES
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLE) <= set(entry_module.oracle_sql())


NO_PYTHON = ["sft_batches", "chatml_source", "tokenize_truncate", "label_mask", "pad_right", "attention_mask",
             "prompt_truncate", "dispatch_tools", "mentions", "token_f1", "alert_report"]  # corpus scores count in Arrow batches


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_udf_in_sql_operators(spark, entry_module, name):
    plan = _plan(entry_module.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "MapInPandas" not in plan


def test_rank_has_no_single_partition_exchange_over_rows(spark, entry_module):
    """One-partition windows run over the bucket-count table (bounded by 16^4 rows) and over the
    table of range heads of PRJ-1 (a row per range), never over rows."""
    df = entry_module.queries()["seeded_shuffle"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    below = [part[:600] for part in plan.split("Exchange SinglePartition")[1:]]
    assert below and all("HashAggregate(keys=[_rk_bucket" in b or "SortAggregate(key=[_part" in b for b in below)


def _below_first_repartition(df):
    """Optimized logical plan text under the first ``RepartitionByExpression`` (a spread)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    return plan.split("RepartitionByExpression", 1)[1]


def test_tokenizing_stays_above_the_spread_exchange(spark):
    """explode_rows keeps Catalyst from inferring ``size(tokens) > 0`` and pushing the whole
    tokenization below the spread (where it would run again, in the scan's few tasks)."""
    from pyspark.sql import functions as F
    from parlance.functions.text import explode_rows
    from parlance.operators import tokens as K
    from parlance.plans.spread import spread
    df = spark.createDataFrame([(1, "a b <|im_end|> c"), (2, "")], "k long, t string")
    tok = spread(df, "k").select("k", K.split_tokens("t").alias("toks"))
    out = explode_rows(tok, ["k"], "toks", "token")
    assert "regexp_replace" not in _below_first_repartition(out)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "<|im_end|>"), (1, "a"), (1, "b"), (1, "c")]
    # the inner explode would push it down - the reason for the helper
    bad = tok.select("k", F.explode("toks").alias("token"))
    assert "regexp_replace" in _below_first_repartition(bad)


def test_tool_dispatch_not_pushed_into_scan(spark, entry_module):
    """The tool replies carry no filter on the result, so the dispatch CASE is evaluated once,
    after the exchange, and never as a scan-side data filter."""
    df = entry_module.queries()["tool_turn_messages"](spark, SF_SMALL)
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")  # print whole expressions
    try:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)
    parse = "parseJson"  # try_parse_json after Catalyst replaces it
    assert parse in plan
    filters = [line for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter")]
    assert not any(parse in line for line in filters)


def test_pandas_map_queries_run_from_any_working_directory(tmp_dir):
    """The driver may import __spark_entry__ from elsewhere: the Python workers must still
    import the package (shipped with addPyFile), or every mapInPandas step fails."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spec = importlib.util.spec_from_file_location("entry_mod", "{root}/__spark_entry__.py")
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
print("ROWS", E.queries()["generate_batch"](spark, "{SF_SMALL}").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_dir, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    assert int(out.stdout.split("ROWS")[1].split()[0]) > 0


def test_capped_documents_are_cut_before_collecting(spark):
    """PRJ-11 with a cap: a request holding most documents keeps its first N by pos, and the
    cut runs as a WindowGroupLimit (partial before the shuffle), not after collect_list."""
    from parlance.operators.joins import attach_documents
    req = spark.createDataFrame([(1,), (2,), (3,)], "rid long")
    docs = spark.createDataFrame([(1, p, f"t{p}", f"x{p}") for p in range(500)] + [(2, 5, "a", "b"), (2, 1, "c", "d")],
                                 "request_id long, pos int, title string, text string").repartition(4)
    out = attach_documents(req, docs, "rid", max_documents=3)
    got = sorted((r["rid"], r["n_documents"], [d["title"] for d in r["documents"]]) for r in out.collect())
    assert got == [(1, 3, ["t0", "t1", "t2"]), (2, 2, ["c", "a"]), (3, 0, [])]
    assert "WindowGroupLimit" in _plan(out)


def test_flagship_tokenizes_once(spark, entry_module):
    """The vocabulary and the tokens are written tables: the main plan splits no text. It explodes the
    stored tokens for the frequent ones and for the rest, and ranks keys only."""
    df = entry_module.queries()["sft_batches"](spark, SF_SMALL)
    plan = _plan(df)
    assert "split(" not in plan and "regexp_replace" not in plan and "instruction" not in plan
    assert plan.count("Generate") == 2
