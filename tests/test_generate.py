from pyspark.sql import functions as F

from parlance.operators import generate as G, templates as T
from tests.conftest import rows


class Scripted:
    """Factory whose replies / failures are fixed per (key, attempt)."""

    def __init__(self, plan):
        self.plan = plan

    def __call__(self):
        plan = self.plan

        def gen(messages, key=None, attempt=1, **kw):
            what = plan.get((key, attempt), "ok")
            if what != "ok":
                raise RuntimeError(what)
            return {"id": f"r{key}", "model": "m", "content": f" answer {key} ", "finish_reason": "stop",
                    "reasoning_content": None, "usage": {"total_tokens": 3, "prompt_tokens": 2, "completion_tokens": 1}}
        return gen


def _requests(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id bigint, text string")
    return df.select("id", T.user_messages("text").alias("messages"))


def test_every_row_gets_a_status(spark):
    plan = {(2, 1): "RateLimitError", (2, 2): "RateLimitError", (2, 3): "RateLimitError",
            (3, 1): "RateLimitError", (3, 2): "InvalidRequestError: filtered"}
    res = G.generate_batch(_requests(spark), Scripted(plan), backoff=(0.0, 0.0))
    got = {r.id: (r.status, r.attempts) for r in res.collect()}
    assert got == {1: ("ok", 1), 2: ("exhausted", 3), 3: ("filtered", 2), 4: ("skipped", 0)}
    flat = G.flatten_response(res).filter("status = 'ok'").first()
    assert flat.content == " answer 1 " and flat.total_tokens == 3


def test_resume_calls_only_pending(spark, tmp_dir):
    reqs = _requests(spark)
    out = f"{tmp_dir}/gen"
    first = G.generate_resumable(reqs.filter("id <= 2"), Scripted({}), out, backoff=(0.0, 0.0))
    assert first.count() == 2
    again = G.generate_resumable(reqs, Scripted({}), out, backoff=(0.0, 0.0))
    assert rows(again, "id") == [(1,), (2,), (3,), (4,)]
    assert spark.read.parquet(out).count() == 4  # ids 1, 2 were not called twice


def test_last_segment_and_reasoning(spark):
    df = spark.createDataFrame([("user\nq\nassistant\n  the answer \n",), ("no marker",)], "t string")
    assert [r[0] for r in df.select(G.last_segment("t")).collect()] == ["the answer", "no marker"]
    d2 = spark.createDataFrame([("\nplan\n</think>\n\nok\n",), ("plain",), ("a</think>b</think>\nc",)], "t string")
    r, c = G.split_reasoning("t")
    assert [tuple(x) for x in d2.select(r, c).collect()] == [("plan", "ok"), ("", "plain"), ("a</think>b", "c")]


def test_run_summary_zero_examples(spark):
    empty = spark.createDataFrame([], "elapsed_s double")
    r = G.run_summary(empty, {"temperature": 0.4}).first()
    assert r.example_numbers == 0 and r.average_time is None and r.temperature == 0.4


class Counted:
    """Factory that counts its calls in an accumulator; ``fails`` ids raise on every attempt."""

    def __init__(self, calls, fails=()):
        self.calls, self.fails = calls, fails

    def __call__(self):
        def gen(messages, key=None, attempt=1, **kw):
            self.calls.add(1)
            if key in self.fails:
                raise RuntimeError("RateLimitError")
            return {"id": f"r{key}", "model": kw.get("model", "m"), "content": "x", "finish_reason": "stop", "reasoning_content": None,
                    "usage": {"total_tokens": 1, "prompt_tokens": 1, "completion_tokens": 0}}
        return gen


def test_pending_rows_only_are_called_and_exhausted_ones_again(spark, tmp_dir):
    reqs, out = _requests(spark), f"{tmp_dir}/gen"
    calls = spark.sparkContext.accumulator(0)
    first = G.generate_resumable(reqs, Counted(calls, {2}), out, backoff=(0.0, 0.0), partitions=2, ranges=3)
    assert calls.value == 2 + 3  # ids 1 and 3 once, id 2 three times, id 4 skipped
    assert {r.id: r.status for r in first.collect()} == {1: "ok", 2: "exhausted", 3: "ok", 4: "skipped"}
    again = G.generate_resumable(reqs, Counted(calls), out, backoff=(0.0, 0.0), partitions=2, ranges=3)
    assert calls.value == 6
    assert {r.id: r.status for r in again.collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "skipped"}
    assert again.count() == 4 and calls.value == 6  # reading the table calls nothing


class Logged:
    """Factory that leaves a file for every call; its process dies at the call of ``dies``."""

    def __init__(self, log, dies=None):
        self.log, self.dies = log, dies

    def __call__(self):
        import os
        import uuid

        def gen(messages, key=None, attempt=1, **kw):
            open(f"{self.log}/{key}-{uuid.uuid4().hex}", "w").close()
            if key == self.dies:
                os._exit(1)
            return {"id": f"r{key}", "model": "m", "content": f"c{key}", "finish_reason": "stop", "reasoning_content": None,
                    "usage": {"total_tokens": 1, "prompt_tokens": 1, "completion_tokens": 0}}
        return gen


def test_a_killed_run_repeats_no_published_call(spark, tmp_dir):
    import collections
    import os
    import pytest
    for d in ("log", "again"):
        os.mkdir(f"{tmp_dir}/{d}")
    out = f"{tmp_dir}/gen"
    reqs = spark.range(200).selectExpr("id", "array(named_struct('role', 'user', 'content', cast(id as string))) as messages")
    calls = lambda d: collections.Counter(int(f.split("-")[0]) for f in os.listdir(f"{tmp_dir}/{d}"))
    with pytest.raises(Exception):
        G.generate_resumable(reqs.coalesce(1), Logged(f"{tmp_dir}/log", 150), out, commit="task", partitions=40)
    stored = {r.id for r in spark.read.schema(G.RESULT_SCHEMA).parquet(out).collect()} if os.path.isdir(out) else set()
    assert stored and 150 not in stored and stored <= set(calls("log"))
    got = G.generate_resumable(reqs, Logged(f"{tmp_dir}/again"), out, commit="task", partitions=4)
    assert {r.id: r.status for r in got.collect()} == dict.fromkeys(range(200), "ok")
    assert set(calls("again")) == set(range(200)) - stored and max(calls("again").values()) == 1
    assert G.generate_resumable(reqs.limit(0), Logged(f"{tmp_dir}/again"), f"{tmp_dir}/none", commit="task").count() == 0
    with pytest.raises(ValueError):
        G.generate_resumable(reqs, Logged("x"), out, commit="job")


def test_own_parameters_and_concurrency(spark):
    calls = spark.sparkContext.accumulator(0)
    reqs = _requests(spark).selectExpr("*", "concat('{\"model\":\"m', id, '\"}') as own")
    res = G.generate_batch(reqs, Counted(calls), params={"model": "all"}, params_col="own", concurrency=3, partitions=1)
    assert {r.id: r.model for r in G.flatten_response(res).collect()} == {1: "m1", 2: "m2", 3: "m3", 4: None}


def test_resolve_attempts(spark):
    log = spark.createDataFrame([(1, 1, "RateLimitError"), (1, 2, None), (1, 3, "late"), (2, 1, "filtered"), (2, 2, None),
                                 (3, 1, "a"), (3, 2, "b"), (3, 3, "c"), (3, 4, None), (4, 1, "a")], "id long, attempt int, error string")
    got = {r.id: tuple(r)[1:] for r in G.resolve_attempts(log).collect()}
    assert got == {1: ("ok", 2, None), 2: ("filtered", 1, "filtered"), 3: ("exhausted", 3, "c"), 4: ("pending", 1, "a")}
