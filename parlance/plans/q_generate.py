"""Registered queries: batch generation (INF-*, JN-1/2, SET-1, PRJ-10, FLT-2) with a user's generator,
and reports over stored results (INF-2..4, FLT-4, AGG-1..3), which ``events`` stand in for."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions.text import WS_CLASS
from parlance.operators import filters, generate as G, joins, templates as T, batching
from parlance.plans import inputs
from parlance.plans.q_prep import IDX_SQL
from parlance.plans.q_sft import PAIRS_SQL
from parlance.plans.rank import rank_index
from parlance.plans.registry import query
from parlance.plans.sqltext import strip
from parlance.sources.io import materialize, scratch_path
from parlance.sources.json_array import can_open

NO_WAIT = (0.0, 0.0)
SETTINGS = {"temperature": 0.4, "do_sample": True, "max_new_tokens": 1024, "top_k": 40, "top_p": 0.85,
            "repetition_penalty": 1.05}


class ReverseWords:
    """A user's generator factory (UDF-3): the reply is the words of the last user message in
    reverse order. Any picklable factory with this call shape plugs into INF-1."""

    def __call__(self):
        def gen(messages, key=None, attempt=1, **params):
            last = next((m.get("content") or "" for m in reversed(messages) if m.get("role") == "user"), "")
            content = " ".join(reversed(last.split()))
            n_in, n_out = sum(len((m.get("content") or "").split()) for m in messages), len(content.split())
            return {"id": f"reverse-{key}", "model": params.get("model", "reverse-words"), "content": content, "finish_reason": "stop",
                    "reasoning_content": None,
                    "usage": {"total_tokens": n_in + n_out, "prompt_tokens": n_in, "completion_tokens": n_out}}
        return gen


def _ws_sql(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split_regex({s}, '{WS_CLASS}+') END)"


_SYS = T.DEFAULT_SYSTEM_INFERENCE
GEN_CTES = f"""{IDX_SQL},
req AS (SELECT idx AS id, conv_id, turn, input, output, original_events FROM (
  SELECT *, CAST(to_json({{'conv_id': conv_id, 'turn': turn}}) AS VARCHAR) AS original_events, instruction AS input FROM idxd)),
flat AS (SELECT *, 'ok' AS status, CAST(1 AS INTEGER) AS attempts, 'reverse-words' AS model,
  array_to_string(list_reverse({_ws_sql('input')}), ' ') AS content,
  CAST(len({_ws_sql('input')}) AS BIGINT) AS completion_tokens,
  CAST(len({_ws_sql(repr(_SYS))}) + len({_ws_sql('input')}) AS BIGINT) AS prompt_tokens FROM req)"""


def requests(spark, sf, records=None):
    """Requests of the indexed records, or of a rank index's table."""
    r = inputs.indexed_records(spark, sf) if records is None else records
    return r.select(F.col("idx").alias("id"), "conv_id", "turn", "input", "output", "original_events",
                    T.system_user_messages("input", _SYS).alias("messages"))


def results(spark, sf, **settings):
    """The written results of one run over all requests: reports and joins read the table, so no
    row is called twice."""
    res = G.generate_batch(requests(spark, sf), ReverseWords(), backoff=NO_WAIT, **settings)
    return G.flatten_response(materialize(res, "results"))


def answered(spark, sf):
    """Requests and their written results, both bucketed by the same index, so that they are joined
    where they lie."""
    ix = inputs.record_index(spark, sf)
    req = requests(spark, sf, ix.table)
    res = rank_index(G.generate_batch(req, ReverseWords(), backoff=NO_WAIT), "id", "results")
    return req, G.flatten_response(res.table)


@query("generate_batch", f"WITH {GEN_CTES} SELECT id, status, attempts, content, prompt_tokens + completion_tokens AS total_tokens FROM flat")
def q_generate_batch(spark, sf):
    """INF-1: one generator call per request row."""
    return results(spark, sf).select("id", "status", "attempts", "content", "total_tokens")


@query("flatten_response", f"WITH {GEN_CTES} SELECT id, 'reverse-' || id AS response_id, model, "
       "content, 'stop' AS finish_reason, prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens FROM flat")
def q_flatten_response(spark, sf):
    """INF-3: response JSON -> flat fields and usage (answered rows)."""
    f = results(spark, sf).filter(F.col("status") == "ok")
    return f.select("id", "response_id", "model", "content", "finish_reason", "prompt_tokens",
                    "completion_tokens", "total_tokens")


@query("generator_interface", f"WITH {GEN_CTES} SELECT id, status, attempts, 'mine-' || (id % 3) AS model, content FROM flat")
def q_generator_interface(spark, sf):
    """UDF-3: a user's generator factory, with each request's own parameters (PRJ-12 -> INF-1) and
    four calls at a time in a task; results are published as tasks make them (in ranges where the
    store is open to Spark only), and a rerun into the same folder would call only rows without one."""
    own = F.to_json(F.struct(F.concat(F.lit("mine-"), F.pmod("id", F.lit(3)).cast("string")).alias("model")))
    req = requests(spark, sf, inputs.record_index(spark, sf).table)
    out = scratch_path(spark, "generated")
    res = G.generate_resumable(req.withColumn("own", own), ReverseWords(), out, commit="task" if can_open(out) else "range",
                               backoff=NO_WAIT, params_col="own", concurrency=4)
    return G.flatten_response(res).select("id", "status", "attempts", "model", "content")


@query("attach_outputs", f"WITH {GEN_CTES} SELECT id AS idx, input, output, content AS model_output FROM flat")
def q_attach_outputs(spark, sf):
    """JN-1: generated text onto its source row by ``idx``."""
    req, res = answered(spark, sf)
    out = joins.attach_outputs(req.select("id", "input", "output"), res.select("id", F.col("content").alias("model_output")), "id")
    return out.withColumnRenamed("id", "idx")


@query("resume_pending", f"WITH {GEN_CTES} SELECT id AS idx, conv_id, turn FROM flat WHERE id % 4 <> 0 OR id >= (SELECT count(*) // 4 * 4 FROM flat)")
def q_resume_pending(spark, sf):
    """JN-2: inputs that a run of shard 0 of 4 (BAT-6) left without output: what a resumed run
    must call."""
    src = materialize(requests(spark, sf).select(F.col("id").alias("idx"), "conv_id", "turn"), "requests")
    done = batching.strided_shard(src, "idx", 4).where("shard = 0")
    return joins.resume_pending(src, done, "idx")


@query("merge_shards", f"WITH {GEN_CTES} SELECT id AS idx, CAST(id % 4 AS INTEGER) AS shard, content FROM flat")
def q_merge_shards(spark, sf):
    """SET-1: outputs of the four strided shards (BAT-6) plus the previous run's outputs
    (stand-in: the dropped tail, run earlier) in one UNION ALL."""
    f = materialize(results(spark, sf).select(F.col("id").alias("idx"), "content"), "outputs")
    shards = batching.strided_shard(f, "idx", 4)
    tail = f.join(shards.select("idx"), "idx", "left_anti").withColumn("shard", F.pmod("idx", F.lit(4)).cast("int"))
    return joins.merge_shards(shards, tail).select("idx", "shard", "content")


@query("result_projection", f"""WITH {GEN_CTES}
SELECT id AS idx, 'reverse-words' AS generator, input, original_events, output, {strip("content")} AS model_output FROM flat""")
def q_result_projection(spark, sf):
    """PRJ-10: the inference output row (model output stripped)."""
    req, res = answered(spark, sf)
    f = res.withColumn("mo", F.coalesce("content", F.lit("")))
    return T.result_projection(f.join(req.select("id", "input", "original_events", "output"), "id"), "reverse-words", "id", "input", "original_events", "output", "mo")


# ---- reports over stored results (stand-in: events) ---------------------------------------------
_ERR = """CASE event_type WHEN 'error' THEN 'RateLimitError: too many requests'
  WHEN 'signup' THEN 'InvalidRequestError: filtered' WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'TimeoutError: no answer' END END"""
RES_CTES = f"""ev AS (SELECT event_id // 3 AS id, CAST(event_id % 3 + 1 AS INTEGER) AS attempt, {_ERR} AS error, value AS elapsed_s,
  'model-' || (user_id % 3) AS model, user_id % 512 AS prompt_tokens, event_id % 256 AS completion_tokens FROM events),
first_end AS (SELECT id, min(attempt) AS a FROM ev WHERE error IS NULL OR regexp_matches(error, 'InvalidRequestError|filtered') GROUP BY id),
late AS (SELECT id, max(attempt) AS n FROM ev GROUP BY id),
stored AS (SELECT l.id, e.attempt AS attempts, e.error, e.model, e.prompt_tokens, e.completion_tokens,
  CASE WHEN f.a IS NOT NULL THEN CASE WHEN e.error IS NULL THEN 'ok' ELSE 'filtered' END WHEN l.n >= 3 THEN 'exhausted' ELSE 'pending' END AS status,
  (SELECT sum(x.elapsed_s) FROM ev x WHERE x.id = l.id AND x.attempt <= e.attempt) AS elapsed_s
  FROM late l LEFT JOIN first_end f USING (id) JOIN ev e ON e.id = l.id AND e.attempt = coalesce(f.a, l.n))"""


def attempts_log(spark, sf):
    """Attempts ``id, attempt, error, elapsed_s, model, prompt_tokens, completion_tokens`` shaped
    from ``events``: three consecutive events are the attempts of one request, the event type says
    how an attempt ended and ``value`` how long it took."""
    e = inputs.table(spark, sf, "events")
    error = (F.when(F.col("event_type") == "error", "RateLimitError: too many requests")
             .when(F.col("event_type") == "signup", "InvalidRequestError: filtered")
             .when((F.col("event_type") == "click") & (F.col("user_id") % 2 == 0), "TimeoutError: no answer"))
    return e.select(F.floor(F.col("event_id") / 3).alias("id"), (F.col("event_id") % 3 + 1).cast("int").alias("attempt"), error.alias("error"),
                    F.col("value").alias("elapsed_s"), F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"),
                    (F.col("user_id") % 512).alias("prompt_tokens"), (F.col("event_id") % 256).alias("completion_tokens"))


def stored_results(spark, sf):
    """One row per request: its status by INF-2, the attempt that ended it, the time of all its
    attempts up to that one."""
    log = attempts_log(spark, sf)
    done = G.resolve_attempts(log)
    j = log.drop("error").join(done, "id").where(F.col("attempt") <= F.col("attempts"))
    last = F.max_by(F.struct("model", "prompt_tokens", "completion_tokens"), "attempt")
    per = j.groupBy("id", "status", "attempts", "error").agg(F.sum("elapsed_s").alias("elapsed_s"), last.alias("l"))
    return per.select("id", "status", "attempts", "error", "elapsed_s", "l.*", F.lit("stop").alias("finish_reason"),
                      (F.col("l.prompt_tokens") + F.col("l.completion_tokens")).alias("total_tokens"))


@query("retry_policy", f"WITH {RES_CTES} SELECT id, status, attempts, error FROM stored")
def q_retry_policy(spark, sf):
    """INF-2: at most 3 attempts count, a filtered one is terminal, every request keeps a status."""
    return G.resolve_attempts(attempts_log(spark, sf))


@query("failed_batch_skip", f"""WITH {RES_CTES}
SELECT CAST(id // 8 AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS rows,
  CAST(sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS ok,
  CAST(sum(CASE WHEN status != 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) = 0 AS lost FROM stored GROUP BY id // 8""")
def q_failed_batch_skip(spark, sf):
    """INF-4: per batch of 8 requests, rows answered and failed, and whether the batch is lost."""
    f = batching.assign_batches(stored_results(spark, sf), "id", 8, one_based=False)
    return G.batch_report(f)


@query("content_filter_class", f"WITH {RES_CTES} SELECT id, status, coalesce(regexp_matches(error, 'InvalidRequestError|filtered'), false) AS filtered FROM stored")
def q_content_filter_class(spark, sf):
    """FLT-4: error text marking a content-filter refusal."""
    f = stored_results(spark, sf)
    return f.select("id", "status", filters.is_content_filtered("error").alias("filtered"))


@query("run_summary", f"""WITH {RES_CTES}
SELECT round(sum(elapsed_s), 6) AS total_time, CAST(count(*) AS BIGINT) AS example_numbers,
  round(sum(elapsed_s) / count(*), 9) AS average_time, CAST(0.4 AS DOUBLE) AS temperature, true AS do_sample,
  CAST(1024 AS INTEGER) AS max_new_tokens, CAST(40 AS INTEGER) AS top_k, CAST(0.85 AS DOUBLE) AS top_p, CAST(1.05 AS DOUBLE) AS repetition_penalty FROM stored""")
def q_run_summary(spark, sf):
    """AGG-1: total/average generation time, example count, the settings actually used."""
    s = G.run_summary(stored_results(spark, sf), SETTINGS)
    return s.select(F.round("total_time", 6).alias("total_time"), "example_numbers",
                    F.round("average_time", 9).alias("average_time"), *SETTINGS.keys())


@query("status_counts", f"WITH {RES_CTES} SELECT status, CAST(count(*) AS BIGINT) AS n FROM stored GROUP BY status")
def q_status_counts(spark, sf):
    """AGG-2: requests per final status."""
    return G.status_counts(stored_results(spark, sf))


@query("usage_totals", f"""WITH {RES_CTES} SELECT model, 'stop' AS finish_reason, CAST(count(*) AS BIGINT) AS responses,
  CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM stored WHERE status = 'ok' GROUP BY model""")
def q_usage_totals(spark, sf):
    """AGG-3: token usage totals per model and finish reason."""
    return G.usage_totals(stored_results(spark, sf))


@query("empty_user_guard", f"""WITH last AS (SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text,
  CAST(count(*) AS BIGINT) AS n_messages FROM conversations GROUP BY conv_id)
SELECT conv_id, n_messages, role AS last_role,
  CASE WHEN role = 'user' AND conv_id % 7 = 0 THEN 'skipped' ELSE 'call' END AS action FROM last""")
def q_empty_user_guard(spark, sf):
    """FLT-2: a conversation whose last message is a user message with null content is not
    sent. Stand-in: the user contents of every seventh conversation arrive as null."""
    c = inputs.conversations(spark, sf)
    c = c.withColumn("content", F.when((F.col("role") == "user") & (F.pmod("conv_id", F.lit(7)) == 0), F.lit(None))
                     .otherwise(F.col("text")))
    last = c.groupBy("conv_id").agg(F.max_by(F.struct("role", "content"), "turn").alias("m"),
                                    F.count(F.lit(1)).alias("n_messages"))
    skip = filters.empty_user_guard(F.col("m.role"), F.col("m.content"))
    return last.select("conv_id", "n_messages", F.col("m.role").alias("last_role"),
                       F.when(skip, "skipped").otherwise("call").alias("action"))


_WRAPPED = "'user' || chr(10) || instruction || chr(10) || 'assistant' || chr(10) || output"


@query("last_segment", f"""WITH {IDX_SQL} SELECT idx, {strip(f"string_split({_WRAPPED}, 'assistant')[-1]")} AS answer FROM idxd""")
def q_last_segment(spark, sf):
    """INF-5: decoded prompt+answer text -> text after the last 'assistant', stripped."""
    r = inputs.indexed_records(spark, sf)
    dec = F.concat(F.lit("user\n"), "input", F.lit("\nassistant\n"), "output")
    return r.select("idx", G.last_segment(dec).alias("answer"))


_THINK = ("CASE turn % 3 WHEN 0 THEN chr(10) || '<think>' || chr(10) || instruction || chr(10) || '</think>' || chr(10) || chr(10) || output "
          "WHEN 1 THEN output ELSE '<think>a</think>b</think>' || chr(10) || output || chr(10) END")


@query("split_reasoning", f"""WITH {PAIRS_SQL}, t AS (SELECT conv_id, turn, {_THINK} AS c FROM pairs),
s AS (SELECT conv_id, turn, c, CASE WHEN position('</think>' IN c) > 0 THEN
  substr(c, 1, length(c) - length(string_split(c, '</think>')[-1]) - 8) ELSE '' END AS r,
  CASE WHEN position('</think>' IN c) > 0 THEN string_split(c, '</think>')[-1] ELSE c END AS a FROM t)
SELECT conv_id, turn, regexp_replace(r, '^\\n+|\\n+$', '', 'g') AS reasoning, regexp_replace(a, '^\\n+|\\n+$', '', 'g') AS content FROM s""")
def q_split_reasoning(spark, sf):
    """INF-6: reasoning before the last ``</think>``, content after; newline-stripped."""
    r = inputs.sft_records(spark, sf)
    m = F.pmod("turn", F.lit(3))
    c = (F.when(m == 0, F.concat(F.lit("\n<think>\n"), "instruction", F.lit("\n</think>\n\n"), "output"))
         .when(m == 1, F.col("output"))
         .otherwise(F.concat(F.lit("<think>a</think>b</think>\n"), "output", F.lit("\n"))))
    reasoning, content = G.split_reasoning(c)
    return r.select("conv_id", "turn", reasoning.alias("reasoning"), content.alias("content"))
