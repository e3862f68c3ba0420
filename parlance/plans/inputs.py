"""Stand-in inputs derived from the driver's test tables.

Each function only reshapes rows into the schema an operator expects; the operator's own
work happens in ``parlance.operators``. Nothing here filters rows to make a check cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def sft_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SFT contract rows ``(conv_id, turn, instruction, output)`` via PRJ-1."""
    from parlance.operators.templates import conversation_pairs
    return conversation_pairs(conversations(spark, sf_dir))


def indexed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference records: SFT pairs with a dense 0-based ``idx`` in seeded md5 order (ORD-1),
    ``input`` = instruction, ``output`` = gold reply, ``original_events`` = source key JSON."""
    from parlance.operators.ordering import seeded_shuffle
    ranked = seeded_shuffle(sft_records(spark, sf_dir), ["conv_id", "turn"], 42, "rank")
    return ranked.select(
        (F.col("rank") - 1).alias("idx"), "conv_id", "turn", F.col("instruction").alias("input"),
        F.to_json(F.struct("conv_id", "turn")).alias("original_events"), "output")


def record_index(spark: SparkSession, sf_dir: str):
    """``indexed_records`` written once, bucketed by ``idx``, and their number."""
    from parlance.plans.rank import rank_index
    return rank_index(indexed_records(spark, sf_dir), "idx", "records")


def group_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-chat agents (``pos, name, description, is_human``) shaped from ``customer``."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"),
                    F.col("c_mktsegment").alias("description"),
                    (F.col("c_acctbal") < 0).alias("is_human"))



# Tool names the event types stand for ("search_web" is deliberately not registered).
EVENT_TOOL = {"view": "get_current_temperature", "click": "get_current_wind_speed", "purchase": "add",
              "signup": "my_image_gen", "error": "search_web"}


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls ``(message_id, pos, call_id, type, name, arguments, user_id)`` shaped from
    ``events``: four consecutive events form one assistant message; the event type names the
    tool; ``props.k``, ``value`` and ``user_id`` fill the JSON arguments; when ``k % 10 = 7``
    the arguments text loses its closing brace (malformed JSON)."""
    from parlance.plans.spread import spread
    # Spread by message first: the per-call work downstream (argument parsing, dispatch) runs
    # over all shuffle partitions, and the per-message groupings reuse this partitioning.
    e = spread(table(spark, sf_dir, "events")
               .withColumn("message_id", F.floor(F.col("event_id") / 4).cast("long")), "message_id")
    e = e.withColumn("_k", F.get_json_object("props", "$.k"))
    k = F.col("_k")
    kn = k.cast("long")
    t = F.col("event_type")
    loc = F.concat(F.lit('{"location": "City '), F.col("user_id").cast("string"), F.lit('"'))
    unit = F.when(F.pmod(kn, F.lit(2)) == 0, F.lit("celsius")).otherwise(F.lit("fahrenheit"))
    args = (F.when(t == "purchase", F.concat(F.lit('{"a": '), k, F.lit(', "b": '),
                                             F.floor("value").cast("string"), F.lit("}")))
            .when(t == "view", F.when(F.pmod(kn, F.lit(3)) == 0, F.concat(loc, F.lit("}")))
                  .otherwise(F.concat(loc, F.lit(', "unit": "'), unit, F.lit('"}'))))
            .when(t == "click", F.concat(loc, F.lit("}")))
            .when(t == "signup", F.concat(F.lit('{"prompt": "a '), t, F.lit(" scene #"), k,
                                          F.lit(' ~ sky/sea * 100% \u00fc"}')))
            .otherwise(F.concat(F.lit('{"query": "event '), F.col("event_id").cast("string"), F.lit('"}'))))
    args = F.when(F.pmod(kn, F.lit(10)) == 7, F.substring(args, 1, F.length(args) - 1)).otherwise(args)
    name = F.coalesce(*[F.when(t == et, F.lit(tn)) for et, tn in EVENT_TOOL.items()])
    return e.select("message_id",
                    F.pmod("event_id", F.lit(4)).cast("int").alias("pos"),
                    F.concat(F.lit("call_"), F.col("event_id").cast("string")).alias("call_id"),
                    F.lit("function").alias("type"), name.alias("name"), args.alias("arguments"), "user_id")
