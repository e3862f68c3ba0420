"""Streaming jobs (STR-2, STR-3): file-stream sources with declared schemas, checkpointed sinks.

Both are restartable: the checkpoint records which files were processed, the render's sink commits
whole micro-batches, and the upsert's state takes a replayed batch without change, so a lost
executor or a restarted driver resumes without duplicates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class StreamStats:
    """What a finished run read and dropped, by micro-batch number."""
    rows: dict[int, int] = field(default_factory=dict)
    dropped: dict[int, int] = field(default_factory=dict)

    def add(self, progress) -> None:
        b = progress.batchId  # an idle report repeats a number, without rows
        self.rows[b] = max(self.rows.get(b, 0), progress.numInputRows)
        self.dropped[b] = max(self.dropped.get(b, 0), sum(o.numRowsDroppedByWatermark for o in progress.stateOperators))


def run_available(query_builder: Callable[[], object], poll_s: float = 1.0) -> StreamStats:
    """Start a streaming query (built with ``trigger(availableNow=True)``) and wait for it. Spark keeps
    only the last progress reports of a query, so they are gathered while it runs."""
    stats = StreamStats()
    q = query_builder()
    while True:
        ended = q.awaitTermination(poll_s)
        for p in q.recentProgress:
            stats.add(p)
        if ended:
            break
    if q.exception() is not None:  # pragma: no cover - surfaced to the caller
        raise q.exception()
    return stats


def stream_render(spark: SparkSession, source_dir: str, schema: str, sink_dir: str, checkpoint: str,
                  render: Callable[[DataFrame], DataFrame], files_per_trigger: int = 1) -> DataFrame:
    """STR-2: incremental records -> prompts. A stateless projection over a Parquet file
    stream, appended to a Parquet sink; the result equals the batch render."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
           .parquet(source_dir))
    run_available(lambda: render(src).writeStream.format("parquet").outputMode("append")
                  .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink_dir))
    return spark.read.parquet(sink_dir)


def config_changes(batch: DataFrame, group: str, seq: str, kind: str, agent: str, payload: list[str]) -> DataFrame:
    """A batch of config events as one row per ``(group, kind, name)``: when the name first and last
    appeared and its latest payload."""
    key = F.when(F.col(kind) == "background", F.lit("")).otherwise(F.col(agent))
    return (batch.filter(F.col(kind).isin("role_config", "background"))
            .groupBy(group, kind, key.alias("name"))
            .agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"),
                 F.max_by(F.struct(*payload), seq).alias("p")))


class KeyedState:
    """Rows by key in ``buckets`` partitions of a Parquet table, of which a merge rewrites only those
    that it touches.

    ``fold(old_and_new)`` must give one row a key and not depend on order or repetition (least,
    greatest, latest), so a batch that is replayed changes nothing. A merge first writes the touched
    buckets whole beside the table (``next``) and a marker with the batch's number (``ready``), then
    puts them in the table's place by a dynamic partition overwrite, which removes the files that
    they replace. When a run dies in between, the replayed batch finds its marker and puts the same
    files in place again, so a half-replaced table is mended and never read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, fold: Callable[[DataFrame], DataFrame],
                 buckets: int = 64):
        self.spark, self.key, self.fold, self.buckets, self.columns = spark, key, fold, buckets, schema
        self.table, self.next, self.marker = f"{path}/table", f"{path}/next", f"{path}/ready"

    def _stored(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The rows, with their ``bucket``; none before the first merge."""
        return self._stored(self.table, f"{self.columns}, bucket int")

    def ready(self) -> tuple[str, int] | None:
        """Source and number of the last batch whose buckets were written whole."""
        last = self._stored(self.marker, "source string, batch bigint").first()
        return None if last is None else tuple(last)

    def merge(self, changes: DataFrame, batch: int, source: str = "") -> list[int]:
        """Fold ``changes`` in. ``source`` and ``batch`` tell a replay from another batch: batches are
        numbered within a source, such as a stream with its checkpoint. Returns the buckets that were
        rewritten (at most ``buckets``)."""
        schema = f"{self.columns}, bucket int"
        if self.ready() != (source, batch):
            new = changes.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
            touched = [r[0] for r in new.select("bucket").distinct().collect()]
            old = self.read().where(F.col("bucket").isin(touched)).select(new.columns)
            self.fold(old.unionAll(new)).repartition("bucket").write.mode("overwrite").parquet(self.next)
            mark = self.spark.range(1).select(F.lit(source).alias("source"), F.lit(batch).cast("long").alias("batch"))
            mark.coalesce(1).write.mode("overwrite").parquet(self.marker)
        rows = self.spark.read.schema(schema).parquet(self.next)
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]
        (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(self.table))
        return sorted(touched)


def stream_config_upsert(spark: SparkSession, source_dir: str, schema: str, state_dir: str,
                         checkpoint: str, group: str, seq: str, kind: str, agent: str,
                         payload: list[str], files_per_trigger: int = 1, buckets: int = 64) -> DataFrame:
    """STR-3: config events as they arrive -> the current config table (CH-3 semantics).

    ``foreachBatch`` folds each micro-batch into a ``KeyedState`` by ``group``; a batch rewrites the
    buckets of the groups that it holds and no others. Returns the agents and background of every
    group as ``(group, pos, name, *payload, background)``; agents are numbered when read."""
    from pyspark.sql import Window

    types = dict((f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema))
    fields = ", ".join(f"{p}: {types[p]}" for p in payload)
    columns = (f"{group} {types[group]}, {kind} string, name string, first_seq {types[seq]}, last_seq {types[seq]}, "
               f"p struct<{fields}>")

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(group, kind, "name", "bucket").agg(
            F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
            F.max_by("p", "last_seq").alias("p")).select(group, kind, "name", "first_seq", "last_seq", "p", "bucket")

    def fold(batch: DataFrame, batch_id: int) -> None:
        sp = batch.sparkSession
        stream = sp.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint  # kept with the checkpoint
        KeyedState(sp, state_dir, columns, group, latest, buckets).merge(
            config_changes(batch, group, seq, kind, agent, payload), batch_id, stream)

    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
           .parquet(source_dir))
    run_available(lambda: src.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())
    st = KeyedState(spark, state_dir, columns, group, latest, buckets).read()
    w = Window.partitionBy(group).orderBy("first_seq", "name")
    agents = st.filter(F.col(kind) == "role_config").select(
        group, (F.row_number().over(w) - 1).cast("int").alias("pos"), "name", *[F.col(f"p.{p}").alias(p) for p in payload])
    bg = st.filter(F.col(kind) == "background").select(group, F.col(f"p.{payload[0]}").alias("background"))
    return agents.join(bg, group, "full_outer")
