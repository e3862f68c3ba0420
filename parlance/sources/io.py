"""Scans and sinks (SRC-*, SNK-*) with declared schemas - never inferred.

JSON lines are splittable and scale; a file holding one JSON array is cut into byte ranges by a
parallel pass over it. Writes go to shared storage; scratch tables live under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt_record"
#: Records that a Python step of a sink holds at a time.
SINK_ROWS = 200
#: Folder of the scratch tables that go at the end of a ``passing_tables`` block.
_PASSING: ContextVar[str | None] = ContextVar("passing", default=None)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` has this value for what is run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _with_corrupt(schema: StructType | str, spark: SparkSession) -> StructType:
    s = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if CORRUPT not in s.fieldNames():
        s = StructType(list(s.fields) + [StructField(CORRUPT, StringType(), True)])
    return s


def scan_jsonl(spark: SparkSession, path: str, schema, strict: bool = False) -> DataFrame:
    """SRC-1: one JSON object per line. ``strict`` fails on the first bad line (the reference
    raises); otherwise bad lines keep their text in ``_corrupt_record`` and null fields.
    Spark skips blank lines in both modes."""
    r = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if strict:
        return r.schema(schema).json(path)
    return r.option("columnNameOfCorruptRecord", CORRUPT).schema(_with_corrupt(schema, spark)).json(path)


def scan_json_array(spark: SparkSession, path: str, schema, range_bytes: int | None = None) -> DataFrame:
    """SRC-2: every file is one JSON array of records. Plain files are cut into byte ranges and read by
    many tasks (``sources.json_array``); compressed ones, and stores that only Spark reads, go through
    Spark's own reader, one task a file."""
    from parlance.sources.json_array import read_records, splittable
    files = splittable(path)
    if files is None:
        return spark.read.option("multiLine", True).schema(schema).json(path)
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return read_records(spark, files, range_bytes).select(F.from_json("value", schema).alias("r")).select("r.*")


def scan_by_suffix(spark: SparkSession, path: str, schema) -> DataFrame:
    """SRC-3: reader chosen by the end of the path's name: ``.xlsx`` is rejected, ``.jsonl``
    (lines), ``.json`` (array); ``.parquet`` added."""
    name = path.rstrip("/")
    if name.endswith(".xlsx"):
        raise NotImplementedError("Excel workbooks are not read; convert them upstream")
    if name.endswith(".jsonl"):
        return scan_jsonl(spark, path, schema)
    if name.endswith(".json"):
        return scan_json_array(spark, path, schema)
    if name.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"no reader for {path!r}: expected .jsonl, .json or .parquet")


def record_contract(df: DataFrame, required: list[str]) -> DataFrame:
    """SRC-5: ``contract_error`` = the first required field that is null (the reference raises
    KeyError on a missing key), else null. Filter on it to split good and bad rows."""
    err = F.lit(None).cast("string")
    for c in reversed(required):
        err = F.when(F.col(c).isNull(), F.lit(f"missing {c}")).otherwise(err)
    return df.withColumn("contract_error", err)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """SRC-6: ``(name, rows)`` for each dataset (each count is a partial aggregate)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sink_jsonl(df: DataFrame, path: str, mode: str = "overwrite", keep_nulls: bool = True) -> None:
    """SNK-1: JSON lines, UTF-8 as is; null fields kept (Spark drops them by default)."""
    df.write.mode(mode).option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def _bracket_lines(batches):
    """Per partition: ``[`` before the first record, ``,`` before the others, ``]`` at the end -
    the lines of one JSON array, emitted as they stream (nothing is gathered)."""
    import pandas as pd
    first = True
    for pdf in batches:
        if len(pdf) == 0:
            continue
        vals = pdf["value"].tolist()
        out = [("[" if first and i == 0 else ",") + v for i, v in enumerate(vals)]
        first = False
        yield pd.DataFrame({"value": out})
    yield pd.DataFrame({"value": ["[]" if first else "]"]})


def sink_json_arrays(df: DataFrame, path: str, files: int) -> None:
    """Write ``files`` files (one per partition), each a JSON array of its rows - the shape
    SRC-2 reads. Records are rendered by ``to_json`` in the JVM; a per-partition generator only
    adds the brackets and commas line by line, so no file's rows are ever collected."""
    rec = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    lines = df.select(rec).repartition(files).mapInPandas(_bracket_lines, "value string")
    with setting(df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(SINK_ROWS)):
        lines.write.mode("overwrite").text(path)


def dataset_split_export(df: DataFrame, path: str, subset: str, split: str) -> None:
    """SRC-4: one JSON-lines dataset under ``path/subset=<s>/split=<p>``."""
    df.write.mode("overwrite").partitionBy(subset, split).json(path)


def sink_sharded(df: DataFrame, path: str, shard: str = "shard") -> None:
    """SNK-2: one output directory per rank (``shard=<r>``)."""
    df.write.mode("overwrite").partitionBy(shard).json(path)


def sink_run_summary(rows: DataFrame, summary: DataFrame, path: str) -> tuple[str, str]:
    """SNK-3: the rows and the one-row run summary as two datasets (the reference puts the
    summary dict on the first line of the same file; mixed schemas are not kept)."""
    rp, sp = f"{path}/rows", f"{path}/run_summary"
    rows.write.mode("overwrite").json(rp)
    summary.coalesce(1).write.mode("overwrite").json(sp)
    return rp, sp


def sink_responses(df: DataFrame, path: str, id_col: str = "id", response: str = "response") -> None:
    """SNK-4: ``{id, response}`` records as JSON lines (one object per line, unlike the
    reference's concatenated pretty JSON, which no line reader can split)."""
    df.select(id_col, response).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for a written intermediate table."""
    from parlance.session import checkpoint_dir
    return f"{_PASSING.get() or checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """The scratch tables of this block go when it ends. What is read later is written to a ``scratch_path``
    asked for before; no DataFrame made from the others may be used afterwards."""
    path = scratch_path(spark, "passing")
    token = _PASSING.set(path)
    try:
        yield
    finally:
        _PASSING.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``df`` as Parquet. Its shuffle files go when the write ends, not when the driver next
    collects its garbage."""
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.mode(mode).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and scan it back.

    Used where a derived table feeds several branches of a later plan (Spark would otherwise
    recompute its whole lineage per branch). The written table cuts the lineage, survives
    executor loss, and gives AQE exact sizes for its join choices.
    """
    path = scratch_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.parquet(path)


def materialize_buckets(df: DataFrame, name: str, by: list[str], buckets: int, sort: list[str] | None = None) -> DataFrame:
    """``materialize`` as a table bucketed by ``by``: reads of it are dealt by ``by`` already, so windows,
    aggregates and joins on those columns need no exchange of it. Deal ``df`` by the same columns
    and number before, or each task writes a file for every bucket. The table's files lie under the
    shared checkpoint folder; its name lives in the session's catalog."""
    path = scratch_path(df.sparkSession, name)
    table = "parlance_" + path.rsplit("/", 1)[1].replace("-", "_")
    w = df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *by)
    (w.sortBy(*sort) if sort else w).saveAsTable(table)
    return df.sparkSession.table(table)
