"""A sink that commits rows as they are finished, for rows that are dear to make.

Spark's own writers publish a job's files when the whole job ends, so a run that dies loses what its
finished tasks have paid for. This one (``df.write.format("task_commit")``) publishes a Parquet file of
every Arrow batch as soon as it is there: written under a hidden name, then renamed. A later abort
takes nothing back. Attempts of one task may publish a row twice, so rows need a key by which the
reader keeps one (``operators.generate.generate_resumable`` does).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from parlance.sources.json_array import open_store

NAME = "task_commit"


@dataclass
class Published(WriterCommitMessage):
    rows: int


class TaskCommitWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Published:
        store, folder = open_store(self.path)
        store.create_dir(folder, recursive=True)
        rows = 0
        for batch in iterator:
            if batch.num_rows:
                name = f"{uuid.uuid4().hex}.parquet"
                with store.open_output_stream(f"{folder}/_{name}") as f:  # readers skip names with _
                    pq.write_table(pa.Table.from_batches([batch]), f)
                store.move(f"{folder}/_{name}", f"{folder}/{name}")
                rows += batch.num_rows
        return Published(rows)

    def commit(self, messages: list) -> None:
        """Nothing is left to do: every batch is in place."""

    def abort(self, messages: list) -> None:
        """What was published stays: a rerun does not make it again."""


class TaskCommitSource(DataSource):
    """Options: ``path``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> TaskCommitWriter:
        if overwrite:
            raise ValueError("task_commit only appends")
        return TaskCommitWriter(self.options["path"])


def register(spark: SparkSession) -> str:
    """Make the sink known to the session; its format name."""
    spark.dataSource.register(TaskCommitSource)
    return NAME
