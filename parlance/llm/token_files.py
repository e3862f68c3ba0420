"""Token ids as fixed-width bit-packed files with random access.

A file is one byte string (a row of a Parquet table, so any store that Spark reads can hold it):

    magic b"PBT1" | u32 bits | u32 block ids | u64 ids | u32 blocks | u64[blocks] byte offset of
    each block from the payload's start | payload

Each id takes ``bits`` bits, the fewest that hold the vocabulary, most significant bit first; a
block holds ``block`` ids (the last fewer) and starts on a byte, so ids ``a .. b`` are read from
their blocks alone. A document's ids lie in one file; a file is closed at ``FILE_IDS`` ids.

Defined results: a null or empty text is its end id alone; equal doc_ids are ordered by text,
null doc_ids come first (in the
files: the least long); an empty table writes no file; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import encoder, id_in, id_out, parallelism
from parlance.sources.io import scratch_path

MAGIC, BLOCK = b"PBT1", 4096
#: Ids after which a file is closed (a longer document has a file of its own).
FILE_IDS = 1 << 19
SCHEMA = ("part int, file int, start long, n_ids long, doc_ids array<long>, doc_starts array<long>, data binary")


def bits_for(vocab: int) -> int:
    """Fewest bits that hold ids below ``vocab``."""
    return max(1, (vocab - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype(">u2").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> shifts) & 1).astype(np.uint8)).tobytes()


def unpack_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(raw, ">u2", n).astype(np.uint32)
    b = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits).reshape(n, bits)
    return b @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64)).astype(np.int64)


def write_file(ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    parts = [pack_bits(ids[i:i + block], bits) for i in range(0, len(ids), block)]
    at = np.cumsum([0] + [len(p) for p in parts])[:-1].astype("<u8") if parts else np.zeros(0, "<u8")
    head = MAGIC + struct.pack("<IIQI", bits, block, len(ids), len(parts))
    return head + at.tobytes() + b"".join(parts)


def read_file(data: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``first .. first + count`` of a file, from the blocks that hold them."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    bits, block, n, blocks = struct.unpack_from("<IIQI", data, 4)
    last = n if count is None else min(n, first + count)
    if last <= first:
        return np.zeros(0, np.uint32)
    at = np.frombuffer(data, "<u8", blocks, 24)
    base, b0, b1 = 24 + 8 * blocks, first // block, (last - 1) // block
    out = [unpack_bits(data[base + int(at[b]): base + int(at[b]) + (min(block, n - b * block) * bits + 7) // 8],
                       min(block, n - b * block), bits) for b in range(b0, b1 + 1)]
    return np.concatenate(out)[first - b0 * block: last - b0 * block].astype(np.uint32)


def write_tokens(docs: DataFrame, out: str, vocab_file: str, vocab: int, end_id: int,
                 words: bool = False, partitions: int | None = None) -> None:
    """Encode every text, append ``end_id`` and write the files of all documents in ascending
    doc_id order to the Parquet folder ``out``: rows ordered by (part, file), ``start`` counted
    within the part. Documents are dealt by ranges of doc_id, so files hold ascending doc_ids
    and no task sees more than its range."""
    bits = bits_for(max(vocab, end_id + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, tail = encoder(vocab_file, words), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        held, ids, starts, size, file, start = [], [], [], 0, 0, 0

        def close() -> pd.DataFrame:
            arr = np.frombuffer(b"".join(held), "<u4")
            return pd.DataFrame([{"part": part, "file": file, "start": start, "n_ids": size,
                                  "doc_ids": list(ids), "doc_starts": list(starts),
                                  "data": write_file(arr, bits)}])
        for pdf in batches:
            packed = enc.batch(pdf["text"].tolist())
            for doc, raw in zip(pdf["doc_id"].tolist(), packed):
                n = len(raw) // 4 + 1
                if held and size + n > FILE_IDS:
                    yield close()
                    held, ids, starts, size, file, start = [], [], [], 0, file + 1, start + size
                held.append(raw + tail)
                ids.append(doc)
                starts.append(size)
                size += n
        if held:
            yield close()

    spark = docs.sparkSession
    n = partitions or parallelism(spark)
    d = docs.select(id_in(), F.col("text").cast("string").alias("text"))
    (d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInPandas(run, SCHEMA).write.mode("overwrite").parquet(out))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start`` (ids of all documents before it),
    ``n_tokens`` and ``ids_crc32``. The parts' totals (one row a part) give each part's start."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, start, docs, at, data in zip(pdf["part"], pdf["start"], pdf["doc_ids"], pdf["doc_starts"], pdf["data"]):
                ids = read_file(data).astype("<u4")
                at = np.append(np.asarray(at, np.int64), len(ids))
                yield pd.DataFrame({"part": part, "doc_id": docs, "rel": start + at[:-1],
                                    "n_tokens": np.diff(at),
                                    "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]})

    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    from pyspark.sql import Window
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a part: as many as the write had tasks
    offsets = F.broadcast(totals.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base")))
    rows = files.select("part", "start", "doc_ids", "doc_starts", "data").mapInPandas(
        run, "part int, doc_id long, rel long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, "part").select(
        id_out(), (F.col("base") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, vocab_file: str, vocab: int, end_id: int) -> DataFrame:
    """Write the files to the shared scratch folder and read them back."""
    out = scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, out, vocab_file, vocab, end_id)
    return read_tokens(docs.sparkSession, out)
