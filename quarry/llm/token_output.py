"""Operator 1: token ids of whole texts as Simple-8b segments.

``write_tokens`` deals the documents to ranges of doc_id, encodes each range in order
and writes its segments (see ``simple8b``) as a Parquet table of (shard, part, start,
n_ids, n_docs, data): Spark's committer keeps only whole attempts of a task, so a lost
executor leaves no half-written file. ``read_tokens`` gives the documents back, and
``export_segments`` lays the same bytes out as plain ``.s8b`` files.

Defined cases: a null text is an empty text; a document without ids still has its end
id; a null doc_id comes first and is written as the smallest 64-bit integer; rows with
the same doc_id are separate documents, ordered by text; an empty table gives no
segments; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import simple8b
from quarry.llm.vocab import encoder
from quarry.session import materialize, small_batches

SEGMENT_IDS = 1 << 17
#: Chunks whose ids a worker remembers, about 200 MB: memory against time, with the same results.
REMEMBERED = 1_000_000
SEGMENT_SCHEMA = "shard int, part int, start_in_shard long, n_ids long, n_docs int, data binary"
NULL_ID = -(1 << 63)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Segments of all documents in ascending doc_id order, with the global start of each.

    Each shard is one range of doc_id; what goes to the driver is one number a shard.
    """
    spark = docs.sparkSession
    small_batches(spark, 2000)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part, start = TaskContext.get().partitionId(), 0, 0
        coder = encoder(tokenizer, "word", REMEMBERED)
        end = np.array([end_id], "<u4").tobytes()
        doc_ids: list[int] = []
        ids: list[bytes] = []

        def segment() -> pa.RecordBatch:
            nonlocal part, start
            flat = np.frombuffer(b"".join(ids), "<u4")
            data = simple8b.pack_segment(doc_ids, [len(x) // 4 for x in ids], flat)
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([start]), pa.array([len(flat)]), pa.array([len(doc_ids)], pa.int32()), pa.array([data], pa.binary())],
                ["shard", "part", "start_in_shard", "n_ids", "n_docs", "data"],
            )
            part, start = part + 1, start + len(flat)
            doc_ids.clear()
            ids.clear()
            return out

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                for doc, found in zip(rows.column(0).to_pylist(), coder.encode([x or "" for x in rows.column(1).to_pylist()])):
                    doc_ids.append(NULL_ID if doc is None else doc)
                    ids.append(found + end)
                    held += len(ids[-1])
                    if held >= 4 * SEGMENT_IDS:
                        yield segment()
                        held = 0
        if doc_ids:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    # bounds of the ranges from the ids alone: dealing by range would read all texts for them
    cuts = [k / shards for k in range(1, shards)] or [0.5]
    bounds = rows.agg(F.percentile_approx("doc_id", cuts, 20 * shards).alias("b")).first().b or []
    shard = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b < F.col("doc_id")))
    dealt = rows.repartitionById(shards, shard.cast("int"))
    segments = materialize(dealt.sortWithinPartitions("doc_id", "text").mapInArrow(encode, SEGMENT_SCHEMA), "tokens")
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    base, bases = 0, []
    for row in sorted(totals, key=lambda r: r.shard):
        bases.append((row.shard, base))
        base += row.n
    known = spark.createDataFrame(bases, "shard int, base long")
    return segments.join(F.broadcast(known), "shard").select("shard", "part", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_ids", "n_docs", "data")


def read_tokens(segments: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of each document in the segments."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs, starts, ids = zip(*simple8b.unpack_segment(data.as_py()))
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate(ids).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if d == NULL_ID else d for d in docs], pa.int64()), pa.array(np.array(starts) + start), pa.ListArray.from_arrays(pa.array(offsets), values)],
                    ["doc_id", "start", "ids"],
                )

    return segments.select("start", "data").mapInArrow(decode, "doc_id long, start long, ids array<long>")


def digest_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, straight from the decoded segments."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(d, s + start, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in simple8b.unpack_segment(data.as_py())]
                doc, begin, n, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if d == NULL_ID else d for d in doc], pa.int64()), pa.array(begin, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("start", "data").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_segments(segments: DataFrame, folder: str) -> None:
    """Writes each segment as ``folder/SHARD-PART.s8b`` from the executors; the folder
    must be a file system that all executors mount. A file appears whole or not at all."""
    import os

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            path = os.path.join(folder, f"{row.shard:06d}-{row.part:06d}.s8b")
            with open(f"{path}.{os.getpid()}", "wb") as f:
                f.write(bytes(row.data))
            os.replace(f"{path}.{os.getpid()}", path)

    segments.select("shard", "part", "data").foreachPartition(write)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest_tokens(write_tokens(docs, path("word_bpe_49k.json"), end_id=2))
