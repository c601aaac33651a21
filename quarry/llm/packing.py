"""Operator 5: best-fit decreasing packing of token pieces into sequences.

A document's ids end with ``end_id``. Only a document longer than the capacity is cut,
from its end, into pieces of the capacity; its first piece takes the rest.

Best-fit decreasing places pieces from long to short, each into the open bin with the
least room that still holds it. Pieces of one length are alike, so the whole placement
follows from how many pieces there are of each length. The driver holds these at most
``capacity`` counts and runs the placement over them: a segment tree over remaining
capacities finds the tightest open bin in logarithmic time, and all pieces of a length
that would go into equal bins go there in one step. The plan that results has a number
of runs bounded by the capacity, whatever the number of documents, and is broadcast.
Executors number the pieces of each length (hot lengths are split into buckets) and
look up their places. The placement is exactly that of the sequential algorithm.

Defined cases: a null text is an empty text, which has the end id alone; an empty table
gives no rows; rows with the same doc_id are separate documents; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.vocab import encoder
from quarry.session import materialize, small_batches, tidy

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
PLAN = "length int, first_rank long, end_rank long, per_bin int, first_bin long, offset int"


class CapacityTree:
    """Numbers of open bins by remaining capacity, with the tightest fit in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.total = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        at = room + self.size
        while at:
            self.total[at] += bins
            at >>= 1

    def tightest(self, room: int) -> int | None:
        """The least remaining capacity from ``room`` up that some open bin has."""
        at = room + self.size
        if self.total[at]:
            return room
        while at > 1 and (at & 1 or not self.total[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at = 2 * at if self.total[2 * at] else 2 * at + 1
        return at - self.size


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, pieces a bin, first bin, offset in the bin).

    The pieces of ``length`` with ranks from first to end fill consecutive bins from
    ``first_bin`` on, ``per_bin`` in each, side by side from ``offset`` on.
    """
    tree, open_bins, runs, bins = CapacityTree(capacity), {}, [], 0

    def keep(room: int, first: int, number: int) -> None:
        if room and number:
            tree.add(room, number)
            open_bins.setdefault(room, []).append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, number = capacity, bins, -(-left // (capacity // length))
                bins += number
            else:
                first, number = open_bins[room].pop()
                tree.add(room, -number)
            each = room // length
            full = min(number, left // each)
            if full:
                runs.append((length, rank, rank + full * each, each, first, capacity - room))
                keep(room - full // full * each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < number and left and left < each:
                runs.append((length, rank, rank + left, left, first + full, capacity - room))
                keep(room - left * length, first + full, 1)
                full, left = full + 1, 0
            keep(room, first + full, number - full)
    return runs


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False, remembered: int = 800_000) -> DataFrame:
    """The pieces of every document, with their ids if asked for. A worker remembers the ids
    of so many chunks: memory against time, with the same results."""
    small_batches(docs.sparkSession, 2000)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, "byte", remembered)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, parts = [], []
            for doc, data in zip(batch.column(0).to_pylist(), coder.encode([x or "" for x in batch.column(1).to_pylist()])):
                data += end
                n = len(data) // 4
                first = n % capacity or min(n, capacity)
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    part = data[4 * i : 4 * j]
                    rows.append((doc, k, i, j - i, zlib.crc32(part)))
                    if with_ids:
                        parts.append(part)
            arrays = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
            if not arrays:
                continue
            if with_ids:
                offsets = np.cumsum([0, *(len(x) // 4 for x in parts)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    found = docs.select(F.col("doc_id").cast("long"), "text")
    return found.mapInArrow(tidy(cut), PIECES + ", ids array<int>" * with_ids)


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to written pieces (their column ``length`` is what counts)."""
    spark = pieces.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    cells = materialize(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "packing-counts")
    counts = {row.length: row.n for row in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(plan_bins(counts, capacity), PLAN)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("row", F.row_number().over(inside)).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("row") - 1)
    p = plan.alias("p")
    joined = ranked.join(F.broadcast(p), (ranked["length"] == F.col("p.length")) & (F.col("rank") >= F.col("p.first_rank")) & (F.col("rank") < F.col("p.end_rank")))
    within = F.col("rank") - F.col("p.first_rank")
    return joined.select(
        *[ranked[c] for c in pieces.columns],
        (F.col("p.first_bin") + F.expr("(rank - p.first_rank) div p.per_bin")).alias("sequence_id"),
        (F.col("p.offset") + (within % F.col("p.per_bin")) * ranked["length"]).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, with_ids: bool = False, remembered: int = 800_000) -> DataFrame:
    """All pieces of the documents with their places."""
    return place_pieces(materialize(cut_pieces(docs, tokenizer, end_id, capacity, with_ids, remembered), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: at most ``capacity`` ids and their documents, each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    grouped = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))


def pack_documents(docs: DataFrame, remembered: int = 800_000) -> DataFrame:
    """With the production parameters: byte-level vocabulary, end id 0, 2048 tokens."""
    from public_tokenizers import path

    placed = pack(docs, path("byte_bpe_50k.json"), end_id=0, capacity=2048, remembered=remembered)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
