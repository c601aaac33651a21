"""Operator 8: nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Every shard of rows has one
inverted file for each pivot: the rows that have it among their ``prefix`` nearest, with
its place. A query walks the files of its own nearest pivots and adds up, for each row,
how far the two orders agree; that ranks the rows by Spearman's footrule distance of the
two prefixes, absent pivots standing right behind them. The best share of each shard,
ties included, is reranked by the exact inner product in double precision.

Pivots come from the 4 * ``pivots`` rows with the least hash of their vec_id, a bounded
sample, and avoid near-copies of each other; every row is indexed. Vectors get one more component that makes their
lengths equal, so that nearness of directions follows the inner product. Shards and
blocks of queries have bounded sizes, and a stated set of queries meets each shard in
blocks; a shard gives its best ``k`` for each query only.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do those of another length than the commonest, nor rows without
vec_id; rows with the same vec_id are one vector, the least one; with fewer candidates
than ``k`` all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.vectors import dimension, matrix, usable
from quarry.session import materialize, small_batches

SHARD_ROWS, BLOCK_QUERIES = 16_384, 512
FOUND = "query_id long, vec_id long, score double"


def spread_pivots(sample: np.ndarray, number: int, alike: float = 0.5) -> np.ndarray:
    """``number`` rows of the sample; near-copies of earlier pivots only if it takes them."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    near = unit @ unit.T
    kept: list[int] = []
    for row in range(len(sample)):
        if len(kept) < number and (not kept or near[row, kept].max() < alike):
            kept.append(row)
    kept += [row for row in range(len(sample)) if row not in set(kept)][: number - len(kept)]
    return sample[kept]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, longest: float, prefix: int) -> np.ndarray:
    """The pivots of each row, nearest first; ties go to the earlier pivot."""
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    pivot_rest = np.sqrt(np.maximum(longest**2 - (pivots * pivots).sum(axis=1), 0))
    out = np.empty((len(x), prefix), np.int16)
    for at in range(0, len(x), 2048):
        part = slice(at, at + 2048)
        near = x[part] @ pivots.T + rest[part, None] * pivot_rest
        out[part] = np.argsort(-near, axis=1, kind="stable")[:, :prefix]
    return out


def footrule_agreement(query: np.ndarray, starts: np.ndarray, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """For each row, a constant less half its footrule distance from the query."""
    prefix = len(query)
    score = np.zeros(n, np.int32)
    for place, pivot in enumerate(query):
        part = slice(starts[pivot], starts[pivot + 1])
        score[rows[part]] += prefix - np.maximum(places[part], place)
    return score


def search(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 256, prefix: int = 64, share: float = 0.2) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of (vec_id, embedding) chosen by ``is_query``."""
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    dim = dimension(good)
    good = materialize(good.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "search-vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    facts = good.agg(F.count("*").alias("n"), F.max(norm).alias("longest"), F.count_if(is_query).alias("queries")).first()
    if not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).collect()
    pivot_rows = spread_pivots(np.array([r.embedding for r in chosen]), pivots)
    longest, prefix = float(facts.longest), min(prefix, len(pivot_rows))
    shards = -(-facts.n // SHARD_ROWS)
    blocks = -(-max(facts.queries, 1) // BLOCK_QUERIES)

    def index(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        ids = shard.column("vec_id").to_numpy()
        x = matrix(shard.column("embedding").combine_chunks(), dim)
        order = nearest_pivots(x, pivot_rows, longest, prefix)
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        starts = np.searchsorted(flat[by_pivot], np.arange(len(pivot_rows) + 1)).astype(np.int64)
        parts = [ids.astype(np.int64), x, starts, (by_pivot // prefix).astype(np.int32), (by_pivot % prefix).astype(np.int16)]
        return pa.table({"shard": pa.array([shard.column("shard")[0].as_py()], pa.int32()), **{n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(("ids", "vectors", "starts", "posted", "places"), parts)}})

    def block(queries: pa.Table) -> pa.Table:
        queries = queries.combine_chunks()
        x = matrix(queries.column("embedding").combine_chunks(), dim)
        order = nearest_pivots(x, pivot_rows, longest, prefix)
        ids = queries.column("vec_id").to_numpy().astype(np.int64)
        return pa.table({n: pa.array([a.tobytes()], pa.binary()) for n, a in (("query_ids", ids), ("queries", x), ("orders", order))})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)  # noqa: B023, E731
                ids, starts, posted, places = get("ids", "i8"), get("starts", "i8"), get("posted", "i4"), get("places", "i2")
                x = get("vectors", "f8").reshape(-1, dim)
                q_ids, q, orders = get("query_ids", "i8"), get("queries", "f8").reshape(-1, dim), get("orders", "i2").reshape(-1, prefix)
                most = min(len(ids), max(10 * k, int(len(ids) * share)))
                found: list[list[np.ndarray]] = [[], [], []]
                for i in range(len(q_ids)):
                    agree = footrule_agreement(orders[i], starts, posted, places, len(ids))
                    least = np.partition(agree, len(ids) - most)[len(ids) - most]
                    near = np.flatnonzero((agree >= least) & (ids != q_ids[i]))
                    score = np.einsum("ij,j->i", x[near], q[i])
                    if len(near) > k:
                        bar = np.partition(score, len(near) - k)[len(near) - k]
                        near, score = near[score >= bar], score[score >= bar]
                    best = np.lexsort((ids[near], -score))[:k]
                    for part, value in zip(found, (np.full(len(best), q_ids[i]), ids[near[best]], score[best])):
                        part.append(value)
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in found], ["query_id", "vec_id", "score"])

    sharded = good.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(8)), F.lit(shards)).cast("int"))
    built = sharded.groupBy("shard").applyInArrow(index, "shard int, ids binary, vectors binary, starts binary, posted binary, places binary")
    asked = good.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(blocks)).cast("int"))
    asked = asked.groupBy("block").applyInArrow(block, "query_ids binary, queries binary, orders binary")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = built.join(asked, "shard").drop("shard").mapInArrow(find, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
