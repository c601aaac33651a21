"""Bounded samples of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; 0 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: dict[int, int]) -> tuple[dict[int, list[str]], dict[int, int]]:
    """Whole texts by label value, of each value the ``most`` labelled documents with the least
    hash of their doc_id; and how many labelled rows of ``docs`` there are of each value.

    Only documents in ``docs`` count. Rows of the held-out remainder, without doc_id, or
    whose labels disagree or are null are left out; a null text is empty; of rows that share
    a doc_id the least text trains. The doc_ids are chosen from narrow columns; then one scan
    of the texts fetches the chosen ones.
    """
    agreed = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).alias("z"))
    agreed = agreed.where((F.col("y") == F.col("z")) & (remainder(modulus) != held_out) & F.col("y").isin(list(most))).select(F.col("doc_id").cast("long"), "y")
    own = docs.select(F.col("doc_id").cast("long")).join(agreed, "doc_id").groupBy("doc_id", "y").agg(F.count("*").alias("n"))
    counts = {row.y: row.n for row in own.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    chosen = {v: [r.doc_id for r in own.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id").collect()] for v, n in most.items()}
    wanted = docs.sparkSession.createDataFrame([(doc,) for ids in chosen.values() for doc in ids], "doc_id long")
    found = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")
    texts = {r.doc_id: r.text for r in found.groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return {v: [texts[doc] for doc in ids] for v, ids in chosen.items()}, counts
