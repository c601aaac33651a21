"""A training-corpus pipeline: quality, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as
Parquet and reread as the next stage's ``docs``. All stages but the last return the
columns of the documents that they keep. Models are trained on the labelled documents
among a stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard_join, packing, quality, toxicity
from quarry.llm.components import chosen_rows
from quarry.session import materialize, table

QUALITY_BAR, TOXIC_BAR = 0.5, 0.3


def _free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null text counts as empty, and an empty one is scored as such; whole texts of any
    length are scored; rows that repeat are scored, and go or stay, alike; a row without
    doc_id is scored but trains nothing; without labels all documents stay; an empty table
    gives no rows; other columns, whatever their names, are passed on.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = _free_name(docs, "quality_score")
    return quality.score_documents(docs, model, docs.columns, name).where(F.col(name) >= QUALITY_BAR).select(docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic.

    Nulls, empty and very long texts, repeated rows, empty tables and other columns are
    treated as in ``keep_good``; without labels all documents stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = _free_name(docs, "toxic_score")
    return toxicity.score_documents(docs, model, docs.columns, name).where(F.col(name) < TOXIC_BAR).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by similarity, the one with the least doc_id.

    Where doc_ids are null or repeated, rows are numbered and the first row stays.
    """
    repeated = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        found = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
        return chosen_rows(docs, "doc_id", found.select("doc_id", F.expr("doc_id = component_id").alias("kept")))
    row = _free_name(docs, "row_id")
    ordered = docs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "text").sortWithinPartitions("doc_id", "text")
    numbered = materialize(ordered.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard_join.jaccard_components(numbered.select(F.col(row).alias("doc_id"), "text"))
    known = found.select(F.col("doc_id").alias(row), F.expr("doc_id = component_id").alias("kept"))
    return chosen_rows(numbered, row, known).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in packed sequences.

    A null or empty text is one piece of the end's token; very long texts are cut; rows with
    the same doc_id are packed each by itself, and so are those without one; an empty table
    gives no rows; other columns are ignored.
    """
    # workers still hold what earlier stages used
    return packing.pack_documents(docs, remembered=150_000)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_civil),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("best-fit packing", pack),
]

#: The stages can't be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
