"""The choice among wide rows by what is known of their keys."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quarry.llm.components import chosen_rows


@pytest.fixture
def unbroadcast(spark):
    """Joins as on large tables, where no side is small enough to be sent to all."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled(spark):
    """Rows shuffled by the stages that Spark remembers, by stage."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {x.stageId(): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}


def test_the_jaccard_stage_leaves_most_texts_where_they_are(unbroadcast, sf):
    """A copy of each tenth text goes; the others stay without a shuffle of all rows."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(k, text(k), "x") for k in range(1000)] + [(1000 + k, text(10 * k), "y") for k in range(100)]
    docs = unbroadcast.createDataFrame(rows, "doc_id long, text string, other string")
    kept = corpus_pipeline.keep_one_of_each_group(unbroadcast, docs, sf)
    before = shuffled(unbroadcast)
    assert sorted(map(tuple, kept.collect())) == rows[:1000]
    assert sum(n for stage, n in shuffled(unbroadcast).items() if stage not in before) < 100


@pytest.mark.parametrize("share", ["id % 3 = 0", "id % 50 <> 0", "true", "false"])
def test_chosen_rows_are_those_of_a_join(unbroadcast, share):
    """Also keys that share slots in both bitmaps, repeated keys and columns of any name."""
    rows = unbroadcast.range(60_000).select((F.col("id") * 7 - 5).alias("k"), F.col("id").alias("key"), F.lit("t").alias("words"))
    rows = rows.union(rows.where("key < 100"))
    known = rows.distinct().select("k", F.expr(share.replace("id", "key")).alias("kept"))
    want = rows.join(known.where("kept"), "k", "left_semi").select(rows.columns)
    got = chosen_rows(rows, "k", known)
    assert got.columns == rows.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
