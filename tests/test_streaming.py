"""Streaming folds equal the batch results."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import ledgers
from quarry.streaming import journal as sj

ROWS = "journal string, seq long, arm string, accepted boolean, trials double, promotions double, score_gain double, cost_ms double"


def rows(spark, start, end):
    return spark.range(start, end).selectExpr("concat('j', id % 2) AS journal", "id AS seq", "concat('a', id % 3) AS arm", "id % 5 = 0 AS accepted", "1.0D AS trials", "0.5D AS promotions", "CAST(id AS DOUBLE) AS score_gain", "10.0D AS cost_ms")


def test_streamed_evidence_equals_batch(spark, tmp_path):
    for k in range(3):
        rows(spark, 20 * k, 20 * k + 20).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = sj.stream_evidence(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")))
        query = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    got = {(r.journal, r.arm): r for r in spark.read.parquet(f"{tmp_path}/out/{last}").collect()}
    want = ledgers.decayed_evidence(rows(spark, 0, 60), ["journal"], ["seq"], "arm").collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r.journal, r.arm].score_gain == pytest.approx(r.score_gain)


def test_windows_sessions_and_totals(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    def stream():
        return spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))

    for name, frame, mode in (("tumbling", sj.windowed_totals(stream(), "1 day"), "complete"), ("sliding", sj.windowed_totals(stream(), "2 days", "1 day"), "complete"), ("sessions", sj.sessions(stream(), "1 day"), "complete")):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(120)
    n = events.count()
    assert spark.sql("SELECT sum(n) FROM tumbling").first()[0] == n and spark.sql("SELECT sum(n) FROM sliding").first()[0] == 2 * n and spark.sql("SELECT sum(n) FROM sessions").first()[0] == n
    sj.into_table(stream(), str(tmp_path / "t"), str(tmp_path / "c"), ["event_type"]).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.sum("n")).first()[0] == n


def test_streamed_cache(spark, tmp_path):
    data = spark.createDataFrame([("b", 1.0, 0), ("b", 1.0 + 1e-9, 5), ("b", 2.0, 6), ("b", 1.0, 2000)], "bucket string, value double, inserted long")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sj.stream_cache(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), 1000, 10)
    stream.writeStream.format("memory").queryName("cache").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert [r.live for r in spark.sql("SELECT * FROM cache ORDER BY inserted").collect()] == [False, True, False, False]
