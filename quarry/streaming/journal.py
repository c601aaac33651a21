"""Streaming forms of the journal's folds (section 2.10), and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.ledgers import SUMS, weighed_by_arm


def journal_stream(spark: SparkSession, folder: str) -> DataFrame:
    """[S9] Lines of a growing journal folder, with the kind of each."""
    lines = spark.readStream.text(folder).where("trim(value) <> ''")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.get_json_object("value", "$.record").alias("kind"), F.col("value").alias("json"))


EVIDENCE = "journal string, arm string, trials double, promotions double, score_gain double, cost_ms double, accepts double"


def stream_evidence(rows: DataFrame, decay: float = 0.9, retention: float = 0.25, experiment: list[str] | None = None) -> DataFrame:
    """[W8] Decayed evidence by arm as an ordered fold with state: the state of a journal is
    five numbers an arm. ``rows`` has journal, seq, arm, accepted, trials, promotions,
    score_gain, cost_ms, and the columns that the rows of an ``experiment`` share (without
    them each row is one); rows of a batch are ordered by seq, later batches come later, and
    an experiment, one line of the journal, comes in one batch."""
    names = [*SUMS, "accepts"]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        found, before = weighed_by_arm(rows, "arm", experiment or ["seq"], decay, retention)
        if state.exists:
            arms, *sums = state.get
            held = pd.DataFrame(dict(zip(names, map(list, sums))), index=list(arms)) * before
            found = found[names].add(held[names], fill_value=0.0)
        arms = found.index.tolist()
        state.update((arms, *[found[n].tolist() for n in names]))
        yield pd.DataFrame([[key[0], a, *v] for a, v in zip(arms, found[names].to_numpy().tolist())], columns=["journal", "arm", *names])

    kept = "arms array<string>, " + ", ".join(f"{n} array<double>" for n in names)
    return rows.groupBy("journal").applyInPandasWithState(fold, EVIDENCE, kept, "update", GroupStateTimeout.NoTimeout)


def stream_totals(rows: DataFrame) -> DataFrame:
    """[A15, A37] Running totals by arm: an aggregate in complete or update mode."""
    return rows.groupBy("arm").agg(F.count("*").alias("trials"), F.count_if("accepted").alias("accepts"), F.sum("score_gain").alias("score_gain"), F.sum("cost_ms").alias("cost_ms"))


def windowed_totals(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding windows with a watermark."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Session windows by user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


CACHE = "bucket string, value double, inserted long, live boolean"


def stream_cache(rows: DataFrame, max_age_ms: int, most: int) -> DataFrame:
    """[G8] A failed-candidate cache by bucket: a value within tolerance of a live entry is a
    hit, others are inserted; entries expire by age and the oldest go beyond ``most``."""

    def probe(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries = list(zip(*state.get)) if state.exists else []
        out = []
        for row in pd.concat(list(batches)).sort_values("inserted").itertuples():
            entries = [e for e in entries if max(row.inserted - e[1], 0) < max_age_ms]
            hit = any(abs(e[0] - row.value) <= max(1e-9, 1e-6 * max(abs(e[0]), abs(row.value))) for e in entries)
            if not hit:
                entries = [*entries, (row.value, row.inserted)][-most:]
            out.append((key[0], row.value, row.inserted, hit))
        state.update(([e[0] for e in entries], [e[1] for e in entries]))
        yield pd.DataFrame(out, columns=["bucket", "value", "inserted", "live"])

    return rows.groupBy("bucket").applyInPandasWithState(probe, CACHE, "v array<double>, t array<long>", "append", GroupStateTimeout.NoTimeout)


def into_table(stream: DataFrame, path: str, checkpoint: str, key: list[str]):
    """[2.10] Merges each batch's partial sums into a table by foreachBatch; returns the query.

    The batch id is part of the path, so a batch that runs again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*key).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
