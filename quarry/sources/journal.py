"""The experiment journal: JSON lines of six kinds, read in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("runHeader", "graftReplay", "scorerCalls", "cacheStandDown", "strategyPriors")
CANDIDATE = "struct<strategy: string, focusNeuron: string, mutation: string, oldValue: double, newValue: double, mirror: struct<axis: string, delta: double, role: string>, followUp: struct<parentExperiment: bigint, parentWinner: string, parentStrategy: string, probe: string>, neighbourhood: struct<rootFocus: string, member: string, hops: int, role: string>>"
CALL = "struct<phase: string, creatures: bigint, sampleRate: double, elapsedMs: bigint, failed: boolean>"
EXPERIMENT = (
    "experimentNumber bigint, timestampUnix bigint, seed bigint, incumbentId string, focusNeuron string, focusNeurons array<string>, "
    "focusStats struct<incomingCount: double, saturationFraction: double, nearZeroFraction: double, postVariance: double, meanBlame: double, meanAbsBlame: double, squash: string>, "
    "followUp struct<parentExperiment: bigint, parentWinner: string>, neighbourhood struct<rootFocus: string, members: array<string>>, strategyAllocation struct<explorationFloor: double, slots: map<string, int>>, "
    f"candidates array<{CANDIDATE}>, candidatesRequested int, batchLimit string, scores map<string, double>, screenScores map<string, double>, baselineSource string, winner string, "
    f"improvement double, accepted boolean, analysisMs bigint, scorerMs bigint, memoHits bigint, memoMisses bigint, memoMsSaved bigint, scorerCalls array<{CALL}>, scorerError string, "
    "comboMembers int, comboMemberIndices array<int>, combosScored int, mirrorAxisFailures array<string>, cacheSkipped int, cacheDeduplicated int, cacheBackfilled int, cacheSize int, cacheLookupMs bigint, cacheMaintenanceMs bigint, cacheRebuildMs bigint, cacheSavedMs double, cacheSpentMs double"
)
REPLAY = f"graftsApplied int, accepted boolean, improvement double, scorerFailures bigint, replayError string, scorerCalls array<{CALL}>"
HEADER = "timestampUnix bigint, seed bigint, version string, config struct<candidates: int, minImprovement: double, screenSampleRate: double, screenPromoteThreshold: double, screenPromoteGate: string, strategyEvidenceDecay: double>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, kind, json) without blank lines.

    A line's place is that of its file, of its split in the file and of the line in the
    split, so it doesn't depend on how files are dealt to tasks.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("json"))
    order = Window.partitionBy("file").orderBy("split", "at")
    kept = raw.where("json <> ''").withColumn("line_no", F.row_number().over(order))
    return kept.select("file", "line_no", F.get_json_object("json", "$.record").alias("kind"), "json")


def checked(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Lines of known kinds. Strictly, an unknown kind or a broken line is an error;
    else it stays behind and ``bad_lines`` counts it."""
    valid = (F.col("kind").isNull() | F.col("kind").isin(*KINDS)) & F.from_json("json", "map<string,string>").isNotNull()
    if not strict:
        return lines.where(valid)
    return lines.where(F.when(valid, True).otherwise(F.raise_error(F.concat(F.lit("unknown journal record at line "), F.col("line_no").cast("string"))).cast("boolean")))


def bad_lines(lines: DataFrame) -> DataFrame:
    """How many lines a lenient reader leaves behind, by file."""
    valid = (F.col("kind").isNull() | F.col("kind").isin(*KINDS)) & F.from_json("json", "map<string,string>").isNotNull()
    return lines.groupBy("file").agg(F.count_if(~valid).alias("bad"), F.count("*").alias("lines"))


def experiments(lines: DataFrame) -> DataFrame:
    """Experiment rows; fields that a journal's version lacks are null."""
    return lines.where("kind IS NULL").select("file", "line_no", F.from_json("json", EXPERIMENT).alias("e")).select("file", "line_no", "e.*")


def headers(lines: DataFrame) -> DataFrame:
    return lines.where("kind = 'runHeader'").select("file", "line_no", F.from_json("json", HEADER).alias("h")).select("file", "line_no", "h.*")


def side_events(lines: DataFrame, kind: str, schema: str) -> DataFrame:
    """Graft replays, scorer calls, stand-downs or priors, by an explicit schema."""
    return lines.where(F.col("kind") == kind).select("file", "line_no", F.from_json("json", schema).alias("r")).select("file", "line_no", "r.*")


def scores(rows: DataFrame, column: str) -> DataFrame:
    """(file, line_no, stem, score) of a score map."""
    return rows.select("file", "line_no", F.explode(column).alias("stem", "score"))


def candidates(rows: DataFrame) -> DataFrame:
    """(file, line_no, index, stem, provenance) of a batch."""
    return rows.select("file", "line_no", F.posexplode("candidates").alias("index", "candidate")).select("file", "line_no", "index", F.format_string("candidate-%03d", F.col("index")).alias("stem"), "candidate.*")


def append(df: DataFrame, path: str) -> None:
    """[S9] Appends rows as JSON lines; Spark's committer adds whole files only."""
    df.write.mode("append").json(path)
