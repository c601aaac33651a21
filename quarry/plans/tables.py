"""Driver tables in the roles of the experiment domain, and the same roles in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import table

#: The least stem in these is each order's first line; 17 digits keep doubles apart.
EXPERIMENTS = """
  SELECT l_orderkey AS experiment, l_returnflag AS strategy, l_extendedprice AS score, l_partkey, l_suppkey, l_quantity, l_discount, l_tax,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM lineitem
"""
DELTAS = f"""
  WITH e AS ({EXPERIMENTS}), b AS (SELECT experiment, score AS baseline FROM e WHERE rn = 1)
  SELECT e.experiment, e.strategy, 'candidate-' || lpad(CAST(e.rn - 2 AS VARCHAR), 3, '0') AS stem, e.score, e.score - b.baseline AS delta,
         e.score * (1 - e.l_discount) - b.baseline AS full_delta, e.l_quantity, e.l_discount, e.l_tax, e.l_partkey, e.l_suppkey
  FROM e JOIN b USING (experiment) WHERE rn > 1
"""


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an experiment, its lines are scored stems, its first line the baseline."""
    lines = table(spark, sf_dir, "lineitem")
    first = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rn = F.row_number().over(first)
    stem = F.when(F.col("rn") == 1, "baseline").otherwise(F.concat(F.lit("candidate-"), F.lpad((F.col("rn") - 2).cast("string"), 3, "0")))
    named = lines.select(F.col("l_orderkey").alias("experiment"), F.col("l_returnflag").alias("strategy"), F.col("l_extendedprice").alias("score"), "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", rn.alias("rn"))
    return named.withColumn("stem", stem)


def candidate_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen and full deltas of candidates against their experiment's baseline."""
    rows = experiments(spark, sf_dir)
    base = F.max(F.when(F.col("rn") == 1, F.col("score"))).over(Window.partitionBy("experiment"))
    known = rows.withColumn("baseline", base).where("rn > 1")
    return known.select("experiment", "strategy", "stem", "score", (F.col("score") - F.col("baseline")).alias("delta"), (F.col("score") * (1 - F.col("l_discount")) - F.col("baseline")).alias("full_delta"), "l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey")


JOURNAL = """
  SELECT user_id, ts, event_id, event_type AS arm, value - 20 AS improvement, value > 60 AS accepted, value AS cost, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events are one journal, in order of (ts, event_id); types are arms."""
    rows = table(spark, sf_dir, "events")
    return rows.select("user_id", "ts", "event_id", F.col("event_type").alias("arm"), (F.col("value") - 20).alias("improvement"), (F.col("value") > 60).alias("accepted"), F.col("value").alias("cost"), F.get_json_object("props", "$.k").cast("long").alias("k"))
