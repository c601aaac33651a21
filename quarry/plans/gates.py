"""Queries over score deltas, gates and calibration (WL3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import gates as g
from quarry.operators import profile as p
from quarry.plans.profile import rounded
from quarry.plans.registry import query
from quarry.plans.tables import DELTAS, EXPERIMENTS, candidate_deltas, experiments


@query("score_delta", f"SELECT experiment, stem, round(delta, 4) AS delta FROM ({DELTAS})")
def score_delta(spark, d):
    """Deltas from the long score table, by a join with its own baseline."""
    return g.deltas(experiments(spark, d)).select("experiment", "stem", F.round("delta", 4).alias("delta"))


@query("winner_per_batch", f"WITH x AS ({DELTAS}), r AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY delta DESC, stem) AS k FROM x) SELECT experiment, stem, round(delta, 4) AS delta FROM r WHERE k = 1")
def winner_per_batch(spark, d):
    """K2: the best candidate of each experiment."""
    return rounded(g.winners(candidate_deltas(spark, d)), 4)


@query("improvers_ranked", f"SELECT experiment, stem, CAST(row_number() OVER (PARTITION BY experiment ORDER BY delta DESC, stem) AS INTEGER) AS rank FROM ({DELTAS}) WHERE delta > 1e-6")
def improvers_ranked(spark, d):
    """Improvers, best first."""
    return g.improvers(candidate_deltas(spark, d)).select("experiment", "stem", "rank")


SIGMA = f"""SELECT experiment, count(*) AS screened, CASE WHEN count(*) < 4 THEN 0 ELSE quantile_cont(abs(delta), 0.25) / 0.3186393639643754 END AS sigma FROM ({DELTAS}) GROUP BY 1"""
GATE = f"SELECT experiment, screened, sigma, CASE WHEN sigma > 0 THEN greatest(3 * sigma, 1e-6) ELSE 1e-6 END AS threshold FROM ({SIGMA})"


@query("promote_noise_gate", f"SELECT experiment, screened, round(sigma, 4) AS sigma, round(threshold, 4) AS threshold FROM ({GATE})")
def promote_noise_gate(spark, d):
    """Robust noise and threshold of each batch."""
    return rounded(g.gate_thresholds(candidate_deltas(spark, d)), 4)


@query("promoted_rows", f"SELECT x.experiment, x.stem, CAST(row_number() OVER (PARTITION BY x.experiment ORDER BY x.delta DESC, x.stem) AS INTEGER) AS rank FROM ({DELTAS}) x JOIN ({GATE}) t USING (experiment) WHERE x.delta > t.threshold")
def promoted_rows(spark, d):
    """What a batch promotes."""
    rows = candidate_deltas(spark, d)
    return g.promoted(rows, g.gate_thresholds(rows)).select("experiment", "stem", "rank")


WON = f"SELECT experiment, stem, delta FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY delta DESC, stem) AS k FROM ({DELTAS})) WHERE k = 1 AND delta > 20000"


@query(
    "gate_replay",
    f"""WITH x AS ({DELTAS}), t AS ({GATE}), j AS (SELECT x.*, t.threshold FROM x JOIN t USING (experiment)), w AS ({WON}), v AS (SELECT w.*, t.threshold FROM w JOIN t USING (experiment))
SELECT (SELECT count(*) FROM j) AS screened, (SELECT count(*) FROM j WHERE delta > threshold) AS promoted_under_gate, (SELECT count(*) FROM j WHERE delta > 1000) AS promoted_as_run,
 (SELECT count(*) FROM v WHERE delta > threshold) AS accepts_kept, (SELECT count(*) FROM v WHERE delta <= threshold) AS accepts_dropped,
 greatest((SELECT count(*) FROM j WHERE delta > 1000) - (SELECT count(*) FROM j WHERE delta > threshold), 0) AS promotions_avoided""",
)
def gate_replay(spark, d):
    """The noise-aware gate replayed over all batches."""
    rows = candidate_deltas(spark, d)
    won = g.winners(rows).where("delta > 20000").withColumn("members", F.array("stem"))
    return g.gate_replay(rows.select("experiment", "stem", "delta"), rows.where("delta > 1000").select("experiment", "stem"), won.select("experiment", "stem", "members"))


SIDES = f"""WITH x AS ({DELTAS}), a AS (SELECT experiment, stem, delta AS screen_delta FROM x WHERE l_quantity > 10), b AS (SELECT experiment, stem, full_delta FROM x WHERE l_quantity < 40)
SELECT coalesce(a.experiment, b.experiment) AS experiment, coalesce(a.stem, b.stem) AS stem, screen_delta, full_delta,
 CASE WHEN a.stem IS NOT NULL AND b.stem IS NOT NULL THEN 'paired' WHEN a.stem IS NOT NULL THEN 'screen_only' ELSE 'full_only' END AS side FROM a FULL JOIN b ON a.experiment = b.experiment AND a.stem = b.stem"""


def _sides(spark, d):
    rows = candidate_deltas(spark, d)
    return g.paired(rows.where("l_quantity > 10"), rows.where("l_quantity < 40"), ["experiment", "stem"], "delta", "full_delta")


@query("paired_scores", f"SELECT side, count(*) AS n, round(avg(screen_delta), 4) AS mean_screen, round(avg(full_delta), 4) AS mean_full FROM ({SIDES}) GROUP BY 1")
def paired_scores(spark, d):
    """Paired and one-sided scores."""
    return _sides(spark, d).groupBy("side").agg(F.count("*").alias("n"), F.round(F.avg("screen_delta"), 4).alias("mean_screen"), F.round(F.avg("full_delta"), 4).alias("mean_full"))


@query(
    "delta_distribution",
    f"SELECT strategy, count(*) AS count, round(min(delta), 4) AS min, round(quantile_cont(delta, 0.25), 4) AS p25, round(quantile_cont(delta, 0.5), 4) AS median, round(quantile_cont(delta, 0.75), 4) AS p75, round(max(delta), 4) AS max, round(avg(delta), 4) AS mean FROM ({DELTAS}) GROUP BY 1",
)
def delta_distribution(spark, d):
    """Distribution of deltas by strategy."""
    return rounded(p.distribution(candidate_deltas(spark, d), ["strategy"], "delta"), 4)


@query(
    "screen_noise",
    f"WITH x AS (SELECT strategy, delta - full_delta AS gap, full_delta FROM ({DELTAS})) SELECT strategy, count(*) AS count, round(avg(gap), 4) AS mean, round(stddev_samp(gap), 4) AS std_dev, round(sqrt(avg(gap * gap)), 4) AS rms, round(max(abs(gap)), 4) AS max_abs FROM x WHERE abs(full_delta) < 5000 GROUP BY 1",
)
def screen_noise(spark, d):
    """Noise of the screen near zero."""
    rows = candidate_deltas(spark, d).withColumn("gap", F.col("delta") - F.col("full_delta"))
    return rounded(p.noise(rows, ["strategy"], "gap", F.abs("full_delta") < 5000), 4)


@query(
    "threshold_sweep",
    f"SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (delta > t) AS kept, round(count(*) FILTER (delta > t) / count(*), 6) AS share, count(*) FILTER (delta > t AND full_delta > 1e-6) AS accepts_kept FROM ({DELTAS}), (SELECT unnest([0, 1000, 5000, 20000]) AS t) GROUP BY 1",
)
def threshold_sweep(spark, d):
    """A grid of thresholds in one pass."""
    return rounded(g.threshold_sweep(candidate_deltas(spark, d).withColumnRenamed("delta", "screen_delta"), [0.0, 1000.0, 5000.0, 20000.0]))


@query(
    "strategy_calibration",
    f"""SELECT strategy, count(*) AS paired, count(*) FILTER (full_delta > 0) AS improved, round(count(*) FILTER (full_delta > 0) / count(*), 6) AS precision, count(*) FILTER (full_delta > 1e-6) AS clearing_bar,
 round(avg(delta), 4) AS mean_screen_delta, round(max(delta), 4) AS best_screen_delta, round(max(full_delta), 4) AS best_full_delta FROM ({DELTAS}) GROUP BY 1""",
)
def strategy_calibration(spark, d):
    """Calibration by strategy."""
    found = g.calibration(candidate_deltas(spark, d).withColumnRenamed("delta", "screen_delta"), ["strategy"])
    return rounded(found.withColumns({c: F.round(c, 4) for c in ("mean_screen_delta", "best_screen_delta", "best_full_delta")}))


@query("calibrated_thresholds")
def calibrated_thresholds(spark, d):
    """Multipliers from the last 128 earlier pairs, for every experiment of each strategy.
    SQL over the whole table would join each experiment with 128 rows; tests hold it against a loop."""
    rows = candidate_deltas(spark, d).withColumnRenamed("delta", "screen_delta")
    prior = g.prior_window(rows, "strategy", ["experiment", "stem"], "experiment")
    return rounded(prior.select("strategy", "experiment", F.size("prior").cast("long").alias("pairs"), g.calibrated_multiplier(F.col("prior"), 500.0, 20000.0).alias("multiplier")))


@query(
    "control_quota",
    f"WITH x AS ({DELTAS}) SELECT experiment, count(*) AS rejected, CAST(ceil(count(*) * 0.25) AS BIGINT) AS controls FROM x WHERE delta <= 1000 GROUP BY 1",
)
def control_quota(spark, d):
    """How many rejected candidates are drawn as controls; which ones is a seeded draw."""
    rejected = candidate_deltas(spark, d).where("delta <= 1000")
    drawn = g.control_draw(rejected, 0.25, 1).groupBy("experiment").agg(F.count("*").alias("controls"))
    return rejected.groupBy("experiment").agg(F.count("*").alias("rejected")).join(drawn, "experiment", "left")


MIRRORS = f"""WITH x AS (SELECT experiment, strategy AS axis, round(l_tax, 2) AS step, stem, delta, CASE WHEN l_discount > 0.05 THEN 'mirror' ELSE 'original' END AS role FROM ({DELTAS})),
h AS (SELECT experiment, axis, step, min(stem) FILTER (role = 'original') AS o, min(stem) FILTER (role = 'mirror') AS m FROM x GROUP BY 1, 2, 3)
SELECT h.experiment, h.axis, h.o, h.m, a.delta AS original_delta, b.delta AS mirror_delta FROM h JOIN x a ON a.experiment = h.experiment AND a.stem = h.o JOIN x b ON b.experiment = h.experiment AND b.stem = h.m"""


@query(
    "mirror_report",
    f"""SELECT count(*) AS pairs, count(*) FILTER (mirror_delta > 1e-6 AND (original_delta <= 1e-6 OR mirror_delta > original_delta)) AS mirror_wins,
 count(*) FILTER (mirror_delta <= 1e-6 AND original_delta <= 1e-6) AS both_lost, count(DISTINCT axis) FILTER (mirror_delta <= 1e-6 AND original_delta <= 1e-6) AS axes_lost FROM ({MIRRORS})""",
)
def mirror_report(spark, d):
    """Mirrored pairs and how they end."""
    rows = candidate_deltas(spark, d).select("experiment", F.col("strategy").alias("axis"), F.round("l_tax", 2).alias("step"), F.col("stem").alias("index"), "delta", F.when(F.col("l_discount") > 0.05, "mirror").otherwise("original").alias("role"))
    return g.mirror_report(g.mirror_pairs(rows))


@query(
    "strategy_report",
    f"""WITH x AS ({DELTAS}), w AS (SELECT experiment, stem FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY delta DESC, stem) AS k FROM x) WHERE k = 1 AND delta > 1000)
SELECT x.strategy, count(*) AS appearances, count(w.stem) AS wins, round(count(w.stem) / count(*), 6) AS rate FROM x LEFT JOIN w ON w.experiment = x.experiment AND w.stem = x.stem GROUP BY 1""",
)
def strategy_report(spark, d):
    """Appearances, wins and win rate by strategy."""
    rows = candidate_deltas(spark, d)
    won = g.winners(rows).where("delta > 1000").select("experiment", "stem", F.lit(1).alias("won"))
    found = rows.join(won, ["experiment", "stem"], "left").groupBy("strategy").agg(F.count("*").alias("appearances"), F.count("won").alias("wins"))
    return found.withColumn("rate", F.round(F.col("wins") / F.col("appearances"), 6))


@query("strategy_mix", f"SELECT strategy, count(*) AS candidates FROM ({EXPERIMENTS}) GROUP BY 1")
def strategy_mix(spark, d):
    """Histogram of strategies."""
    return experiments(spark, d).groupBy("strategy").agg(F.count("*").alias("candidates"))


@query(
    "batch_sizes",
    f"WITH n AS (SELECT experiment, count(*) AS n FROM ({EXPERIMENTS}) GROUP BY 1) SELECT count(*) AS batches, round(avg(n), 6) AS mean_size, min(n) AS least, max(n) AS most, CASE WHEN count(DISTINCT n) = 1 THEN min(n) END AS agreed FROM n",
)
def batch_sizes(spark, d):
    """Sizes of batches, and the size that all agree on, if any."""
    n = experiments(spark, d).groupBy("experiment").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("batches"), F.round(F.avg("n"), 6).alias("mean_size"), F.min("n").alias("least"), F.max("n").alias("most"), F.when(F.count_distinct("n") == 1, F.min("n")).alias("agreed"))
