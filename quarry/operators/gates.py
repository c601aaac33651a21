"""Score pairing, promotion gates and their replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.profile import robust_sigma


def deltas(scores: DataFrame, batch: str = "experiment", stem: str = "stem", score: str = "score") -> DataFrame:
    """[P1, P3, P5] Scores of a long table against their batch's baseline."""
    base = scores.where(F.col(stem) == "baseline").groupBy(batch).agg(F.max(score).alias("baseline"))
    rest = scores.where(F.col(stem) != "baseline").join(base, batch, "left")
    known = F.coalesce(F.col("baseline"), F.raise_error(F.lit("scores have no baseline to measure deltas against")).cast("double"))
    return rest.withColumn("delta", F.col(score) - known).drop("baseline")


def paired(screen: DataFrame, full: DataFrame, keys: list[str], screen_delta: str, full_delta: str) -> DataFrame:
    """[J1, D1] Full outer join of two score maps, with which side a row is on."""
    a = screen.select(*keys, F.col(screen_delta).alias("screen_delta"), F.lit(True).alias("in_screen"))
    b = full.select(*keys, F.col(full_delta).alias("full_delta"), F.lit(True).alias("in_full"))
    both = a.join(b, keys, "full_outer")
    side = F.when(F.col("in_screen") & F.col("in_full"), "paired").when(F.col("in_screen"), "screen_only").otherwise("full_only")
    return both.select(*keys, "screen_delta", "full_delta", side.alias("side"))


def improvers(df: DataFrame, bar: float = 1e-6) -> DataFrame:
    """[K1] Rows over the bar with their rank, best first, ties by stem, in each batch."""
    best = Window.partitionBy("experiment").orderBy(F.desc("delta"), "stem")
    return df.where(F.col("delta") > bar).withColumn("rank", F.row_number().over(best))


def winners(df: DataFrame) -> DataFrame:
    """[K2] The best stem of each batch, the first one of equals: a partial aggregate, no sort."""
    best = F.min_by(F.struct("stem", "delta"), F.struct(-F.col("delta"), F.col("stem")))
    return df.groupBy("experiment").agg(best.alias("w")).select("experiment", "w.stem", "w.delta")


def gate_thresholds(df: DataFrame, k: float = 3.0, floor: float = 1e-6, mode: str = "noise-aware") -> DataFrame:
    """[G1] By batch: robust sigma and the threshold max(k sigma, floor)."""
    sigma = robust_sigma(F.col("delta")) if mode == "noise-aware" else F.lit(0.0)
    found = df.groupBy("experiment").agg(F.count("*").alias("screened"), sigma.alias("sigma"))
    threshold = F.when(F.col("sigma") > 0, F.greatest(F.col("sigma") * k, F.lit(floor))).otherwise(F.lit(floor))
    return found.withColumn("threshold", threshold)


def promoted(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """[K3, G1, S16] The screened rows that clear their batch's threshold, best first."""
    kept = df.join(thresholds.select("experiment", "threshold"), "experiment").where(F.col("delta") > F.col("threshold"))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("experiment").orderBy(F.desc("delta"), "stem")))


def gate_replay(screen: DataFrame, scored: DataFrame, accepted: DataFrame, k: float = 3.0, floor: float = 1e-6) -> DataFrame:
    """[G2] What a noise-aware gate would have promoted.

    ``screen`` has (experiment, stem, delta), ``scored`` the stems that were promoted as
    run, ``accepted`` (experiment, stem, members): the accepted winner and, for a
    combination that wasn't screened itself, its members, all of which must clear.
    """
    thresholds = gate_thresholds(screen, k, floor)
    judged = screen.join(thresholds, "experiment")
    totals = judged.agg(F.count("*").alias("screened"), F.count_if(F.col("delta") > F.col("threshold")).alias("promoted_under_gate"))
    as_run = scored.join(screen, ["experiment", "stem"], "left_semi").agg(F.count("*").alias("promoted_as_run"))
    members = accepted.select("experiment", F.col("stem").alias("winner"), F.explode_outer("members").alias("stem"))
    clear = members.join(judged.select("experiment", "stem", (F.col("delta") > F.col("threshold")).alias("clears")), ["experiment", "stem"], "left")
    by_members = clear.groupBy("experiment", "winner").agg(F.coalesce(F.bool_and(F.coalesce("clears", F.lit(False))), F.lit(False)).alias("members_clear"))
    own = judged.select("experiment", F.col("stem").alias("winner"), (F.col("delta") > F.col("threshold")).alias("own_clears"))
    verdict = by_members.join(own, ["experiment", "winner"], "left").select(F.coalesce("own_clears", "members_clear").alias("kept"))
    kept = verdict.agg(F.count_if("kept").alias("accepts_kept"), F.count_if(~F.col("kept")).alias("accepts_dropped"))
    found = totals.crossJoin(as_run).crossJoin(kept)  # three single rows
    return found.withColumn("promotions_avoided", F.greatest(F.col("promoted_as_run") - F.col("promoted_under_gate"), F.lit(0)))


def threshold_sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """[A50] At each threshold: how many pairs stay, their share, and how many of them win."""
    grid = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    kept = F.col("screen_delta") > F.col("threshold")
    return pairs.select("screen_delta", "full_delta", grid).groupBy("threshold").agg(
        F.count_if(kept).alias("kept"), (F.count_if(kept) / F.count("*")).alias("share"), F.count_if(kept & (F.col("full_delta") > 1e-6)).alias("accepts_kept")
    )


def calibration(pairs: DataFrame, group: list[str], band: float = 1e-6) -> DataFrame:
    """[A29, A33, A49] Pairs, improvements and precision by group."""
    n = F.count("*")
    better = F.count_if(F.col("full_delta") > 0)
    return pairs.groupBy(*group).agg(
        n.alias("paired"), better.alias("improved"), F.try_divide(better.cast("double"), n).alias("precision"), F.count_if(F.col("full_delta") > band).alias("clearing_bar"), F.avg("screen_delta").alias("mean_screen_delta"), F.max("screen_delta").alias("best_screen_delta"), F.max("full_delta").alias("best_full_delta")
    )


WINDOW, LEAST_PAIRS, MOST_ADJUSTMENT, MARGIN = 128, 8, 8.0, 0.5


def prior_window(pairs: DataFrame, arm: str, order: list[str], experiment: str, window: int = WINDOW) -> DataFrame:
    """[W6] One row an arm and experiment: its last ``window`` pairs before the experiment.

    The frame is bounded, so each row holds at most ``window`` pairs.
    """
    by_arm = Window.partitionBy(arm).orderBy(*order)
    rows = pairs.withColumn("pair_no", F.row_number().over(by_arm))
    frame = by_arm.rowsBetween(-window, -1)
    seen = F.collect_list(F.struct("screen_delta", "full_delta")).over(frame)
    first = F.row_number().over(Window.partitionBy(arm, experiment).orderBy("pair_no"))
    return rows.withColumn("prior", seen).withColumn("first", first).where(F.col("first") == 1).select(arm, experiment, "prior")


def calibrated_multiplier(prior: Column, floor: float, bar: float = 1e-6) -> Column:
    """[W7] Threshold multiplier from prior pairs: half of the weakest win, else the median
    loss held below half of the weakest improvement; null keeps the shared threshold."""
    if not floor > 0:
        return F.lit(None).cast("double")
    clamp = lambda x: F.greatest(F.lit(1 / MOST_ADJUSTMENT), F.least(F.lit(MOST_ADJUSTMENT), x))
    screen = lambda xs: F.transform(xs, lambda p: p["screen_delta"])
    wins = screen(F.filter(prior, lambda p: p["full_delta"] > bar))
    weakest_win = F.array_min(wins)
    win = F.when(weakest_win > 0, weakest_win * MARGIN).otherwise(floor / MOST_ADJUSTMENT)
    losses = F.array_sort(screen(F.filter(prior, lambda p: p["full_delta"] <= 0)))
    n = F.size(losses)
    low, high = F.floor((n - 1) / 2).cast("int"), F.ceil((n - 1) / 2).cast("int")
    median = (F.get(losses, low) + F.get(losses, high)) / 2
    better = F.array_min(screen(F.filter(prior, lambda p: p["full_delta"] > 0)))
    target = F.when(better.isNull(), median).when(better > 0, F.least(median, better * MARGIN))
    loss = F.when((n >= LEAST_PAIRS) & (target > 0), clamp(target / floor))
    return F.when(F.size(prior) >= LEAST_PAIRS, F.when(weakest_win.isNotNull(), clamp(win / floor)).otherwise(loss))


def control_draw(rejected: DataFrame, rate: float, seed: int) -> DataFrame:
    """[K14] ceil(n * rate) rejected rows of each batch, drawn without replacement by a seeded hash."""
    by = Window.partitionBy("experiment")
    ordered = by.orderBy(F.xxhash64(F.lit(seed), "experiment", "stem"), "stem")
    quota = F.ceil(F.count("*").over(by) * min(max(rate, 0.0), 1.0))
    return rejected.withColumn("quota", quota).withColumn("draw", F.row_number().over(ordered)).where(F.col("draw") <= F.col("quota")).drop("draw", "quota")


def screen_decisions(screen: DataFrame, multipliers: DataFrame, shared: float, control_rate: float = 0.02, seed: int = 1) -> DataFrame:
    """[G4] Each screened candidate's threshold, whether it is promoted, and whether as a control."""
    known = screen.join(multipliers.select("experiment", "strategy", "multiplier"), ["experiment", "strategy"], "left")
    judged = known.withColumn("threshold", F.coalesce("multiplier", F.lit(1.0)) * shared).withColumn("clears", F.col("delta") > F.col("threshold"))
    controls = control_draw(judged.where(~F.col("clears")), control_rate, seed).select("experiment", "stem", F.lit(True).alias("control"))
    found = judged.join(controls, ["experiment", "stem"], "left").withColumn("control", F.coalesce("control", F.lit(False)))
    return found.withColumn("promoted", F.col("clears") | F.col("control")).drop("clears", "multiplier")


def threshold_replay(pairs: DataFrame, screen: DataFrame, accepted: DataFrame, floor: float, order: list[str]) -> DataFrame:
    """[G3] Promotions under per-strategy thresholds learnt from earlier pairs only.

    A winner that wasn't screened, such as a combination, counts as kept.
    """
    learnt = prior_window(pairs, "strategy", order, "experiment").withColumn("multiplier", calibrated_multiplier(F.col("prior"), floor))
    judged = screen.join(learnt.select("experiment", "strategy", "multiplier"), ["experiment", "strategy"], "left")
    judged = judged.withColumn("clears", F.col("delta") > F.coalesce("multiplier", F.lit(1.0)) * floor).withColumn("as_run", F.col("delta") > floor)
    kept = accepted.join(judged.select("experiment", "stem", "clears"), ["experiment", "stem"], "left").agg(
        F.count_if(F.coalesce("clears", F.lit(True))).alias("accepts_kept"), F.count_if(~F.coalesce("clears", F.lit(True))).alias("accepts_dropped")
    )
    totals = judged.agg(F.count_if("as_run").alias("promoted_as_run"), F.count_if("clears").alias("promoted_under_thresholds"), F.count_if(F.col("as_run") & ~F.col("clears")).alias("avoided"), F.count_if(~F.col("as_run") & F.col("clears")).alias("added"))
    return totals.crossJoin(kept)  # two single rows


def mirror_pairs(candidates: DataFrame) -> DataFrame:
    """[J5] Originals and mirrors of one axis and step: the first of each, where both are scored."""
    halves = candidates.groupBy("experiment", "axis", F.abs("step").alias("step")).agg(
        F.min(F.when(F.col("role") == "original", F.struct("index", "delta"))).alias("original"), F.min(F.when(F.col("role") == "mirror", F.struct("index", "delta"))).alias("mirror")
    )
    return halves.where(F.col("original").isNotNull() & F.col("mirror").isNotNull()).select(
        "experiment", "axis", F.col("original.index").alias("original_index"), F.col("mirror.index").alias("mirror_index"), F.col("original.delta").alias("original_delta"), F.col("mirror.delta").alias("mirror_delta")
    )


def mirror_report(pairs: DataFrame, bar: float = 1e-6) -> DataFrame:
    """[A24] Pairs, wins by side, pairs lost on both sides and axes to retire."""
    first, second = F.col("original_delta") > bar, F.col("mirror_delta") > bar
    lost = ~first & ~second
    return pairs.agg(
        F.count("*").alias("pairs"), F.count_if(second & (~first | (F.col("mirror_delta") > F.col("original_delta")))).alias("mirror_wins"), F.count_if(lost).alias("both_lost"), F.countDistinct(F.when(lost, F.col("axis"))).alias("axes_lost")
    )
