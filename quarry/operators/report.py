"""The journal's report: one row of totals and rates, tables by strategy and phase (A15-A29),
and all of it as one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import economics
from quarry.operators.profile import least_squares
from quarry.sources.journal import REPLAY, candidates, experiments, scores, side_events


def _scored(column: str) -> F.Column:
    return F.when(F.col("scorerError").isNull() & F.col(column).isNotNull(), F.greatest(F.size(column) - 1, F.lit(0))).otherwise(0)


def totals(rows: DataFrame) -> DataFrame:
    """[A18-A23, W2-W4] One row. Rates without a denominator are 0 or null by field."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.coalesce("analysisMs", F.lit(0)) + F.coalesce("scorerMs", F.lit(0))
    accepted = F.coalesce("accepted", F.lit(False))
    base = F.col("scores")["baseline"]
    at = F.struct("file", "line_no")
    won = accepted & F.col("improvement").isNotNull()
    rows = rows.withColumn("elapsed", F.sum(spent).over(w))
    g = rows.agg(
        F.count("*").alias("experiments"),
        F.count_if(accepted).alias("acceptances"),
        F.count_if(F.col("scorerError").isNotNull()).alias("scorer_failures"),
        F.min_by(base, F.when(base.isNotNull(), at)).alias("opening_baseline"),
        F.min_by("elapsed", F.when(accepted, at)).alias("time_to_first_accept_ms"),
        F.coalesce(F.sum("analysisMs"), F.lit(0)).alias("analysis_ms"),
        F.coalesce(F.sum("scorerMs"), F.lit(0)).alias("scorer_ms"),
        ((F.max("timestampUnix") - F.min("timestampUnix")) * 1000).alias("wall"),
        F.sum(_scored("scores")).alias("candidates_scored"),
        F.sum(_scored("screenScores")).alias("screen_candidates_scored"),
        F.min_by(base, F.when(won, at)).alias("first_won_baseline"),
        F.sum(F.when(won, F.col("improvement"))).alias("gained"),
        F.coalesce(F.sum("memoHits"), F.lit(0)).alias("memo_hits"),
        F.coalesce(F.sum("memoMisses"), F.lit(0)).alias("memo_misses"),
        F.coalesce(F.sum("combosScored"), F.lit(0)).alias("combos_scored"),
        F.count_if(accepted & (F.col("comboMembers") > 1)).alias("combo_acceptances"),
        F.count_if(F.col("baselineSource").isin("remembered", "rememberedVerified")).alias("baselines_remembered"),
        F.count_if(F.col("baselineSource") == "rememberedVerified").alias("baselines_verified"),
        F.sum("cacheSkipped").alias("cache_skipped"),
        F.max("cacheSize").alias("cache_peak"),
        F.max_by("cacheSize", F.when(F.col("cacheSize").isNotNull(), at)).alias("cache_final"),
    )
    zero = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    minutes = F.col("scorer_ms") / 60_000
    spent = F.col("analysis_ms") + F.col("scorer_ms")
    g = g.withColumn("wall_ms", F.when(F.col("wall") > 0, F.col("wall"))).drop("wall")
    improvement = F.col("first_won_baseline") + F.col("gained") - F.col("opening_baseline")
    return g.withColumns(
        {
            "analysis_fraction": zero("analysis_ms", spent),
            "candidates_per_scorer_minute": zero("candidates_scored", minutes),
            "candidates_per_wall_minute": F.try_divide(F.col("candidates_scored").cast("double"), F.col("wall_ms") / 60_000),
            "memo_hit_rate": zero("memo_hits", F.col("memo_hits") + F.col("memo_misses")),
            "mean_experiment_ms": F.coalesce(F.try_divide(spent.cast("double"), F.col("experiments")), F.lit(0.0)),
            "total_improvement": improvement,
            "baseline_scores_saved": F.col("baselines_remembered"),
            "verification_creature_scores": F.col("baselines_verified") * 2,
            "net_creature_scores_saved": F.col("baselines_remembered") - F.col("baselines_verified") * 2,
        }
    ).drop("first_won_baseline", "gained")


def members(rows: DataFrame) -> DataFrame:
    """[J3] The candidates behind each accepted winner: the stated members, else the one
    that the stem names, else none."""
    own = F.regexp_extract("winner", r"^candidate-(\d+)$", 1)
    indices = F.when(F.size(F.coalesce("comboMemberIndices", F.array())) > 0, F.col("comboMemberIndices")).when(own != "", F.array(own.try_cast("int")))
    won = rows.where(F.coalesce("accepted", F.lit(False)) & F.col("winner").isNotNull())
    return won.select("file", "line_no", "improvement", F.explode_outer(indices).alias("index"), F.size(F.coalesce(indices, F.array().cast("array<int>"))).alias("n"))


def strategies(rows: DataFrame) -> DataFrame:
    """[A15, K12] Appearances, wins (one a member) and rate by strategy."""
    c = candidates(rows).select("file", "line_no", "index", F.coalesce("strategy", F.lit("unattributed")).alias("strategy"))
    wins = members(rows).select("file", "line_no", "index", F.lit(1).alias("win"))
    found = c.join(wins, ["file", "line_no", "index"], "left").groupBy("strategy").agg(F.count("*").alias("appearances"), F.count("win").alias("wins"))
    return found.withColumn("rate", F.col("wins") / F.col("appearances")).orderBy(F.desc("wins"), "strategy")


def focuses(rows: DataFrame) -> DataFrame:
    """[A16, D7] Experiments, accepts and split improvement by focus; a journal without
    focus sets has one focus an experiment."""
    focus = F.array_sort(F.array_distinct(F.when(F.size("focusNeurons") > 0, F.col("focusNeurons")).otherwise(F.array("focusNeuron"))))
    accepted = F.coalesce("accepted", F.lit(False))
    each = rows.select(accepted.alias("accepted"), (F.col("improvement") / F.size(focus)).alias("share"), F.explode(focus).alias("focus"))
    return each.groupBy("focus").agg(F.count("*").alias("experiments"), F.count_if("accepted").alias("accepts"), F.coalesce(F.sum(F.when(F.col("accepted"), F.col("share"))), F.lit(0.0)).alias("improvement"))


def call_costs(rows: DataFrame) -> DataFrame:
    """[A28, A41] Cost fit of calls that didn't fail, by phase."""
    calls = rows.select(F.explode("scorerCalls").alias("c")).select("c.*").where(~F.coalesce("failed", F.lit(False)))
    return least_squares(calls, ["phase"], "creatures", "elapsedMs")


def screen_pairs(rows: DataFrame) -> DataFrame:
    """[J1] Candidates that both phases scored: screen and full delta, and the strategy."""
    key = ["file", "line_no", "stem"]
    def deltas(column: str, name: str) -> DataFrame:
        long = scores(rows, column)
        base = long.where("stem = 'baseline'").select("file", "line_no", F.col("score").alias("baseline"))
        return long.where("stem <> 'baseline'").join(base, ["file", "line_no"]).select(*key, (F.col("score") - F.col("baseline")).alias(name))

    both = deltas("screenScores", "screen_delta").join(deltas("scores", "full_delta"), key)
    return both.join(candidates(rows).select(*key, "strategy"), key, "left").withColumn("strategy", F.coalesce("strategy", F.lit("unattributed")))


def sections(lines: DataFrame) -> dict[str, DataFrame]:
    """The report's tables by name, of checked journal lines. Those named in ``ONE_ROW`` have
    one row; the others one a strategy, phase, bucket or focus."""
    rows = experiments(lines)
    return {
        "totals": totals(rows),
        "followUp": economics.follow_up_arms(rows),
        "neighbourhood": economics.neighbourhood_arms(rows),
        "graftReplay": economics.graft_totals(side_events(lines, "graftReplay", REPLAY)),
        "analysisMemo": economics.analysis_memo(rows),
        "candidateBatch": economics.candidate_batches(rows),
        "baselineReuse": economics.baseline_reuse(rows),
        "cache": economics.cache_report(rows),
        "strategies": strategies(rows),
        "strategyAllocation": economics.allocation_report(rows),
        "scorerCallCost": call_costs(rows),
        "focusStats": economics.focus_buckets(rows),
        "focuses": focuses(rows),
    }


ONE_ROW = ("totals", "followUp", "neighbourhood", "graftReplay", "analysisMemo", "candidateBatch", "baselineReuse", "cache")
#: Tables whose size is that of a vocabulary; focuses grow with the network and stay a table.
LISTED = ("strategies", "scorerCallCost", "focusStats")


def document(lines: DataFrame) -> DataFrame:
    """One row, one JSON document: the sections of one row as objects, those that a vocabulary
    bounds as arrays in order of their first column."""
    found = sections(lines)
    parts = [found[n].select(F.struct("*").alias(n)) for n in ONE_ROW]
    parts += [found[n].agg(F.array_sort(F.collect_list(F.struct(*found[n].columns))).alias(n)) for n in LISTED if n != "focusStats"]
    stats = found["focusStats"].withColumn("squash_counts", F.to_json("squash_counts"))
    parts.append(stats.agg(F.array_sort(F.collect_list(F.struct(*stats.columns))).alias("focusStats")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.crossJoin(part)  # one row each
    return whole.select(F.to_json(F.struct("*")).alias("report"))
