"""What a journal's experiments cost and earned: arms, evidence, allocation, cache, baselines,
batches, memo, grafts and focuses (J2, A17-A22, A25-A27, A37, D3, D5, G6).

All read experiment rows of ``quarry.sources.journal``. Candidates are looked at inside their
row by array functions, so only evidence explodes them; everything else is one aggregate
whose partial sums meet in one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import candidate_arm, per_hour, reward_rate, stem_index, targets_root

EVIDENCE = ["trials", "promotions", "accepts", "score_gain", "cost_ms"]


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def accepted() -> Column:
    return F.coalesce("accepted", F.lit(False))


def batch() -> Column:
    """The candidates of a row, none where the journal has none."""
    return F.coalesce("candidates", F.filter(F.array(F.get("candidates", F.lit(0))), lambda c: F.lit(False)))


def member_indices() -> Column:
    """[J3] The places of the winner's candidates: those stated, else the one that the stem
    names, else none."""
    own = F.regexp_extract("winner", r"^candidate-(\d+)$", 1)
    stated = F.when(F.size("comboMemberIndices") > 0, F.col("comboMemberIndices"))
    return stated.when(own != "", F.array(own.try_cast("int"))).otherwise(F.array().cast("array<int>"))


def _with_arms(rows: DataFrame, arm: Callable[[Column], Column]) -> DataFrame:
    """Rows with the arm of each candidate and of each member of an accepted winner (null
    where a member isn't in the batch) and the work of the experiment."""
    rows = rows.withColumn("_arms", F.transform(batch(), arm)).withColumn("_members", member_indices())
    won = F.transform("_members", lambda i: F.get(F.col("_arms"), i))
    return rows.withColumns({"_won": won, "_work": (_zero("analysisMs") + _zero("scorerMs")).cast("double"), "_n": F.size("_arms")})


def _resolved() -> Column:
    return (F.size("_won") > 0) & F.forall("_won", lambda a: a.isNotNull())


def _every(name: str) -> Column:
    return accepted() & _resolved() & F.forall("_won", lambda a: a == name)


def _arm_sums(label: str, name: str) -> list[Column]:
    """Candidates, apportioned ms, accepts and improvement of one arm: work goes by the number
    of candidates, an accept to an arm only if every member came from it."""
    own = F.size(F.filter("_arms", lambda a: a == name))
    ms = F.when(F.col("_n") > 0, F.col("_work") * own / F.col("_n")).otherwise(0.0)
    gain = F.when(_every(name), F.coalesce("improvement", F.lit(0.0))).otherwise(0.0)
    return [F.sum(own).alias(f"{label}_candidates"), F.sum(ms).alias(f"{label}_ms"), F.count_if(_every(name)).alias(f"{label}_accepts"), F.sum(gain).alias(f"{label}_improvement")]


def _rate(label: str, value: str) -> Column:
    return per_hour(F.col(f"{label}_{value}"), F.col(f"{label}_ms"), F.col(f"{label}_candidates"))


def follow_up_arms(rows: DataFrame) -> DataFrame:
    """[A25, A27, D3] One row: follow-up probes against ordinary candidates. A burst is a
    distinct parent win, however many experiments it spans."""
    rows = _with_arms(rows, lambda c: F.when(c["followUp"].isNotNull(), "followup").otherwise("ordinary"))
    mixed = accepted() & _resolved() & (F.size(F.array_distinct("_won")) > 1)
    found = rows.agg(
        F.count_distinct(F.when(F.col("followUp").isNotNull(), F.struct("file", F.col("followUp.parentExperiment"), F.col("followUp.parentWinner")))).alias("bursts"),
        F.count("followUp").alias("burst_experiments"),
        *_arm_sums("followup", "followup"),
        *_arm_sums("ordinary", "ordinary"),
        F.count_if(mixed).alias("mixed_accepts"),
        F.count_if(accepted() & ~_resolved()).alias("unattributed_accepts"),
    )
    return found.withColumns({f"{a}_gain_per_hour": _rate(a, "improvement") for a in ("followup", "ordinary")})


def neighbourhood_arms(rows: DataFrame) -> DataFrame:
    """[A26, A27, D3] One row: candidates on adjacent structure against isolated ones, and
    follow-up probes, which are priced in neither. A winner with a probe is excluded. Within
    expanded experiments, accepts on the root need every member to name the root."""
    rows = _with_arms(rows, lambda c: candidate_arm(c["followUp"], c["neighbourhood"]))
    roots = F.transform("_members", lambda i: F.get(F.transform(batch(), lambda c: targets_root(c["neighbourhood"])), i))
    rows = rows.withColumn("_roots", roots)
    probed = F.exists("_won", lambda a: a == "excluded")
    mixed = accepted() & _resolved() & ~probed & (F.size(F.array_distinct("_won")) > 1)
    expanded = F.col("neighbourhood").isNotNull()
    excluded = F.size(F.filter("_arms", lambda a: a == "excluded"))
    found = rows.agg(
        F.count("neighbourhood").alias("expansions"),
        F.count_distinct(F.when(expanded, F.struct("file", F.col("neighbourhood.rootFocus")))).alias("roots"),
        F.coalesce(F.sum(F.size("neighbourhood.members")), F.lit(0)).alias("members"),
        *_arm_sums("neighbourhood", "adjacent"),
        *_arm_sums("isolated", "isolated"),
        F.sum(excluded).alias("excluded_candidates"),
        F.sum(F.when(F.col("_n") > 0, F.col("_work") * excluded / F.col("_n")).otherwise(0.0)).alias("excluded_ms"),
        F.count_if(accepted() & _resolved() & probed).alias("excluded_accepts"),
        F.count_if(mixed).alias("mixed_accepts"),
        F.count_if(accepted() & ~_resolved()).alias("unattributed_accepts"),
        F.count_if(expanded & _every("isolated") & F.forall("_roots", lambda x: x)).alias("root_accepts"),
        F.count_if(expanded & _every("adjacent")).alias("adjacent_accepts"),
    )
    arms = ("neighbourhood", "isolated")
    rates = {f"{a}_wins_per_hour": _rate(a, "accepts") for a in arms} | {f"{a}_gain_per_hour": _rate(a, "improvement") for a in arms}
    return found.withColumns(rates)


def _phase_ms(*phases: str) -> Column:
    calls = F.filter("scorerCalls", lambda c: c["phase"].isin(*phases))
    return F.aggregate(calls, F.lit(0.0), lambda a, c: a + F.coalesce(c["elapsedMs"], F.lit(0)))


def evidence(rows: DataFrame, decay: float = 1.0, retention: float = 1.0) -> DataFrame:
    """[A37, W8, J2] Evidence by journal (file) and strategy, from the experiments themselves.

    Screen cost is split over the candidates, promote and combination cost over those that
    were promoted (over all, if none was). A promotion counts only where a screen ran. The
    improvement of an accept is split evenly over the winner's members; a member outside the
    batch takes its part along. With a decay, an experiment weighs decay^(experiments after
    it) times retention^(accepts from it on): weights come from narrow rows, before
    candidates are exploded.
    """
    called = F.coalesce(F.size("scorerCalls") > 0, F.lit(False))
    stems = F.filter(F.transform(F.map_keys("scores"), lambda k: stem_index(k)), lambda i: i.isNotNull() & (i < F.size(batch())))
    rows = rows.select(
        "file", "line_no", accepted().alias("won"), "improvement", member_indices().alias("members"),
        F.transform(batch(), lambda c: F.coalesce(c["strategy"], F.lit("unattributed"))).alias("strategies"),
        F.coalesce(stems, F.array().cast("array<int>")).alias("promoted"), F.col("screenScores").isNotNull().alias("screened"),
        F.when(called, _phase_ms("screen")).otherwise(_zero("scorerMs").cast("double")).alias("screen_ms"),
        F.when(called, _phase_ms("promote", "combo")).otherwise(0.0).alias("promote_ms"),
    )
    weight = F.lit(1.0)
    if decay != 1.0 or retention != 1.0:
        after = Window.partitionBy("file").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
        counts = (F.col("won") & (F.size("strategies") > 0)).cast("int")
        weight = F.pow(F.lit(decay), F.count("*").over(after) - 1) * F.pow(F.lit(retention), F.sum(counts).over(after))
    rows = rows.withColumn("weight", weight)
    each = rows.select("*", F.posexplode("strategies").alias("index", "strategy"))
    is_promoted = F.array_contains("promoted", F.col("index")).cast("double")
    wins = F.when(F.col("won") & F.col("improvement").isNotNull(), F.size(F.filter("members", lambda i: i == F.col("index")))).otherwise(0)
    spread = F.when(F.size("promoted") > 0, is_promoted / F.size("promoted")).otherwise(1.0 / F.size("strategies"))
    each = each.select(
        "file", "strategy", "weight", F.lit(1.0).alias("trials"), F.when(F.col("screened"), is_promoted).otherwise(0.0).alias("promotions"), wins.cast("double").alias("accepts"),
        F.when(wins > 0, wins * F.col("improvement") / F.size("members")).otherwise(0.0).alias("score_gain"), (F.col("screen_ms") / F.size("strategies") + F.col("promote_ms") * spread).alias("cost_ms"),
    )
    return each.groupBy("file", "strategy").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in EVIDENCE])


def allocation_report(rows: DataFrame, decay: float = 0.9, retention: float = 0.25, priors: DataFrame | None = None) -> DataFrame:
    """[G6, D5] By journal and strategy: slots it was given, undecayed totals, the decayed value
    at the end, and what of its decayed trials is still ``priors`` (file, strategy and the five
    sums). A strategy that was given slots and proposed nothing is reported too."""
    slots = rows.select("file", F.explode("strategyAllocation.slots").alias("strategy", "slots")).groupBy("file", "strategy").agg(F.sum("slots").alias("allocated_slots"))
    totals = evidence(rows)
    decayed = evidence(rows, decay, retention)
    if priors is not None:
        ends = rows.groupBy("file").agg((F.pow(F.lit(decay), F.count("*")) * F.pow(F.lit(retention), F.count_if(accepted() & (F.size(batch()) > 0)))).alias("kept"))
        left = priors.join(ends, "file", "left").select("file", "strategy", F.col("trials").alias("prior_trials"), *[(F.coalesce("kept", F.lit(1.0)) * F.col(c)).alias(f"p_{c}") for c in EVIDENCE])
        decayed = decayed.join(left, ["file", "strategy"], "full").select("file", "strategy", "prior_trials", F.col("p_trials").alias("prior"), *[(_zero(c) + _zero(f"p_{c}")).alias(c) for c in EVIDENCE])
    else:
        decayed = decayed.withColumns({"prior_trials": F.lit(0.0), "prior": F.lit(0.0)})
    value = reward_rate(F.col("score_gain"), F.col("promotions"), F.col("cost_ms"))
    decayed = decayed.select("file", "strategy", "prior_trials", value.alias("estimated_value"), _ratio(_zero("prior"), F.col("trials")).alias("prior_share"))
    found = totals.join(slots, ["file", "strategy"], "full").join(decayed, ["file", "strategy"], "left")
    numbers = ["allocated_slots", *EVIDENCE, "estimated_value", "prior_trials", "prior_share"]
    return found.select("file", "strategy", *[_zero(c).alias(c) for c in numbers])


def cache_report(rows: DataFrame) -> DataFrame:
    """[A22] One row. Experiments without ``cacheSkipped`` ran without the cache and count for
    its rebuild only; a row that states no spent time is priced by its lookups and upkeep."""
    on = F.col("cacheSkipped").isNotNull()
    own = lambda c: F.when(on, F.coalesce(c, F.lit(0))).otherwise(0)
    spent = F.coalesce("cacheSpentMs", (_zero("cacheLookupMs") + _zero("cacheMaintenanceMs")).cast("double"))
    size = F.when(on, F.col("cacheSize"))
    g = rows.agg(
        F.count_if(on).alias("experiments_with_cache"),
        F.sum(own(F.size(batch()) + F.col("cacheSkipped") + _zero("cacheDeduplicated"))).alias("proposals_examined"),
        F.sum(own(F.col("cacheSkipped"))).alias("cache_hits"),
        F.sum(own(F.col("cacheDeduplicated"))).alias("deduplicated"),
        F.sum(own(F.col("cacheBackfilled"))).alias("backfilled"),
        F.sum(own(F.size(batch()))).alias("batch_candidates"),
        F.max_by(size, F.when(size.isNotNull(), F.struct("file", "line_no"))).alias("final_cache_size"),
        F.max(size).alias("peak_cache_size"),
        F.sum(own(F.col("cacheSavedMs"))).alias("estimated_saved_ms"),
        F.sum(own(spent)).alias("experiment_spent_ms"),
        F.coalesce(F.sum("cacheRebuildMs"), F.lit(0)).alias("rebuild_ms"),
    )
    g = g.withColumn("hit_rate", _ratio(F.col("cache_hits"), F.col("proposals_examined"))).withColumn("spent_ms", F.col("experiment_spent_ms") + F.col("rebuild_ms")).drop("experiment_spent_ms")
    return g.withColumn("net_ms", F.col("estimated_saved_ms") - F.col("spent_ms"))


def baseline_reuse(rows: DataFrame) -> DataFrame:
    """[A21] One row: promote calls by where their baseline came from; a verified one was
    remembered too, and its verification scored two creatures."""
    source = F.col("baselineSource")
    remembered = source.isNotNull() & (source != "fresh")
    g = rows.agg(F.count_if(source == "fresh").alias("fresh_promote_calls"), F.count_if(remembered).alias("remembered_promote_calls"), F.count_if(source == "rememberedVerified").alias("verified_accepts"))
    saved, verifying = F.col("remembered_promote_calls"), F.col("verified_accepts") * 2
    return g.withColumns({"baseline_scores_saved": saved, "verification_creature_scores": verifying, "net_creature_scores_saved": saved - verifying, "remembered_fraction": _ratio(saved, saved + F.col("fresh_promote_calls"))})


def analysis_memo(rows: DataFrame) -> DataFrame:
    """[A19] One row: look-ups and the share of analysis that they saved."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    g = rows.agg(total("memoHits").alias("hits"), total("memoMisses").alias("misses"), total("memoMsSaved").alias("ms_saved"), total("analysisMs").alias("ms"))
    return g.select("hits", "misses", "ms_saved", _ratio(F.col("hits"), F.col("hits") + F.col("misses")).alias("hit_rate"), _ratio(F.col("ms_saved"), F.col("ms") + F.col("ms_saved")).alias("saved_fraction"))


def candidate_batches(rows: DataFrame) -> DataFrame:
    """[A20, W18] One row: sizes of batches, the request that all agree on, and why they stopped."""
    n, asked = F.size(batch()), F.col("candidatesRequested")
    zero = lambda c, to: F.coalesce(c, F.lit(0).cast(to))
    return rows.agg(
        zero(F.avg(n), "double").alias("mean_generated"), zero(F.min(n), "int").alias("min_generated"), zero(F.max(n), "int").alias("max_generated"),
        F.when(F.min(asked) == F.max(asked), F.min(asked)).alias("requested"),
        F.count_if(F.col("batchLimit") == "quota_ceiling").alias("quota_ceiling_experiments"), F.count_if(F.col("batchLimit") == "exhausted").alias("exhausted_experiments"),
    )


def graft_totals(replays: DataFrame) -> DataFrame:
    """[A18] One row over replay lines; applied grafts and improvement count only if accepted."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return replays.agg(
        F.count("*").alias("replays"), total("scorerFailures").alias("scorer_failures"), F.count("replayError").alias("replay_errors"), F.count_if(accepted()).alias("accepts"),
        total(F.when(accepted(), F.col("graftsApplied"))).alias("grafts_applied"), F.coalesce(F.sum(F.when(accepted(), F.col("improvement"))), F.lit(0.0)).alias("cumulative_improvement"),
    )


FOCUS_MEANS = {"incomingCount": "mean_incoming_count", "saturationFraction": "mean_saturation_fraction", "nearZeroFraction": "mean_near_zero_fraction", "postVariance": "mean_post_variance"}


def focus_buckets(rows: DataFrame) -> DataFrame:
    """[A17] Focus statistics of all, accepted and rejected experiments that have them, with a
    map of their squashes. One pass of grouping sets; the second level has a row a squash."""
    s = rows.where("focusStats IS NOT NULL").select(accepted().alias("accepted"), F.coalesce("focusStats.squash", F.lit("unknown")).alias("squash"), *[F.col(f"focusStats.{c}").cast("double").alias(c) for c in FOCUS_MEANS], F.coalesce("focusStats.meanAbsBlame", F.abs("focusStats.meanBlame")).alias("blame"))
    sums = [F.sum(c).alias(c) for c in FOCUS_MEANS]
    by = s.groupingSets([["squash"], ["accepted", "squash"]], "accepted", "squash").agg(F.grouping("accepted").alias("g"), F.count("*").alias("n"), *sums, F.sum("blame").alias("blame"), F.count("blame").alias("blamed"))
    bucket = F.when(F.col("g") == 1, "all").when(F.col("accepted"), "accepted").otherwise("rejected")
    return by.groupBy(bucket.alias("bucket")).agg(
        F.sum("n").alias("experiments"), *[(F.sum(c) / F.sum("n")).alias(name) for c, name in FOCUS_MEANS.items()],
        F.try_divide(F.sum("blame"), F.sum("blamed")).alias("mean_abs_blame"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("squash", "n")))).alias("squash_counts"),
    )
