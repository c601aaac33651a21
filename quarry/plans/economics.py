"""Queries on a whole journal whose experiments are orders and whose candidates are their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import duration_label
from quarry.operators import economics as e
from quarry.operators import report
from quarry.plans.registry import query
from quarry.plans.profile import rounded
from quarry.session import table

#: Orders in the role of experiments: every field is a rule on the order's key.
RULES = {
    "file": "CAST((l_orderkey - l_orderkey % 97) / 97 % 40 AS INT)", "line_no": "l_orderkey", "accepted": "l_orderkey % 4 = 1", "combo": "l_orderkey % 8 = 1",
    "improvement": "l_orderkey % 100 * 1e-5", "analysis_ms": "l_orderkey % 50", "scorer_ms": "100 + l_orderkey % 200", "called": "l_orderkey % 5 <> 0",
    "screen_call": "l_orderkey % 40", "promote_call": "l_orderkey % 60", "screened": "l_orderkey % 7 <> 0", "burst": "l_orderkey % 6 = 1", "parent": "CAST((l_orderkey - l_orderkey % 12) / 12 AS BIGINT)",
    "expanded": "l_orderkey % 10 < 3", "root": "l_orderkey % 20", "members": "CAST(l_orderkey % 4 AS INT)", "source": "l_orderkey % 11", "stopped": "l_orderkey % 13",
    "cached": "l_orderkey % 9 <> 0", "squash": "CASE l_orderkey % 3 WHEN 0 THEN 'RELU' WHEN 1 THEN 'TANH' END", "focused": "l_orderkey % 17 <> 0", "focus": "l_orderkey % 23",
}
PLACES = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1"
LINES = f"SELECT l_orderkey, {PLACES} AS place, l_returnflag AS strategy, l_linenumber = 5 AS probe, l_linenumber % 3 AS link, l_discount > 0.05 AS promoted FROM lineitem"
FACTS = ", ".join(f"{rule} AS {name}" for name, rule in RULES.items())
#: One row an experiment with counts of its candidates; members of a combination are places 0 and 2.
EXPERIMENTS = f"""SELECT l_orderkey, count(*) AS n, count(*) FILTER (probe) AS probes, count(*) FILTER (NOT probe AND link = 0) AS adjacent, count(*) FILTER (NOT probe AND link <> 0) AS isolated,
 CASE WHEN l_orderkey % 8 = 1 THEN 2 ELSE 1 END AS wanted, count(*) FILTER (won) AS won, count(*) FILTER (won AND probe) AS won_probes, count(*) FILTER (won AND NOT probe AND link = 0) AS won_adjacent, count(*) FILTER (won AND link = 1) AS won_root,
 count(*) FILTER (promoted) AS promotions, {FACTS} FROM (SELECT *, place = 0 OR (place = 2 AND l_orderkey % 8 = 1) AS won FROM ({LINES})) GROUP BY l_orderkey"""


def records(spark, d) -> DataFrame:
    """The journal's experiment rows, with the columns that the operators read."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    probe = F.when(F.col("l_linenumber") == 5, F.struct(F.lit("centre").alias("probe")))
    link = F.when(F.col("l_linenumber") % 3 == 0, "successor").when(F.col("l_linenumber") % 3 == 1, "root")
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", (F.row_number().over(place) - 1).alias("place"), (F.col("l_discount") > 0.05).alias("promoted"),
        F.struct(F.col("l_returnflag").alias("strategy"), probe.alias("followUp"), F.when(link.isNotNull(), F.struct(link.alias("role"))).alias("neighbourhood")).alias("candidate"),
    )
    batch = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("place", "promoted", "candidate"))).alias("b"))
    r = batch.select("b", *[F.expr(rule).alias(name) for name, rule in RULES.items()])
    stem = lambda x: F.format_string("candidate-%03d", x["place"])
    scored = F.map_from_entries(F.concat(F.array(F.struct(F.lit("baseline").alias("stem"), F.lit(1.0).alias("score"))), F.transform(F.filter("b", lambda x: x["promoted"]), lambda x: F.struct(stem(x).alias("stem"), F.lit(1.0).alias("score")))))
    call = lambda phase, ms: F.struct(F.lit(phase).alias("phase"), ms.cast("long").alias("elapsedMs"))
    key = F.col("line_no")
    return r.select(
        "file", "line_no", "accepted", "improvement", F.col("analysis_ms").alias("analysisMs"), F.col("scorer_ms").alias("scorerMs"), F.transform("b", lambda x: x["candidate"]).alias("candidates"), scored.alias("scores"),
        F.when(F.col("screened"), F.transform_values(scored, lambda k, v: v)).alias("screenScores"),
        F.when(F.col("accepted"), F.when(F.col("combo"), "combo-000-k2").otherwise("candidate-000")).alias("winner"), F.when(F.col("combo"), F.array(F.lit(0), F.lit(2))).alias("comboMemberIndices"),
        F.when(F.col("called"), F.array(call("screen", F.col("screen_call")), call("promote", F.col("promote_call")), call("phase0", F.lit(7)))).alias("scorerCalls"),
        F.when(F.col("burst"), F.struct(F.col("parent").alias("parentExperiment"), F.lit("candidate-000").alias("parentWinner"))).alias("followUp"),
        F.when(F.col("expanded"), F.struct(F.col("root").cast("string").alias("rootFocus"), F.array_repeat(F.lit("n"), F.col("members")).alias("members"))).alias("neighbourhood"),
        F.when(F.col("source") == 0, None).when(F.col("source") < 5, "fresh").when(F.col("source") < 8, "remembered").otherwise("rememberedVerified").alias("baselineSource"),
        F.when(F.col("stopped") == 0, "exhausted").when(F.col("stopped") == 1, "quota_ceiling").otherwise("budget").alias("batchLimit"), F.lit(7).alias("candidatesRequested"),
        (key % 5).alias("memoHits"), (key % 3).alias("memoMisses"), (key % 90).alias("memoMsSaved"),
        F.when(F.col("cached"), key % 4).alias("cacheSkipped"), (key % 2).alias("cacheDeduplicated"), (key % 3).alias("cacheBackfilled"), (key % 500).alias("cacheSize"), (key % 30 / 2).alias("cacheSavedMs"),
        F.when(key % 2 == 1, key % 7 / 4).alias("cacheSpentMs"), (key % 5).alias("cacheLookupMs"), (key % 6).alias("cacheMaintenanceMs"), F.when(key % 100 == 1, F.lit(50)).alias("cacheRebuildMs"),
        F.struct(F.when(key % 2 == 0, F.create_map(F.lit("A"), (key % 5).cast("int"), F.lit("Z"), F.lit(1))).alias("slots")).alias("strategyAllocation"),
        F.when(F.col("focused"), F.struct((key % 6).cast("double").alias("incomingCount"), (key % 10 / 10).alias("saturationFraction"), (key % 8 / 8).alias("nearZeroFraction"), (key % 9 / 3).alias("postVariance"), (key % 5 - 2).cast("double").alias("meanBlame"), F.when(key % 2 == 0, key % 7 / 7).alias("meanAbsBlame"), F.col("squash"))).alias("focusStats"),
        F.col("focus").cast("string").alias("focusNeuron"), F.when(key % 3 == 0, F.array(F.col("focus").cast("string"), F.lit("0"))).when(key % 3 == 1, F.array().cast("array<string>")).alias("focusNeurons"),
    )


def _sums(label: str, own: str, pure: str) -> str:
    rule = f"accepted AND won = wanted AND {pure}"
    return f"sum({own}) AS {label}_candidates, sum((analysis_ms + scorer_ms) * {own} / n) AS {label}_ms, count(*) FILTER ({rule}) AS {label}_accepts, coalesce(sum(improvement) FILTER ({rule}), 0) AS {label}_improvement"


def _rates(label: str, value: str, name: str) -> str:
    return f"round(CASE WHEN {label}_candidates > 0 AND {label}_ms > 0 THEN {label}_{value} / ({label}_ms / 3.6e6) END, 6) AS {label}_{name}_per_hour"


def _listed(label: str) -> str:
    return f"CAST({label}_candidates AS BIGINT) AS {label}_candidates, round({label}_ms, 6) AS {label}_ms, {label}_accepts, round({label}_improvement, 6) AS {label}_improvement"


@query(
    "followup_arms",
    f"""WITH x AS ({EXPERIMENTS}), g AS (SELECT count(DISTINCT (file, parent)) FILTER (burst) AS bursts, count(*) FILTER (burst) AS burst_experiments, {_sums("followup", "probes", "won_probes = won")}, {_sums("ordinary", "(n - probes)", "won_probes = 0")},
 count(*) FILTER (accepted AND won = wanted AND won_probes > 0 AND won_probes < won) AS mixed_accepts, count(*) FILTER (accepted AND won < wanted) AS unattributed_accepts FROM x)
SELECT bursts, burst_experiments, {_listed("followup")}, {_listed("ordinary")}, mixed_accepts, unattributed_accepts, {_rates("followup", "improvement", "gain")}, {_rates("ordinary", "improvement", "gain")} FROM g""",
)
def followup_arms(spark, d):
    """Follow-up probes against ordinary candidates."""
    return rounded(e.follow_up_arms(records(spark, d)))


@query(
    "neighbourhood_arms",
    f"""WITH x AS ({EXPERIMENTS}), g AS (SELECT count(*) FILTER (expanded) AS expansions, count(DISTINCT (file, root)) FILTER (expanded) AS roots, CAST(sum(members) FILTER (expanded) AS BIGINT) AS members,
 {_sums("neighbourhood", "adjacent", "won_probes = 0 AND won_adjacent = won")}, {_sums("isolated", "isolated", "won_probes = 0 AND won_adjacent = 0")}, sum(probes) AS excluded_candidates, sum((analysis_ms + scorer_ms) * probes / n) AS excluded_ms,
 count(*) FILTER (accepted AND won = wanted AND won_probes > 0) AS excluded_accepts, count(*) FILTER (accepted AND won = wanted AND won_probes = 0 AND won_adjacent > 0 AND won_adjacent < won) AS mixed_accepts, count(*) FILTER (accepted AND won < wanted) AS unattributed_accepts,
 count(*) FILTER (expanded AND accepted AND won = wanted AND won_probes = 0 AND won_root = won) AS root_accepts, count(*) FILTER (expanded AND accepted AND won = wanted AND won_probes = 0 AND won_adjacent = won) AS adjacent_accepts FROM x)
SELECT expansions, roots, members, {_listed("neighbourhood")}, {_listed("isolated")}, CAST(excluded_candidates AS BIGINT) AS excluded_candidates, round(excluded_ms, 6) AS excluded_ms, excluded_accepts, mixed_accepts, unattributed_accepts, root_accepts, adjacent_accepts,
 {_rates("neighbourhood", "accepts", "wins")}, {_rates("isolated", "accepts", "wins")}, {_rates("neighbourhood", "improvement", "gain")}, {_rates("isolated", "improvement", "gain")} FROM g""",
)
def neighbourhood_arms(spark, d):
    """Adjacent, isolated and excluded candidates."""
    return rounded(e.neighbourhood_arms(records(spark, d)))


#: Candidates with what they cost and earned; weights of 0.9 an experiment and 0.25 an accept.
EARNED = f"""x AS ({EXPERIMENTS}), w AS (SELECT l_orderkey, pow(0.9, count(*) OVER a - 1) * pow(0.25, sum(CAST(accepted AS INT)) OVER a) AS weight FROM x WINDOW a AS (PARTITION BY file ORDER BY line_no DESC)),
c AS (SELECT x.file, l.strategy, w.weight, 1.0 AS trials, CASE WHEN screened AND l.promoted THEN 1.0 ELSE 0 END AS promotions, CASE WHEN accepted AND (l.place = 0 OR (l.place = 2 AND combo)) THEN 1.0 ELSE 0 END AS accepts,
 CASE WHEN accepted AND (l.place = 0 OR (l.place = 2 AND combo)) THEN improvement / wanted ELSE 0 END AS score_gain,
 CASE WHEN called THEN screen_call ELSE scorer_ms END / n + CASE WHEN called THEN promote_call ELSE 0 END * CASE WHEN x.promotions > 0 THEN CASE WHEN l.promoted THEN 1.0 / x.promotions ELSE 0 END ELSE 1.0 / n END AS cost_ms
 FROM ({LINES}) l JOIN x USING (l_orderkey) JOIN w USING (l_orderkey))"""


@query(
    "journal_evidence",
    f"WITH {EARNED} SELECT file, strategy, round(sum(weight * trials), 5) AS trials, round(sum(weight * promotions), 5) AS promotions, round(sum(weight * accepts), 5) AS accepts, round(sum(weight * score_gain), 5) AS score_gain, round(sum(weight * cost_ms), 5) AS cost_ms FROM c GROUP BY 1, 2",
)
def journal_evidence(spark, d):
    """Decayed evidence from experiments: pro-rata costs, credit split over members."""
    return rounded(e.evidence(records(spark, d), 0.9, 0.25), 5)


@query(
    "allocation_report",
    f"""WITH {EARNED}, t AS (SELECT file, strategy, sum(trials) AS trials, sum(promotions) AS promotions, sum(accepts) AS accepts, sum(score_gain) AS score_gain, sum(cost_ms) AS cost_ms,
 (greatest(sum(weight * score_gain) / 1e-6, 0) + 0.05 * sum(weight * promotions)) / (sum(weight * cost_ms) / 1000 + 10) AS v FROM c GROUP BY 1, 2),
s AS (SELECT file, strategy, sum(slots) AS slots FROM (SELECT file, 'A' AS strategy, line_no % 5 AS slots FROM x WHERE line_no % 2 = 0 UNION ALL SELECT file, 'Z', 1 FROM x WHERE line_no % 2 = 0) GROUP BY 1, 2)
SELECT file, strategy, CAST(coalesce(slots, 0) AS BIGINT) AS allocated_slots, CAST(coalesce(trials, 0) AS DOUBLE) AS trials, CAST(coalesce(promotions, 0) AS DOUBLE) AS promotions, CAST(coalesce(accepts, 0) AS DOUBLE) AS accepts, round(coalesce(score_gain, 0), 6) AS score_gain, round(coalesce(cost_ms, 0), 6) AS cost_ms,
 round(coalesce(v, 0), 6) AS estimated_value, CAST(0 AS DOUBLE) AS prior_trials, CAST(0 AS DOUBLE) AS prior_share FROM t FULL JOIN s USING (file, strategy)""",
)
def allocation_report(spark, d):
    """Slots, totals and decayed value of all strategies that were tried or funded."""
    return rounded(e.allocation_report(records(spark, d)))


@query(
    "cache_report",
    f"""WITH x AS ({EXPERIMENTS}), g AS (SELECT count(*) FILTER (cached) AS experiments_with_cache, CAST(sum(n + line_no % 4 + line_no % 2) FILTER (cached) AS BIGINT) AS proposals_examined, CAST(sum(line_no % 4) FILTER (cached) AS BIGINT) AS cache_hits, CAST(sum(line_no % 2) FILTER (cached) AS BIGINT) AS deduplicated,
 CAST(sum(line_no % 3) FILTER (cached) AS BIGINT) AS backfilled, CAST(sum(n) FILTER (cached) AS BIGINT) AS batch_candidates, arg_max(line_no % 500, (file, line_no)) FILTER (cached) AS final_cache_size, max(line_no % 500) FILTER (cached) AS peak_cache_size, sum(line_no % 30 / 2) FILTER (cached) AS estimated_saved_ms,
 CAST(count(*) FILTER (line_no % 100 = 1) * 50 AS BIGINT) AS rebuild_ms, sum(CASE WHEN line_no % 2 = 1 THEN line_no % 7 / 4 ELSE line_no % 5 + line_no % 6 END) FILTER (cached) AS own FROM x)
SELECT experiments_with_cache, proposals_examined, cache_hits, deduplicated, backfilled, batch_candidates, final_cache_size, peak_cache_size, estimated_saved_ms, rebuild_ms, round(cache_hits / proposals_examined, 6) AS hit_rate, own + rebuild_ms AS spent_ms, estimated_saved_ms - own - rebuild_ms AS net_ms FROM g""",
)
def cache_report(spark, d):
    """What the cache saved and cost."""
    return rounded(e.cache_report(records(spark, d)))


@query(
    "baseline_reuse",
    f"""WITH g AS (SELECT count(*) FILTER (source BETWEEN 1 AND 4) AS fresh_promote_calls, count(*) FILTER (source >= 5) AS remembered_promote_calls, count(*) FILTER (source >= 8) AS verified_accepts FROM ({EXPERIMENTS}))
SELECT *, remembered_promote_calls AS baseline_scores_saved, verified_accepts * 2 AS verification_creature_scores, remembered_promote_calls - verified_accepts * 2 AS net_creature_scores_saved, round(remembered_promote_calls / (remembered_promote_calls + fresh_promote_calls), 6) AS remembered_fraction FROM g""",
)
def baseline_reuse(spark, d):
    """Promote calls by the source of their baseline."""
    return rounded(e.baseline_reuse(records(spark, d)))


@query(
    "analysis_memo",
    f"WITH g AS (SELECT CAST(sum(line_no % 5) AS BIGINT) AS hits, CAST(sum(line_no % 3) AS BIGINT) AS misses, CAST(sum(line_no % 90) AS BIGINT) AS ms_saved, sum(analysis_ms) AS ms FROM ({EXPERIMENTS})) SELECT hits, misses, ms_saved, round(hits / (hits + misses), 6) AS hit_rate, round(ms_saved / (ms + ms_saved), 6) AS saved_fraction FROM g",
)
def analysis_memo(spark, d):
    """Memo totals, hit rate and the share of analysis saved."""
    return rounded(e.analysis_memo(records(spark, d)))


@query(
    "candidate_batches",
    f"SELECT round(avg(n), 6) AS mean_generated, CAST(min(n) AS INT) AS min_generated, CAST(max(n) AS INT) AS max_generated, 7 AS requested, count(*) FILTER (stopped = 1) AS quota_ceiling_experiments, count(*) FILTER (stopped = 0) AS exhausted_experiments FROM ({EXPERIMENTS})",
)
def candidate_batches(spark, d):
    """Batch sizes, agreed request, why batches stopped."""
    return rounded(e.candidate_batches(records(spark, d)))


BLAME = "CASE WHEN line_no % 2 = 0 THEN line_no % 7 / 7 ELSE abs(line_no % 5 - 2) END"


@query(
    "focus_statistics",
    f"""WITH x AS (SELECT *, coalesce(squash, 'unknown') AS s FROM ({EXPERIMENTS}) WHERE focused), b AS (SELECT 'all' AS bucket, * FROM x UNION ALL SELECT CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END, * FROM x)
SELECT bucket, count(*) AS experiments, round(avg(line_no % 6), 6) AS mean_incoming_count, round(avg(line_no % 10 / 10), 6) AS mean_saturation_fraction, round(avg(line_no % 8 / 8), 6) AS mean_near_zero_fraction, round(avg(line_no % 9 / 3), 6) AS mean_post_variance, round(avg({BLAME}), 6) AS mean_abs_blame,
 'RELU:' || count(*) FILTER (s = 'RELU') || ' TANH:' || count(*) FILTER (s = 'TANH') || ' unknown:' || count(*) FILTER (s = 'unknown') AS squashes FROM b GROUP BY 1""",
)
def focus_statistics(spark, d):
    """Focus statistics of all, accepted and rejected experiments, with squash counts."""
    found = e.focus_buckets(records(spark, d))
    listed = F.array_join(F.transform(F.map_entries("squash_counts"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), " ")
    return rounded(found.withColumn("squashes", listed).drop("squash_counts"))


@query(
    "journal_strategies",
    f"""WITH x AS ({EXPERIMENTS}) SELECT l.strategy, count(*) AS appearances, count(*) FILTER (accepted AND (l.place = 0 OR (l.place = 2 AND combo))) AS wins, round(count(*) FILTER (accepted AND (l.place = 0 OR (l.place = 2 AND combo))) / count(*), 6) AS rate FROM ({LINES}) l JOIN x USING (l_orderkey) GROUP BY 1""",
)
def journal_strategies(spark, d):
    """Appearances and wins by strategy, one win a member."""
    return rounded(report.strategies(records(spark, d)))


@query(
    "journal_focuses",
    f"""WITH x AS ({EXPERIMENTS}), f AS (SELECT focus, focus AS own, 1.0 AS sets, * EXCLUDE (focus) FROM x WHERE line_no % 3 <> 0 OR focus = 0 UNION ALL SELECT focus, focus, 2.0, * EXCLUDE (focus) FROM x WHERE line_no % 3 = 0 AND focus <> 0 UNION ALL SELECT 0, focus, 2.0, * EXCLUDE (focus) FROM x WHERE line_no % 3 = 0 AND focus <> 0)
SELECT CAST(focus AS VARCHAR) AS focus, count(*) AS experiments, count(*) FILTER (accepted) AS accepts, round(coalesce(sum(improvement / sets) FILTER (accepted), 0), 6) AS improvement FROM f GROUP BY 1""",
)
def journal_focuses(spark, d):
    """Experiments, accepts and split improvement by focus."""
    return rounded(report.focuses(records(spark, d)))


@query("duration_labels", f"SELECT line_no, CASE WHEN scorer_ms * 100 - 10000 >= 1000 THEN printf('%.1fs', (scorer_ms * 100 - 10000) / 1000) ELSE (scorer_ms * 100 - 10000) || 'ms' END AS label FROM ({EXPERIMENTS})")
def duration_labels(spark, d):
    """Durations as the report prints them."""
    return records(spark, d).select("line_no", duration_label(F.col("scorerMs") * 100 - 10000).alias("label"))
