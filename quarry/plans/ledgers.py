"""Queries over the journal in order: ledgers, caches, allocation (WL3, WL5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars as s
from quarry.operators import ledgers as l
from quarry.plans.profile import rounded
from quarry.plans.registry import query
from quarry.plans.tables import JOURNAL, journal
from quarry.session import table

KEY, LINE = ["user_id"], ["ts", "event_id"]
OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(
    "running_best",
    f"""WITH j AS ({JOURNAL}), r AS (SELECT *, first_value(cost ORDER BY ts, event_id) FILTER (accepted) {OVER} AS f0, sum(improvement) FILTER (accepted) {OVER} AS gained, min(CASE WHEN accepted THEN event_id END) {OVER} AS m FROM j),
a AS (SELECT user_id, arg_min(cost, (ts, event_id)) AS first_cost FROM j WHERE accepted GROUP BY 1)
SELECT r.event_id, round(CASE WHEN r.gained IS NOT NULL THEN a.first_cost + r.gained END, 4) AS best FROM r LEFT JOIN a USING (user_id)""".replace("first_value(cost ORDER BY ts, event_id) FILTER (accepted) " + OVER + " AS f0, ", ""),
)
def running_best(spark, d):
    """Running best over accepted rows."""
    return rounded(l.running_best(journal(spark, d).withColumn("baseline", F.col("cost")), KEY, LINE).select("event_id", "best"), 4)


@query(
    "first_accept",
    f"WITH r AS (SELECT *, sum(cost + k) {OVER} AS elapsed FROM ({JOURNAL})) SELECT user_id, round(min(elapsed) FILTER (accepted), 4) AS time_to_first_accept_ms FROM r GROUP BY 1",
)
def first_accept(spark, d):
    """Elapsed up to the first accept."""
    rows = journal(spark, d).withColumn("analysis_ms", F.col("cost")).withColumn("scorer_ms", F.col("k"))
    return rounded(l.time_to_first_accept(rows, KEY, LINE), 4)


@query("opening_baseline", f"SELECT user_id, arg_min(cost, (ts, event_id)) AS opening_baseline FROM ({JOURNAL}) WHERE k > 20 GROUP BY 1")
def opening_baseline(spark, d):
    """The first baseline that isn't null."""
    return l.opening_baseline(journal(spark, d).withColumn("baseline", F.when(F.col("k") > 20, F.col("cost"))), KEY, LINE)


@query(
    "asof_header",
    f"WITH j AS ({JOURNAL}), h AS (SELECT user_id, ts, event_id, k FROM j WHERE arm = 'signup' OR arm = 'login') SELECT j.event_id, (SELECT h.k FROM h WHERE h.user_id = j.user_id AND (h.ts, h.event_id) <= (j.ts, j.event_id) ORDER BY h.ts DESC, h.event_id DESC LIMIT 1) AS header FROM j",
)
def asof_header(spark, d):
    """The latest header at or above each line."""
    return l.header_as_of(journal(spark, d), KEY, LINE, F.col("arm").isin("signup", "login"), F.col("k")).select("event_id", "header")


@query("agreed_header", f"SELECT user_id, CASE WHEN count(DISTINCT k) = 1 THEN min(k) END AS agreed_k, CASE WHEN count(DISTINCT arm) = 1 THEN min(arm) END AS agreed_arm FROM ({JOURNAL}) GROUP BY 1")
def agreed_header(spark, d):
    """What all lines of a journal agree on."""
    return journal(spark, d).groupBy("user_id").agg(l.agreed(F.col("k")).alias("agreed_k"), l.agreed(F.col("arm")).alias("agreed_arm"))


DECAY = f"""WITH j AS ({JOURNAL}), n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS total, sum(CAST(accepted AS INT)) OVER (PARTITION BY user_id) - sum(CAST(accepted AS INT)) {OVER} + CAST(accepted AS INT) AS later FROM j WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT *, pow(0.9, total - i) * pow(0.25, later) AS w FROM n)
SELECT user_id, arm, sum(w) AS trials, sum(w * CAST(k > 50 AS INT)) AS promotions, sum(w * CASE WHEN accepted THEN improvement ELSE 0 END) AS score_gain, sum(w * cost) AS cost_ms, sum(w * CAST(accepted AS INT)) AS accepts FROM x GROUP BY 1, 2"""
VALUE = "(greatest(score_gain / 1e-6, 0) + 0.05 * promotions) / (cost_ms / 1000 + 10)"


def evidence(spark, d):
    rows = journal(spark, d).withColumns({"trials": F.lit(1.0), "promotions": (F.col("k") > 50).cast("double"), "score_gain": F.when(F.col("accepted"), F.col("improvement")).otherwise(0.0), "cost_ms": F.col("cost")})
    return rows.select("user_id", "ts", "event_id", "arm", "accepted", "trials", "promotions", "score_gain", "cost_ms")


@query("decayed_evidence", f"SELECT user_id, arm, round(trials, 6) AS trials, round(promotions, 6) AS promotions, round(score_gain, 6) AS score_gain, round(cost_ms, 6) AS cost_ms, round(accepts, 6) AS accepts FROM ({DECAY})")
def decayed_evidence(spark, d):
    """Decayed evidence in closed form."""
    return rounded(l.decayed_evidence(evidence(spark, d), KEY, LINE, "arm").drop("value"))


@query("decayed_evidence_fold", f"SELECT user_id, arm, round(trials, 6) AS trials, round(promotions, 6) AS promotions, round(score_gain, 6) AS score_gain, round(cost_ms, 6) AS cost_ms, round(accepts, 6) AS accepts FROM ({DECAY})")
def decayed_evidence_fold(spark, d):
    """W8 as the ordered fold that streams use."""
    return rounded(l.fold_evidence(evidence(spark, d), KEY, LINE, "arm"))


BY_DAY = f"""WITH j AS ({JOURNAL}), n AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS e FROM j),
p AS (SELECT user_id, e, max(CAST(accepted AS INT)) AS won FROM n GROUP BY 1, 2),
q AS (SELECT user_id, e, sum(won) OVER (PARTITION BY user_id ORDER BY e DESC) AS later, max(e) OVER (PARTITION BY user_id) AS total FROM p),
x AS (SELECT n.*, pow(0.9, total - e) * pow(0.25, later) AS w FROM n JOIN q USING (user_id, e))
SELECT user_id, arm, round(sum(w), 6) AS trials, round(sum(w * CAST(k > 50 AS INT)), 6) AS promotions, round(sum(w * CASE WHEN accepted THEN improvement ELSE 0 END), 6) AS score_gain, round(sum(w * cost), 6) AS cost_ms, round(sum(w * CAST(accepted AS INT)), 6) AS accepts FROM x GROUP BY 1, 2"""


@query("decayed_evidence_experiments", BY_DAY)
def decayed_evidence_experiments(spark, d):
    """Experiments of several arms, here the rows of a day, decay once each."""
    rows = evidence(spark, d).withColumn("day", F.to_date("ts"))
    return rounded(l.decayed_evidence(rows, KEY, LINE, "arm", experiment=["day"]).drop("value"))


@query("decayed_evidence_experiments_fold", BY_DAY)
def decayed_evidence_experiments_fold(spark, d):
    """The same as the fold that streams use."""
    rows = evidence(spark, d).withColumn("day", F.to_date("ts"))
    return rounded(l.fold_evidence(rows, KEY, LINE, "arm", experiment=["day"]))


@query("strategy_evidence", f"SELECT arm, count(*) AS trials, count(*) FILTER (k > 50) AS promotions, count(*) FILTER (accepted) AS accepts, round(sum(improvement) FILTER (accepted), 4) AS score_gain, round(sum(cost), 4) AS cost_ms FROM ({JOURNAL}) GROUP BY 1")
def strategy_evidence(spark, d):
    """Undecayed totals by arm."""
    return journal(spark, d).groupBy("arm").agg(
        F.count("*").alias("trials"), F.count_if(F.col("k") > 50).alias("promotions"), F.count_if("accepted").alias("accepts"), F.round(F.sum(F.when(F.col("accepted"), F.col("improvement"))), 4).alias("score_gain"), F.round(F.sum("cost"), 4).alias("cost_ms")
    )


ARMS = f"SELECT arm, CAST(count(*) AS DOUBLE) AS trials, CAST(count(*) FILTER (k > 50) AS DOUBLE) AS promotions, sum(CASE WHEN accepted THEN improvement ELSE 0 END) * 1e-9 AS score_gain, sum(cost) AS cost_ms FROM ({JOURNAL}) GROUP BY 1"


@query(
    "allocation_slots",
    f"""WITH a AS ({ARMS}), u AS (SELECT 'tried' AS pool, * FROM a UNION ALL SELECT 'untried', arm, 0.0, 0.0, 0.0, 0.0 FROM a), b AS (SELECT unnest([0, 29, 100]) AS budget),
v AS (SELECT pool, budget, arm, {VALUE} AS value, greatest({VALUE} + 0.5 * (1.0 / (avg(cost_ms) OVER p / 1000 + 10)) * sqrt(ln(1 + sum(trials) OVER p) / greatest(trials, 1)), 0) AS idx, count(*) OVER p AS n,
row_number() OVER (PARTITION BY pool, budget ORDER BY trials, arm) AS cold, CAST(floor(0.2 * budget + 0.5) AS BIGINT) AS reserve FROM u, b WINDOW p AS (PARTITION BY pool, budget)),
r AS (SELECT *, reserve // n + CASE WHEN cold <= reserve % n THEN 1 ELSE 0 END AS reserved, (budget - reserve) * CASE WHEN sum(idx) OVER p > 0 THEN idx / sum(idx) OVER p ELSE 1.0 / n END AS share FROM v WINDOW p AS (PARTITION BY pool, budget)),
f AS (SELECT *, floor(share) AS whole, row_number() OVER (PARTITION BY pool, budget ORDER BY share - floor(share) DESC, arm) AS rk, budget - reserve - sum(floor(share)) OVER (PARTITION BY pool, budget) AS spare FROM r)
SELECT pool, CAST(budget AS INT) AS budget, arm, round(value, 6) AS value, CAST(reserved + whole + CASE WHEN rk <= spare THEN 1 ELSE 0 END AS BIGINT) AS slots FROM f""",
)
def allocation_slots(spark, d):
    """Slots by reserve and optimistic value, which sum to each budget, of arms
    that were tried and of a pool without trials."""
    arms = journal(spark, d).groupBy("arm").agg(
        F.count("*").cast("double").alias("trials"), F.count_if(F.col("k") > 50).cast("double").alias("promotions"), (F.sum(F.when(F.col("accepted"), F.col("improvement")).otherwise(0.0)) * 1e-9).alias("score_gain"), F.sum("cost").alias("cost_ms")
    )
    pools = {"tried": arms, "untried": arms.select("arm", *[F.lit(0.0).alias(c) for c in ("trials", "promotions", "score_gain", "cost_ms")])}
    found = [l.slots(rows, budget).select(F.lit(pool).alias("pool"), F.lit(budget).alias("budget"), "arm", "value", "slots") for pool, rows in pools.items() for budget in (0, 29, 100)]
    return rounded(reduce(DataFrame.unionByName, found))


@query(
    "merged_priors",
    f"""WITH m AS ({ARMS}), p AS (SELECT event_type AS arm, CAST(count(*) AS DOUBLE) / 40 AS trials FROM events GROUP BY 1),
s AS (SELECT arm, trials * least(1.0, 25 / (trials * 0.5)) * 0.5 AS t FROM p) SELECT m.arm, round(m.trials + t, 4) AS trials, round(t / (m.trials + t), 6) AS prior_share FROM m JOIN s USING (arm)""",
)
def merged_priors(spark, d):
    """Prior evidence, scaled and capped, beside the measured."""
    zero = {c: F.lit(0.0) for c in ("promotions", "accepts", "score_gain", "cost_ms")}
    rows = journal(spark, d).groupBy("arm").agg(F.count("*").cast("double").alias("trials"))
    found = l.merge_priors(rows.withColumns(zero), rows.withColumn("trials", F.col("trials") / 40).withColumns(zero), 0.5)
    return found.select("arm", F.round("trials", 4).alias("trials"), F.round("prior_share", 6).alias("prior_share"))


@query(
    "rolling_guardrail",
    f"""WITH j AS ({JOURNAL}), r AS (SELECT *, sum(k - cost) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS net, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM j),
f AS (SELECT user_id, min(n) AS first_bad FROM r WHERE n >= 20 AND net < -1000 GROUP BY 1)
SELECT event_id, round(net, 4) AS net, coalesce(n >= first_bad, false) AS stood_down FROM r LEFT JOIN f USING (user_id)""",
)
def rolling_guardrail(spark, d):
    """Net of the last 20 rows and where the cache stands down."""
    return rounded(l.rolling_guardrail(journal(spark, d), KEY, LINE, "k", "cost").select("event_id", "net", "stood_down"), 4)


@query(
    "ewma_by_user",
    """WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, value AS e FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, 0.3 * r.value + 0.7 * f.e FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
SELECT user_id, max(i) AS n, round(arg_max(e, i), 6) AS ewma FROM f GROUP BY 1""",
)
def ewma_by_user(spark, d):
    """Exponentially weighted difficulty of each record."""
    return rounded(l.ewma(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value"))


@query(
    "cache_value",
    f"""WITH j AS (SELECT *, k % 3 AS skipped, k % 2 AS skipped_promoted, cost * 2 AS screen_ms, k + 1 AS screen_creatures, cost * 3 AS promote_ms, k % 5 AS promote_creatures FROM ({JOURNAL})),
m AS (SELECT *, sum(screen_ms) {OVER} / sum(screen_creatures) {OVER} AS a, coalesce(sum(promote_ms) {OVER} / nullif(sum(promote_creatures) {OVER}, 0), 0) AS b, sum(skipped) {OVER} AS s1, sum(skipped_promoted) {OVER} AS s2, sum(cost) {OVER} AS c FROM j)
SELECT event_id, round(skipped * a + skipped_promoted * b + 1e-7, 3) AS saved_ms, round(s1 * a + s2 * b - c + 1e-7, 3) AS net_cumulative_ms FROM m""",
)
def cache_value(spark, d):
    """Savings at the mean cost known by then."""
    rows = journal(spark, d).withColumns({"skipped": F.col("k") % 3, "skipped_promoted": F.col("k") % 2, "screen_ms": F.col("cost") * 2, "screen_creatures": F.col("k") + 1, "promote_ms": F.col("cost") * 3, "promote_creatures": F.col("k") % 5, "spent_ms": F.col("cost")})
    found = l.cache_value(rows, KEY, LINE)
    return found.select("event_id", F.round(F.col("saved_ms") + 1e-7, 3).alias("saved_ms"), F.round(F.col("net_cumulative_ms") + 1e-7, 3).alias("net_cumulative_ms"))


NEAR = "abs(p.value - c.value) <= greatest(1e-9, 1e-6 * greatest(abs(p.value), abs(c.value)))"


@query("tolerance_anti_join", f"SELECT p.event_id FROM events p WHERE p.event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_id % 2 = 0 AND c.user_id % 10 = p.user_id % 10 AND c.event_type = p.event_type AND {NEAR.replace('1e-9', '1e-9')})")
def tolerance_anti_join(spark, d):
    """Probes without a cache entry in tolerance."""
    e = table(spark, d, "events").withColumn("cell", F.col("user_id") % 10)
    return l.cache_misses(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), ["cell", "event_type"], "value").select("event_id")


@query("ttl_cap_eviction", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts) // 1 DESC, event_id DESC) AS r FROM events WHERE greatest(1710000000 - CAST(floor(epoch(ts)) AS BIGINT), 0) < 6048000) SELECT user_id, count(*) AS live, min(event_id) AS oldest FROM l WHERE r <= 25 GROUP BY 1")
def ttl_cap_eviction(spark, d):
    """What age and cap leave."""
    cache = table(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("inserted"), F.col("event_id").alias("seq"))
    return l.evict(cache, 1_710_000_000, 6_048_000, 25, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("live"), F.min("event_id").alias("oldest"))


@query("first_of_near", "SELECT user_id, count(*) AS kept FROM (SELECT DISTINCT user_id, round(value, 2) AS v FROM events) GROUP BY 1")
def first_of_near(spark, d):
    """Greedy suppression of near-equal values; values here have two digits, so it is a distinct."""
    rows = table(spark, d, "events").select("user_id", "event_id", "value")
    return l.first_of_near(rows, ["user_id"], ["event_id"], "value").groupBy("user_id").agg(F.count("*").alias("kept"))


@query("cache_rebuild", "SELECT event_type AS strategy, count(*) AS entries FROM (SELECT DISTINCT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events WHERE NOT value > 60 AND event_id % 7 <> 0) GROUP BY 1")
def cache_rebuild(spark, d):
    """Cache entries rebuilt from the journal."""
    j = journal(spark, d)
    rows = j.select(F.col("user_id").alias("incumbent"), F.col("arm").alias("strategy"), F.lit("f").alias("focus"), F.col("k").cast("string").alias("mutation"), F.lit(None).cast("double").alias("new_value"), "accepted", F.lit(None).cast("string").alias("scorer_error"), (F.col("event_id") % 7 != 0).alias("scored"), F.lit(False).alias("is_winner"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_id").alias("line"), F.lit(False).alias("promoted"))
    return l.rebuild_cache(rows).groupBy("strategy").agg(F.count("*").alias("entries"))


@query(
    "arm_rates_per_hour",
    f"SELECT arm, count(*) AS candidates, round(CASE WHEN count(*) > 0 AND sum(cost) > 0 THEN count(*) FILTER (accepted) / (sum(cost) / 3.6e6) END, 4) AS accepts_per_hour, round(sum(improvement) FILTER (accepted) / (sum(cost) / 3.6e6), 2) AS gain_per_hour FROM ({JOURNAL}) GROUP BY 1",
)
def arm_rates_per_hour(spark, d):
    """Rates of arms by hour, null where nothing was measured."""
    rows = journal(spark, d).groupBy("arm").agg(F.count("*").alias("candidates"), F.sum("cost").alias("ms"), F.count_if("accepted").cast("double").alias("a"), F.sum(F.when(F.col("accepted"), F.col("improvement"))).alias("gain"))
    rate = lambda v: s.per_hour(F.col(v), F.col("ms"), F.col("candidates"))
    return rows.select("arm", "candidates", F.round(rate("a"), 4).alias("accepts_per_hour"), F.round(rate("gain"), 2).alias("gain_per_hour"))


@query("focus_report", f"SELECT user_id, count(*) AS experiments, count(*) FILTER (accepted) AS accepts, round(coalesce(sum(improvement / 2) FILTER (accepted), 0), 4) AS split_improvement FROM ({JOURNAL}), (SELECT unnest([0, 1]) AS side) GROUP BY user_id")
def focus_report(spark, d):
    """Accepts and improvement split over an experiment's distinct focuses."""
    rows = journal(spark, d).withColumn("focuses", F.array_sort(F.array_distinct(F.array(F.col("user_id"), F.col("user_id") + 1000, F.col("user_id")))))
    each = rows.select("user_id", "accepted", (F.col("improvement") / F.size("focuses")).alias("share"), F.explode("focuses").alias("focus"))
    return each.groupBy("user_id").agg(F.count("*").alias("experiments"), F.count_if("accepted").alias("accepts"), F.round(F.coalesce(F.sum(F.when(F.col("accepted"), F.col("share"))), F.lit(0.0)), 4).alias("split_improvement"))


@query("focus_buckets", f"SELECT CASE WHEN grouping(accepted) = 1 THEN 'all' WHEN accepted THEN 'accepted' ELSE 'rejected' END AS bucket, count(*) AS n, round(avg(cost), 4) AS mean_cost FROM ({JOURNAL}) GROUP BY GROUPING SETS ((), (accepted))")
def focus_buckets(spark, d):
    """All, accepted and rejected rows in one pass of grouping sets."""
    g = journal(spark, d).groupingSets([[], ["accepted"]], "accepted").agg(F.grouping("accepted").alias("g"), F.count("*").alias("n"), F.round(F.avg("cost"), 4).alias("mean_cost"))
    return g.select(F.when(F.col("g") == 1, "all").when(F.col("accepted"), "accepted").otherwise("rejected").alias("bucket"), "n", "mean_cost")


@query(
    "run_totals",
    f"""WITH g AS (SELECT count(*) AS experiments, count(*) FILTER (accepted) AS acceptances, sum(k) AS analysis, sum(cost) AS scorer, (epoch(max(ts)) // 1 - epoch(min(ts)) // 1) * 1000 AS wall FROM ({JOURNAL}))
SELECT experiments, acceptances, round(analysis / (analysis + scorer), 6) AS analysis_fraction, round(experiments / (scorer / 60000), 4) AS per_scorer_minute, round(experiments / (wall / 60000), 6) AS per_wall_minute, round(2.7e6 / ((analysis + scorer) / experiments), 3) AS projected_batches FROM g""",
)
def run_totals(spark, d):
    """Totals and rates of a run; empty denominators give 0 or null by field."""
    j = journal(spark, d).agg(F.count("*").alias("experiments"), F.count_if("accepted").alias("acceptances"), F.sum("k").alias("a"), F.sum("cost").alias("c"), ((F.max(F.unix_seconds(F.col("ts").cast("timestamp"))) - F.min(F.unix_seconds(F.col("ts").cast("timestamp")))) * 1000).alias("wall"))
    safe = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return j.select(
        "experiments", "acceptances", F.round(safe(F.col("a"), F.col("a") + F.col("c")), 6).alias("analysis_fraction"), F.round(safe(F.col("experiments"), F.col("c") / 60000), 4).alias("per_scorer_minute"),
        F.round(F.try_divide(F.col("experiments"), F.col("wall") / 60000), 6).alias("per_wall_minute"), F.round(safe(F.lit(2.7e6), (F.col("a") + F.col("c")) / F.col("experiments")), 3).alias("projected_batches"),
    )


@query("bursts", f"SELECT arm, count(DISTINCT user_id) AS roots, count(DISTINCT user_id * 1000 + k) AS mutation_points FROM ({JOURNAL}) GROUP BY 1")
def bursts(spark, d):
    """Distinct roots and mutation points."""
    return journal(spark, d).groupBy("arm").agg(F.count_distinct("user_id").alias("roots"), F.count_distinct(F.col("user_id") * 1000 + F.col("k")).alias("mutation_points"))


@query("latest_by_user", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_by_user(spark, d):
    """Upsert, the latest version of each key wins."""
    e = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("version"))
    return l.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "version").select("user_id", "event_id")


@query(
    "retired_axes",
    f"""WITH j AS (SELECT *, sum(CAST(accepted AS INT)) {OVER} AS era FROM ({JOURNAL})), m AS (SELECT user_id, max(era) AS now FROM j GROUP BY 1)
SELECT DISTINCT j.user_id, j.arm AS axis FROM j JOIN m ON m.user_id = j.user_id AND j.era = m.now""",
)
def retired_axes(spark, d):
    """Axes that failed since the last accept."""
    return l.retired_axes(journal(spark, d).withColumn("axis_failures", F.array("arm")), KEY, LINE)


@query(
    "roulette_draw",
    f"WITH r AS (SELECT user_id, event_id, sum(cost) OVER (PARTITION BY user_id ORDER BY event_id) AS run, sum(cost) OVER (PARTITION BY user_id) AS total FROM ({JOURNAL})) SELECT user_id, min(event_id) AS event_id FROM r WHERE run >= 0.5 * total GROUP BY 1",
)
def roulette_draw(spark, d):
    """The row at half of the cumulative weight."""
    return l.roulette(journal(spark, d), ["user_id"], "cost", 0.5, "event_id")


@query("split_budget", f"WITH u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS i, count(*) OVER () AS n FROM u) SELECT user_id, CAST(1000 // n + CASE WHEN i <= 1000 % n THEN 1 ELSE 0 END AS BIGINT) AS share FROM r")
def split_budget(spark, d):
    """A budget over focuses."""
    return l.split_budget(table(spark, d, "events").select("user_id").distinct(), F.col("user_id"), 1000)


@query("pooled_journals", "SELECT event_type AS arm, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM events")
def pooled_journals(spark, d):
    """Journals pooled with their ordinal, and labels united."""
    j = journal(spark, d)
    pooled = j.where("event_id % 2 = 0").withColumn("file", F.lit(0)).unionByName(j.where("event_id % 2 = 1").withColumn("file", F.lit(1)), allowMissingColumns=True)
    by = pooled.groupBy("arm").agg(F.count("*").alias("n"))
    return by.unionByName(pooled.agg(F.count("*").alias("n")).select(F.lit("all").alias("arm"), "n"))
