"""Ordered folds over the journal: running best, decayed evidence, guardrails, allocation,
caches (W2-W5, W8-W14, W18, W19, J10, J11, J18, A37, A47, D2, D6-D8, G5-G11, K14, K17)."""

from __future__ import annotations

import bisect
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import reward_rate, tolerance_equal

RUNNING = (Window.unboundedPreceding, 0)


def ordered(journal: list[str], line: list[str]) -> Window:
    return Window.partitionBy(*journal).orderBy(*line)


def time_to_first_accept(df: DataFrame, journal: list[str], line: list[str]) -> DataFrame:
    """[W2] Elapsed ms up to and with the first accepted row of each journal."""
    w = ordered(journal, line)
    elapsed = df.withColumn("elapsed", F.sum(F.col("analysis_ms") + F.col("scorer_ms")).over(w.rowsBetween(*RUNNING)))
    return elapsed.groupBy(*journal).agg(F.min(F.when(F.col("accepted"), F.col("elapsed"))).alias("time_to_first_accept_ms"))


def opening_baseline(df: DataFrame, journal: list[str], line: list[str]) -> DataFrame:
    """[W3] The first baseline that isn't null."""
    key = F.struct(*line) if len(line) > 1 else F.col(line[0])
    return df.where(F.col("baseline").isNotNull()).groupBy(*journal).agg(F.min_by("baseline", key).alias("opening_baseline"))


def running_best(df: DataFrame, journal: list[str], line: list[str]) -> DataFrame:
    """[W4, W5] Baseline of the first accept with an improvement, plus the improvements so far."""
    w = ordered(journal, line).rowsBetween(*RUNNING)
    counts = F.col("accepted") & F.col("improvement").isNotNull()
    first = F.first(F.when(counts, F.col("baseline")), ignorenulls=True).over(w)
    gained = F.sum(F.when(counts, F.col("improvement"))).over(w)
    return df.withColumn("best", first + gained)


def header_as_of(df: DataFrame, journal: list[str], line: list[str], is_header: Column, value: Column) -> DataFrame:
    """[J18] The latest header at or above each line."""
    w = ordered(journal, line).rowsBetween(*RUNNING)
    return df.withColumn("header", F.last(F.when(is_header, value), ignorenulls=True).over(w))


def agreed(value: Column) -> Column:
    """[W18, A20] An aggregate: the value that all rows share, else null."""
    return F.when(F.count_distinct(value) == 1, F.min(value))


SUMS = ["trials", "promotions", "score_gain", "cost_ms"]


def decayed_evidence(df: DataFrame, journal: list[str], line: list[str], arm: str, decay: float = 0.9, retention: float = 0.25, experiment: list[str] | None = None) -> DataFrame:
    """[W8, A37] Evidence of each arm after the last experiment: every experiment decays what
    was before it, and one with an accept scales what is up to and with it.

    ``experiment`` names the columns, in the journal's order, that the rows of an experiment
    share; without it each row is one. The fold has a closed form: the weight of the rows of
    experiment i of N is decay^(N - i) times retention^(accepted experiments from i on).
    """
    experiment = experiment or line
    whole = Window.partitionBy(*journal)
    own = Window.partitionBy(*journal, *experiment)
    so_far = Window.partitionBy(*journal).orderBy(*experiment)  # with all rows of the same experiment
    rows = df.withColumn("_e", F.dense_rank().over(so_far)).withColumn("_won", F.max(F.col("accepted").cast("int")).over(own))
    once = F.when(F.row_number().over(own.orderBy(*line)) == 1, F.col("_won")).otherwise(0)
    rows = rows.withColumn("_once", once)
    later = F.sum("_once").over(whole) - F.sum("_once").over(so_far) + F.col("_won")
    rows = rows.withColumn("weight", F.pow(F.lit(decay), F.max("_e").over(whole) - F.col("_e")) * F.pow(F.lit(retention), later))
    sums = [F.sum(F.col("weight") * F.col(name)).alias(name) for name in SUMS]
    found = rows.groupBy(*journal, arm).agg(*sums, F.sum(F.col("weight") * F.col("accepted").cast("int")).alias("accepts"))
    return found.withColumn("value", reward_rate(F.col("score_gain"), F.col("promotions"), F.col("cost_ms")))


def experiment_weights(opens: np.ndarray, accepted: np.ndarray, decay: float, retention: float) -> tuple[np.ndarray, float]:
    """[W8] For rows in order, of which ``opens`` begin an experiment: the weight of each after
    the last one, and the factor of all that was before them."""
    number = np.cumsum(opens) - 1
    won = np.zeros(number[-1] + 1, bool)
    won[number[accepted]] = True
    later = np.cumsum(won[::-1])[::-1]
    weight = decay ** np.arange(len(won) - 1, -1, -1.0) * retention**later
    return weight[number], float(decay ** len(won) * retention ** int(won.sum()))


def weighed_by_arm(rows: pd.DataFrame, arm: str, experiment: list[str], decay: float, retention: float) -> tuple[pd.DataFrame, float]:
    """Sums by arm of rows in order, each by its weight, and the factor of what was before."""
    ids = rows[experiment].to_numpy()
    opens = np.append(True, (ids[1:] != ids[:-1]).any(axis=1))
    accepted = rows["accepted"].to_numpy(bool)
    weight, before = experiment_weights(opens, accepted, decay, retention)
    weighed = rows[SUMS].mul(weight, axis=0).assign(accepts=weight * accepted)
    return weighed.groupby(rows[arm].to_numpy(), sort=True).sum(), before


def fold_evidence(df: DataFrame, journal: list[str], line: list[str], arm: str, decay: float = 0.9, retention: float = 0.25, experiment: list[str] | None = None) -> DataFrame:
    """[W8] The same by journal in whole arrays; for streams see ``quarry.streaming``."""
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*journal, arm]) + ", trials double, promotions double, score_gain double, cost_ms double, accepts double"

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        found, _ = weighed_by_arm(rows.sort_values(line), arm, experiment or line, decay, retention)
        keys = rows[journal].iloc[0].tolist()
        return pd.DataFrame([[*keys, name, *values] for name, *values in found[[*SUMS, "accepts"]].itertuples()], columns=[*journal, arm, *SUMS, "accepts"])

    return df.groupBy(*journal).applyInPandas(fold, schema)


def ewma(df: DataFrame, key: list[str], order: list[str], value: str, alpha: float = 0.3) -> DataFrame:
    """[W9] a v + (1 - a) previous, seeded by the first value: a fold over each key's rows."""
    seen = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])
    folded = F.aggregate("seen", F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(x * alpha + a * (1 - alpha)))
    return df.groupBy(*key).agg(F.count("*").alias("n"), seen.alias("seen")).select(*key, "n", folded.alias("ewma"))


def rolling_guardrail(df: DataFrame, journal: list[str], line: list[str], saved: str, spent: str, window: int = 20, margin: float = 1000.0) -> DataFrame:
    """[W10] Net of the last ``window`` rows; the cache stands down at the first full window
    whose net is below -margin."""
    w = ordered(journal, line)
    net = F.sum(F.col(saved) - F.col(spent)).over(w.rowsBetween(-(window - 1), 0))
    rows = df.withColumn("net", net).withColumn("n", F.row_number().over(w))
    bad = (F.col("n") >= window) & (F.col("net") < -margin)
    first = F.min(F.when(bad, F.col("n"))).over(Window.partitionBy(*journal))
    return rows.withColumn("stood_down", F.coalesce(F.col("n") >= first, F.lit(False)))


def cache_value(df: DataFrame, journal: list[str], line: list[str]) -> DataFrame:
    """[A47] Skips valued at the mean cost of a creature known at that line, and cumulative net."""
    w = ordered(journal, line).rowsBetween(*RUNNING)
    mean = lambda ms, n: F.coalesce(F.try_divide(F.sum(ms).over(w), F.sum(n).over(w)), F.lit(0.0))
    screen, promote = mean("screen_ms", "screen_creatures"), mean("promote_ms", "promote_creatures")
    rows = df.withColumn("saved_ms", F.col("skipped") * screen + F.col("skipped_promoted") * promote)
    total = F.sum("skipped").over(w) * screen + F.sum("skipped_promoted").over(w) * promote
    return rows.withColumn("net_cumulative_ms", total - F.sum("spent_ms").over(w))


def slots(arms: DataFrame, budget: int, floor: float = 0.2) -> DataFrame:
    """[G5, W11, W12] Slots by arm: a reserve for the least tried, the rest by optimistic value.

    The reserve is the rounded share ``floor`` of the budget. Shares of the rest are rounded
    down and the leftover goes to the largest remainders; a value that isn't positive gets no
    share, and where none is, as in a pool without trials, the split is even. The table has
    one row an arm, a handful by definition, so its windows need no partition.
    """
    every = Window.partitionBy(F.lit(0))
    value = reward_rate(F.col("score_gain"), F.col("promotions"), F.col("cost_ms"))
    optimism = F.lit(1.0) / (F.avg("cost_ms").over(every) / 1000.0 + 10.0)
    bonus = F.lit(0.5) * optimism * F.sqrt(F.log(F.sum("trials").over(every) + 1.0) / F.greatest(F.col("trials"), F.lit(1.0)))
    reserve = min(int(min(floor, 1.0) * budget + 0.5), budget) if floor > 0 else 0
    rows = arms.withColumn("value", value).withColumn("index", value + bonus).withColumn("n", F.count("*").over(every))
    rows = rows.withColumn("clean", F.when((F.col("index") > 0) & ~F.isnan("index") & (F.col("index") < float("inf")), F.col("index")).otherwise(0.0))
    coldest = F.row_number().over(every.orderBy("trials", "arm"))
    rows = rows.withColumn("reserved", F.floor(F.lit(reserve) / F.col("n")) + F.when(coldest <= F.lit(reserve) % F.col("n"), 1).otherwise(0))
    left, total = F.lit(budget - reserve), F.sum("clean").over(every)
    rows = rows.withColumn("share", F.when(total > 0, left * F.try_divide(F.col("clean"), total)).otherwise(left * (F.lit(1.0) / F.col("n"))))
    rows = rows.withColumn("fraction", F.col("share") - F.floor("share")).withColumn("share", F.floor("share"))
    spare = left - F.sum("share").over(every)
    rank = F.row_number().over(every.orderBy(F.desc("fraction"), "arm"))
    return rows.select("arm", "value", (F.col("reserved") + F.col("share") + F.when(rank <= spare, 1).otherwise(0)).cast("long").alias("slots"))


def split_budget(df: DataFrame, order: Column, budget: int) -> DataFrame:
    """[K17] The budget over focuses: equal shares, the first ones one more."""
    every = Window.partitionBy(F.lit(0))
    n, rank = F.count("*").over(every), F.row_number().over(every.orderBy(order))
    return df.withColumn("share", (F.floor(F.lit(budget) / n) + F.when(rank <= F.lit(budget) % n, 1).otherwise(0)).cast("long"))


def merge_priors(measured: DataFrame, priors: DataFrame, confidence: float, most_trials: float = 25.0) -> DataFrame:
    """[G7] Prior evidence scaled by confidence and capped in trials, added to the measured,
    with the share of trials that is prior."""
    names = ["trials", "promotions", "accepts", "score_gain", "cost_ms"]
    cap = F.least(F.lit(1.0), F.try_divide(F.lit(most_trials), F.col("trials") * confidence)) * confidence
    scaled = priors.select("arm", *[(F.col(n) * F.coalesce(cap, F.lit(confidence))).alias(f"p_{n}") for n in names])
    both = measured.join(scaled, "arm", "full_outer")
    summed = [(F.coalesce(n, F.lit(0.0)) + F.coalesce(f"p_{n}", F.lit(0.0))).alias(n) for n in names]
    return both.select("arm", *summed, F.coalesce(F.try_divide(F.coalesce("p_trials", F.lit(0.0)), F.coalesce("trials", F.lit(0.0)) + F.coalesce("p_trials", F.lit(0.0))), F.lit(0.0)).alias("prior_share"))


def tolerance_band(value: Column) -> Column:
    """[P6] A band such that values within tolerance of each other are in the same or in
    adjacent bands: as wide as twice the tolerance, linear near 0 and logarithmic beyond."""
    size = F.abs(value)
    scale = F.when(size <= 1e-3, size * 1e9).otherwise((F.log(size / 1e-3) + 1) * 1e6)
    odd = value.isNull() | F.isnan(value) | (size == float("inf"))
    return F.when(odd, F.lit(1 << 40)).otherwise(F.floor(F.signum(value) * scale / 2))


def cache_misses(probes: DataFrame, cache: DataFrame, bucket: list[str], value: str, now: int | None = None, max_age: int = 604_800) -> DataFrame:
    """[J10, P18, G9] Probes that no live cache entry of their bucket matches within tolerance;
    no value matches no value.

    An anti join on the bucket and the band of the value, each entry standing in its band
    and both adjacent ones, with the tolerance as a residual on what shares a band.
    """
    live = cache if now is None or max_age == 0 else cache.where(F.greatest(F.lit(now) - F.col("inserted"), F.lit(0)) < max_age)
    band = tolerance_band(F.col(value))
    c = live.select(*bucket, F.col(value), F.explode(F.array(band - 1, band, band + 1)).alias("_band")).alias("c")
    p = probes.withColumn("_band", tolerance_band(F.col(value))).alias("p")
    same = [F.col(f"p.{b}") == F.col(f"c.{b}") for b in [*bucket, "_band"]]
    close = (F.col(f"p.{value}").isNull() & F.col(f"c.{value}").isNull()) | tolerance_equal(F.col(f"p.{value}"), F.col(f"c.{value}"))
    return p.join(c, reduce(lambda x, y: x & y, [*same, close]), "left_anti").drop("_band")


def first_of_near(df: DataFrame, bucket: list[str], order: list[str], value: str) -> DataFrame:
    """[J11] Rows in order, less those within tolerance of a row that was kept before them.

    Tolerance isn't transitive, so this is a fold over a bucket, one incumbent's proposals
    for one neuron, which a batch bounds. What was kept is held in order: if any of it is
    within tolerance, so is the next below or above."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[float] = []
        keep = []
        rows = rows.sort_values(order)
        for v in rows[value].astype(float).tolist():
            at = bisect.bisect_left(kept, v)
            near = any(abs(v - k) <= max(1e-9, 1e-6 * max(abs(v), abs(k))) for k in kept[max(at - 1, 0) : at + 1])
            keep.append(not near)
            if not near and v == v:
                kept.insert(at, v)
        return rows[keep]

    return df.groupBy(*bucket).applyInPandas(fold, df.schema)


def evict(cache: DataFrame, now: int, max_age: int, most: int, scope: list[str]) -> DataFrame:
    """[W19, P18, G8] Live entries, of each scope the ``most`` latest inserted."""
    live = cache.where(F.greatest(F.lit(now) - F.col("inserted"), F.lit(0)) < max_age) if max_age else cache
    latest = Window.partitionBy(*scope).orderBy(F.desc("inserted"), F.desc("seq"))
    return live.withColumn("age_rank", F.row_number().over(latest)).where(F.col("age_rank") <= most).drop("age_rank")


def rebuild_cache(candidates: DataFrame) -> DataFrame:
    """[G10] Entries from the journal: scored candidates of experiments that weren't accepted
    and didn't fail, less the winner, one for each fingerprint, the first."""
    failed = candidates.where(~F.col("accepted") & F.col("scorer_error").isNull() & F.col("scored") & ~F.coalesce(F.col("is_winner"), F.lit(False)))
    key = ["incumbent", "strategy", "focus", "mutation", "new_value"]
    return failed.groupBy(*key).agg(F.min("timestamp").alias("inserted"), F.min("line").alias("seq"), F.max("promoted").alias("promoted"))


def fingerprints(edges: DataFrame, batch: list[str]) -> DataFrame:
    """[D2] A hash of each candidate's sorted edges; equal ones are structural duplicates."""
    edge = F.struct("from_id", "to_id", "weight")
    return edges.groupBy(*batch).agg(F.xxhash64(F.to_json(F.array_sort(F.collect_list(edge)))).alias("fingerprint"))


def upsert(store: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """[D6] The latest version of each key."""
    both = store.unionByName(changes, allowMissingColumns=True)
    latest = Window.partitionBy(key).orderBy(F.desc(version))
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def retired_axes(df: DataFrame, journal: list[str], line: list[str]) -> DataFrame:
    """[D8] Axes that failed since the last accept: accepts start a new set."""
    w = ordered(journal, line)
    era = df.withColumn("era", F.sum(F.col("accepted").cast("int")).over(w.rowsBetween(*RUNNING)))
    last = era.withColumn("now", F.max("era").over(Window.partitionBy(*journal)))
    return last.where(F.col("era") == F.col("now")).select(*journal, F.explode("axis_failures").alias("axis")).distinct()


def roulette(df: DataFrame, group: list[str], weight: str, draw: float, order: str) -> DataFrame:
    """[W13] The first row whose running weight reaches ``draw`` of the total."""
    w = Window.partitionBy(*group)
    run = F.sum(weight).over(w.orderBy(order).rowsBetween(*RUNNING))
    reached = df.withColumn("run", run).withColumn("total", F.sum(weight).over(w)).where(F.col("run") >= F.col("total") * draw)
    return reached.groupBy(*group).agg(F.min(order).alias(order))  # not the least run: weights may be 0 or less


def race_order(weight: Column, seed: int, *keys: str) -> Column:
    """[W14] Exponential race: -ln(u) / w with u hashed from the keys, so any partitioning agrees."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return -F.log(u) / F.greatest(weight, F.lit(1e-4))
