"""Paired experiments: pairing, bootstrap, verdicts, strata, landscapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import axis_shape, stratum

#: Resamples of a cell that one row draws.
RESAMPLES = 16


def pair_arms(runs: DataFrame, cell: list[str], seed: str, metric: str, treatment: str, control: str) -> DataFrame:
    """[J6, J7] One row a cell and seed: both arms' first value; failures where either lacks one."""
    value = lambda arm: F.min_by(metric, F.when(F.col("arm") == arm, F.coalesce(F.col("line"), F.lit(0))))
    error = F.bool_or(F.col("arm").isin(treatment, control) & F.col("error").isNotNull())
    both = runs.groupBy(*cell, seed).agg(value(treatment).alias("treatment"), value(control).alias("control"), F.coalesce(error, F.lit(False)).alias("errored"))
    failed = F.col("errored") | F.col("treatment").isNull() | F.col("control").isNull()
    return both.select(*cell, seed, failed.alias("failed"), F.when(~failed, F.col("treatment") - F.col("control")).alias("difference"))


def reference_pairs(runs: DataFrame, reference: DataFrame, cell: list[str], seed: str, metric: str) -> DataFrame:
    """[J9] Runs beside those of a reference arm with the same cell and seed: (cell, seed, own,
    reference, difference). Runs without a counterpart on either side drop out."""
    key = [*cell, seed]
    theirs = reference.select(*key, F.col(metric).alias("reference"))
    both = runs.select(*key, F.col(metric).alias("own")).join(theirs, key)
    return both.withColumn("difference", F.col("own") - F.col("reference"))


def paired_summary(pairs: DataFrame, cell: list[str]) -> DataFrame:
    """[A38] Mean, exact median, wins (below 0), losses, ties and failures."""
    d = F.col("difference")
    return pairs.groupBy(*cell).agg(
        F.count(d).alias("pairs"), F.avg(d).alias("mean"), F.median(d).alias("median"), F.count_if(d < 0).alias("wins"), F.count_if(d > 0).alias("losses"), F.count_if(d == 0).alias("ties"), F.count_if("failed").alias("failures")
    )


def bootstrap_interval(pairs: DataFrame, cell: list[str], resamples: int = 2000, seed: int = 1, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """[A39] Percentile interval of the mean, nearest rank.

    Draw k of resample b is the row numbered by a hash of (seed, cell, b, k), so the draws
    are the same under any partitioning. Each row of a block of resamples holds its cell's
    sorted differences, 8 bytes each, and draws are summed one by one: nothing is as large as
    the draws.
    """
    known = pairs.where(F.col("difference").isNotNull()).groupBy(*cell).agg(F.sort_array(F.collect_list(F.col("difference").cast("double"))).alias("sorted"))
    n = F.size("sorted")
    blocks = known.withColumn("first", F.explode(F.sequence(F.lit(1), F.lit(resamples), F.lit(RESAMPLES))))
    blocks = blocks.repartition(-(-resamples // RESAMPLES), *cell, "first")

    def mean(b: Column) -> Column:
        draw = lambda k: F.get("sorted", F.pmod(F.xxhash64(F.lit(seed), *cell, b, k), n.cast("long")).cast("int"))
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda total, k: total + draw(k)) / n

    own = F.sequence("first", F.least(F.col("first") + RESAMPLES - 1, F.lit(resamples)))
    means = blocks.select(*cell, F.explode(F.transform(own, mean)).alias("mean"))
    by = Window.partitionBy(*cell)
    ranked = means.withColumn("rank", F.row_number().over(by.orderBy("mean")) - 1)
    at = lambda q: F.max(F.when(F.col("rank") == round(q * (resamples - 1)), F.col("mean")))
    return ranked.groupBy(*cell).agg(at(low).alias("ci_low"), at(high).alias("ci_high"))


def verdict(ci_low: Column, ci_high: Column, pairs: Column, least: int = 3, guards: tuple[Column, ...] = ()) -> Column:
    """[G22] By the sign of the interval; too few pairs decide nothing.

    ``guards`` are mean differences on held-out rows, the full corpus or rare strata: one
    that is worse, or wasn't measured, keeps a better interval inconclusive.
    """
    safe = reduce(lambda x, g: x & F.coalesce(g <= 0, F.lit(False)), guards, F.lit(True))
    return F.when((pairs < least) | ci_low.isNull(), "insufficient").when((ci_high < 0) & safe, "better").when(ci_low > 0, "worse").otherwise("inconclusive")


def overall(verdicts: DataFrame) -> DataFrame:
    """[G22] The predeclared rule: positive if some cell is better and none worse."""
    better, worse = F.count_if(F.col("verdict") == "better"), F.count_if(F.col("verdict") == "worse")
    return verdicts.agg(better.alias("better"), worse.alias("worse"), F.count_if(F.col("verdict") == "inconclusive").alias("inconclusive"), F.when((better > 0) & (worse == 0), "positive").when(worse > 0, "negative").otherwise("null").alias("overall"))


def arm_means(runs: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """[A40] Means that skip nulls."""
    return runs.groupBy(*group).agg(F.count("*").alias("runs"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def stratum_means(runs: DataFrame, group: list[str], array: str) -> DataFrame:
    """[A40, A43] Means of a per-stratum array, by position."""
    return runs.select(*group, F.posexplode(array).alias("stratum", "value")).groupBy(*group, "stratum").agg(F.avg("value").alias("mean"))


def strata(df: DataFrame, value: str, bins: int) -> DataFrame:
    """[P22] Equal-width bins over the column's range, which is one broadcast row."""
    finite = F.when(~F.isnan(value), F.col(value))
    edges = df.agg(F.min(finite).alias("low"), F.max(finite).alias("high"))
    return df.crossJoin(F.broadcast(edges)).withColumn("stratum", stratum(F.col(value), F.col("low"), F.col("high"), bins)).drop("low", "high")


def rare_strata(df: DataFrame, error: str, rare_share: float) -> DataFrame:
    """[A43] By stratum: share, mean squared error, and whether it is rare."""
    found = df.groupBy("stratum").agg(F.count("*").alias("n"), F.avg(F.col(error) * F.col(error)).alias("mse"))
    total = found.agg(F.sum("n").alias("total"))
    return found.crossJoin(F.broadcast(total)).select("stratum", "n", "mse", (F.col("n") / F.col("total") < rare_share).alias("rare"))


def easy_skip(df: DataFrame, record: str, difficulty: str, reduction: float, revisit_share: float = 0.1, seed: int = 1) -> DataFrame:
    """[K15] Which records an epoch keeps: protected ones, the hardest, and a drawn few of the rest."""
    total = df.agg(F.count("*").alias("all"), F.count_if("protected").alias("guarded"))
    rows = df.crossJoin(F.broadcast(total))
    slots = F.greatest(F.col("all") - F.round(F.col("all") * reduction) - F.col("guarded"), F.lit(0))
    revisit = F.least(F.round(slots * revisit_share), slots)
    open_rows = Window.partitionBy("protected")
    rank = F.row_number().over(open_rows.orderBy(F.desc(difficulty), record))
    rows = rows.withColumn("slots", slots).withColumn("revisit", revisit).withColumn("rank", rank)
    rows = rows.withColumn("hard", ~F.col("protected") & (F.col("rank") <= F.col("slots") - F.col("revisit")))
    draw = F.row_number().over(Window.partitionBy("protected", "hard").orderBy(F.xxhash64(F.lit(seed), record), record))
    drawn = ~F.col("protected") & ~F.col("hard") & (draw <= F.col("revisit"))
    return rows.withColumn("drawn", drawn).withColumn("keep", F.col("protected") | F.col("hard") | F.col("drawn")).drop("all", "guarded", "slots", "revisit", "rank")


def axis_shapes(losses: DataFrame) -> DataFrame:
    """[P23] Shape of each axis from its five losses."""
    return losses.withColumn("shape", axis_shape(F.col("base"), F.col("plus"), F.col("minus"), F.col("plus_half"), F.col("minus_half")))


def landscape_cells(rows: DataFrame, cell: list[str]) -> DataFrame:
    """[A42] Totals of shapes by cell."""
    shapes = ["flat", "edge", "kinked", "smooth", "indeterminate"]
    return rows.groupBy(*cell).agg(F.count("*").alias("runs"), *[F.sum(s).alias(s) for s in shapes], F.count_if(F.col("error").isNotNull()).alias("failures"))


def influential_axes(changes: DataFrame, group: list[str], d: int) -> DataFrame:
    """[K10, A48] The d axes of greatest change, ties by index, back in index order."""
    best = Window.partitionBy(*group).orderBy(F.desc("change"), "axis")
    kept = changes.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= d)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("axis"))).drop("rank")


def plateau_axes(changes: DataFrame, group: list[str]) -> DataFrame:
    """[A48] How many axes change nothing."""
    return changes.groupBy(*group).agg(F.count_if(F.col("change") == 0).alias("plateau_axes"), F.count("*").alias("axes"))
