"""Column profiles and correlations (A1-A6, P19) and residual regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import finite

QUANTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)


def melt(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, column, value): one row for each cell, without a shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*(keys or []), F.explode(pairs).alias("cell")).select(*(keys or []), "cell.column", "cell.value")


def moment_columns(x: Column) -> dict[str, Column]:
    """[A1, A2] Moments of the finite values; skewness and excess kurtosis are of the
    population and 0 for constant columns."""
    v = F.when(finite(x), x)
    n = F.count(v)
    zero = F.lit(0.0)
    return {
        "count": n,
        "mean": F.coalesce(F.avg(v), zero),
        "variance": F.coalesce(F.var_pop(v), zero),
        "std_dev": F.coalesce(F.stddev_pop(v), zero),
        "min": F.coalesce(F.min(v), zero),
        "max": F.coalesce(F.max(v), zero),
        "zero_count": F.count_if(v == 0),
        "non_zero_count": F.count_if(v != 0),
        "non_finite_count": F.count_if(x.isNotNull() & ~finite(x)),
        "mean_abs": F.coalesce(F.avg(F.abs(v)), zero),
        "rms": F.coalesce(F.sqrt(F.avg(v * v)), zero),
        "skewness": F.coalesce(F.skewness(v), zero),
        "excess_kurtosis": F.coalesce(F.kurtosis(v), zero),
    }


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """[A1, A2, A9] One row of statistics for each column; partial sums meet in one shuffle."""
    return melt(df, columns).groupBy("column").agg(*[e.alias(n) for n, e in moment_columns(F.col("value")).items()])


def nearest_rank_quantiles(df: DataFrame, column: str, value: str, quantiles=QUANTILES) -> DataFrame:
    """[A3] Value at the rank round((n - 1) p), half away from zero, of the finite values.

    Ranks come from one window over (column, value); a column's rows are sorted by
    Spark's external sorter and never gathered in one array.
    """
    good = df.where(finite(F.col(value)))
    by = Window.partitionBy(column)
    ranked = good.select(column, F.col(value).alias("value"), (F.row_number().over(by.orderBy(value)) - 1).alias("rank"), F.count("*").over(by).alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("quantile"), F.round((F.col("n") - 1) * F.lit(float(p))).cast("long").alias("at")) for p in quantiles]))
    return ranked.select(column, "value", "rank", wanted.alias("w")).where(F.col("rank") == F.col("w.at")).select(column, F.col("w.quantile").alias("quantile"), "value")


def approximate_quantiles(df: DataFrame, column: str, value: str, quantiles=QUANTILES, accuracy: int = 10_000) -> DataFrame:
    """[A3] The same for very long columns, by the caller's choice: mergeable summaries, one shuffle."""
    v = F.when(finite(F.col(value)), F.col(value))
    found = df.groupBy(column).agg(F.percentile_approx(v, list(quantiles), accuracy).alias("q"))
    return found.select(column, F.posexplode("q").alias("i", "value")).select(column, F.array(*map(F.lit, quantiles))[F.col("i")].alias("quantile"), "value")


def pearson(x: Column, y: Column) -> Column:
    """[A4] From sums, clamped; 0 for one row or a constant side. Non-finite values poison it,
    as the sums see every row."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(F.when(both, 1)).cast("double")
    cov = n * F.sum(a * b) - F.sum(a) * F.sum(b)
    spread = F.sqrt(F.greatest(n * F.sum(a * a) - F.sum(a) * F.sum(a), F.lit(0.0))) * F.sqrt(F.greatest(n * F.sum(b * b) - F.sum(b) * F.sum(b), F.lit(0.0)))
    r = F.when((n <= 1) | (spread <= 2.220446049250313e-16), 0.0).otherwise(F.try_divide(cov, spread))
    return F.when(F.isnan(r), r).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def correlations(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """[A5] (left, right, r) for all pairs of two lists: one aggregate, one row, then unpivoted."""
    wide = df.agg(*[pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a in left for b in right])
    pairs = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{a}|{b}`").alias("r")) for a in left for b in right])
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def upper_triangle(df: DataFrame, columns: list[str]) -> DataFrame:
    """[A6] (i, j, r) for i <= j."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    wide = df.agg(*[pearson(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"r_{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"r_{i}_{j}").alias("r")) for i, j in pairs])
    return wide.select(F.explode(rows).alias("p")).select("p.*")


def array_target_correlation(df: DataFrame, array: str, target: str) -> DataFrame:
    """[A5] (position, r) of each element of an array column with a target, for wide corpora."""
    cells = df.select(F.posexplode(array).alias("position", "x"), F.col(target).cast("double").alias("y"))
    return cells.groupBy("position").agg(pearson(F.col("x").cast("double"), F.col("y")).alias("r"))


def residual_regression(df: DataFrame, source: str, x: str, residual: str, least_std: float = 1e-3) -> DataFrame:
    """[A10, A11] By source: correlation with the residual, slope cov/var, score and scale.

    A source that hardly varies and isn't an input scores 0 and has no slope.
    """
    a, e = F.col(x).cast("double"), F.col(residual).cast("double")
    n = F.count("*").cast("double")
    sums = df.groupBy(source).agg(n.alias("n"), F.sum(a).alias("sx"), F.sum(e).alias("se"), F.sum(a * a).alias("sxx"), F.sum(e * e).alias("see"), F.sum(a * e).alias("sxe"))
    var = F.greatest(F.col("sxx") / F.col("n") - F.pow(F.col("sx") / F.col("n"), 2), F.lit(0.0))
    std = F.greatest(F.sqrt(var), F.lit(least_std))
    spread = F.sqrt(F.greatest(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0)) * F.greatest(F.col("n") * F.col("see") - F.col("se") * F.col("se"), F.lit(0.0)))
    r = F.when(spread <= 2.220446049250313e-16, 0.0).otherwise(F.try_divide(F.col("n") * F.col("sxe") - F.col("sx") * F.col("se"), spread))
    var_n = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    slope = F.when(var_n > 1e-12, F.try_divide(F.col("sxe") - F.col("sx") * F.col("se") / F.col("n"), var_n))
    dead = (std <= least_std * 1.5) & ~F.col(source).cast("string").startswith("input-")
    return sums.select(source, "n", r.alias("direction"), F.when(dead, 0.0).otherwise(F.abs(r)).alias("score"), (F.lit(1e-3) / std).alias("weight_scale"), F.when(~dead, slope).alias("ols_weight"))


def activation_rank(df: DataFrame, source: str, x: str) -> DataFrame:
    """[A12] Sources by spread of their activation, s / (1 + s) * 0.05."""
    std = F.greatest(F.stddev_pop(F.col(x).cast("double")), F.lit(1e-3))
    found = df.groupBy(source).agg(std.alias("std"))
    return found.select(source, (F.col("std") / (F.col("std") + 1.0) * 0.05).alias("score"), (F.lit(1e-3) / F.col("std")).alias("weight_scale"))


def average_rank(value: str, group: list[str]) -> Column:
    """[W1] Ranks from 1; equal values share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*group).orderBy(value)) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / 2.0


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """[A34] Rank correlation by group; null under three points or for a constant side."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, average_rank(x, group).alias("rx"), average_rank(y, group).alias("ry"))
    n = F.count("*").cast("double")
    vx, vy = F.sum(F.col("rx") * F.col("rx")) - F.sum("rx") * F.sum("rx") / n, F.sum(F.col("ry") * F.col("ry")) - F.sum("ry") * F.sum("ry") / n
    cov = F.sum(F.col("rx") * F.col("ry")) - F.sum("rx") * F.sum("ry") / n
    rho = F.when((n >= 3) & (vx > 1e-9) & (vy > 1e-9), F.try_divide(cov, F.sqrt(vx * vy)))
    return ranked.groupBy(*group).agg(F.count("*").alias("n"), rho.alias("rho"))


def distinct_points(df: DataFrame, columns: list[str]) -> DataFrame:
    """[A35] Points that differ; -0.0 and 0.0 are one value here."""
    return df.dropDuplicates(columns)


def least_squares(df: DataFrame, phase: list[str], size: str, cost: str) -> DataFrame:
    """[A28] Cost of a call = fixed + marginal * size, by phase; null under two sizes."""
    x, y = F.col(size).cast("double"), F.col(cost).cast("double")
    found = df.groupBy(*phase).agg(
        F.count("*").alias("calls"),
        F.countDistinct(size).alias("distinct_sizes"),
        F.avg(x).alias("mean_creatures"),
        F.avg(y).alias("mean_ms"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.var_pop(y).alias("vy"),
    )
    enough = F.col("distinct_sizes") >= 2
    return found.select(
        *phase,
        "calls",
        "distinct_sizes",
        "mean_creatures",
        "mean_ms",
        F.when(enough, F.col("intercept")).alias("fixed_ms"),
        F.when(enough, F.col("slope")).alias("marginal_ms_per_creature"),
        F.when(enough & (F.col("vy") > 0), F.col("r2")).alias("r_squared"),
        F.when(enough & (F.col("mean_ms") > 0), F.col("intercept") / F.col("mean_ms")).alias("fixed_ms_share_at_mean"),
    )


def distribution(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """[A30] Count, extremes, linearly interpolated quartiles and mean."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = df.groupBy(*group).agg(F.count(v).alias("count"), F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"), F.avg(v).alias("mean"))
    return found.select(*group, "count", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "max", "mean")


def noise(df: DataFrame, group: list[str], value: str, within: Column | None = None) -> DataFrame:
    """[A31, A32] Spread of differences in a band: sample deviation, root mean square, greatest."""
    v = F.col(value)
    rows = df if within is None else df.where(within)
    enough = F.count(v) >= 2
    return rows.groupBy(*group).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.when(enough, F.stddev_samp(v)).alias("std_dev"), F.when(enough, F.sqrt(F.avg(v * v))).alias("rms"), F.when(enough, F.max(F.abs(v))).alias("max_abs")
    )


def robust_sigma(delta: Column) -> Column:
    """[A36] An aggregate: first quartile of magnitudes over its half-normal share; 0 under four."""
    bad = F.count_if(~finite(delta) | delta.isNull())
    quarter = F.percentile(F.abs(delta), F.lit(0.25)) / 0.3186393639643754
    return F.when((F.count("*") < 4) | (bad > 0), 0.0).otherwise(F.coalesce(quarter, F.lit(0.0)))
