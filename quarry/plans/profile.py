"""Queries over column statistics, regressions and models (WL1, WL2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scalars as s
from quarry.operators import profile as p
from quarry.plans.registry import query
from quarry.plans.tables import EXPERIMENTS, experiments
from quarry.session import table

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MELTED = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM lineitem" for c in COLUMNS)


def rounded(df, digits=6, keep=()):
    """Doubles to a number of digits, for comparison with another engine's sums."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query(
    "profile_lineitem",
    f"""
WITH m AS ({MELTED}), a AS (SELECT "column", avg(value) AS mu FROM m GROUP BY 1),
c AS (SELECT m."column", value, value - mu AS d FROM m JOIN a USING ("column")),
g AS (SELECT "column", count(*) AS n, avg(value) AS mean, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4, min(value) AS lo, max(value) AS hi,
  count(*) FILTER (value = 0) AS z, count(*) FILTER (value <> 0) AS nz, avg(abs(value)) AS ma, sqrt(avg(value * value)) AS rms FROM c GROUP BY 1)
SELECT "column", n AS count, round(mean, 4) AS mean, round(m2, 2) AS variance, round(sqrt(m2), 4) AS std_dev, round(lo, 6) AS min, round(hi, 6) AS max, z AS zero_count, nz AS non_zero_count,
  CAST(0 AS BIGINT) AS non_finite_count, round(ma, 4) AS mean_abs, round(rms, 4) AS rms, round(m3 / (m2 * sqrt(m2)), 4) AS skewness, round(m4 / (m2 * m2) - 3, 4) AS excess_kurtosis FROM g""",
)
def profile_lineitem(spark, d):
    """Moments of the numeric columns."""
    found = p.profile(table(spark, d, "lineitem"), COLUMNS)
    found = found.withColumns({c: F.round(c, 4) for c in ("mean", "mean_abs", "std_dev", "rms", "skewness", "excess_kurtosis")}).withColumn("variance", F.round("variance", 2))
    return rounded(found)


@query(
    "quantiles_nearest_rank",
    f"""
WITH m AS ({MELTED}), r AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS rk, count(*) OVER (PARTITION BY "column") AS n FROM m)
SELECT "column", CAST(q AS DOUBLE) AS quantile, value FROM r, (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q) t WHERE rk = CAST(round((n - 1) * CAST(q AS DOUBLE)) AS BIGINT)""",
)
def quantiles_nearest_rank(spark, d):
    """A3: exact nearest-rank quantiles."""
    return p.nearest_rank_quantiles(p.melt(table(spark, d, "lineitem"), COLUMNS), "column", "value")


def _corr_sql(x, y):
    cov = f"(count(*) * sum({x} * {y}) - sum({x}) * sum({y}))"
    return f"{cov} / (sqrt(count(*) * sum({x} * {x}) - sum({x}) * sum({x})) * sqrt(count(*) * sum({y} * {y}) - sum({y}) * sum({y})))"


@query("corr_matrix", " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round({_corr_sql(COLUMNS[i], COLUMNS[j])}, 6) AS r FROM lineitem" for i in range(4) for j in range(i, 4)))
def corr_matrix(spark, d):
    """Upper triangle of correlations in one aggregate."""
    return rounded(p.upper_triangle(table(spark, d, "lineitem"), COLUMNS))


@query("corr_input_target", " UNION ALL ".join(f"SELECT '{a}' AS \"left\", 'l_extendedprice' AS \"right\", round({_corr_sql(a, 'l_extendedprice')}, 6) AS r FROM lineitem" for a in ("l_quantity", "l_discount", "l_tax")))
def corr_input_target(spark, d):
    """A5: inputs against a target."""
    return rounded(p.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_extendedprice"]))


CELLS = "SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings"


@query("embedding_target_corr", f"WITH c AS (SELECT position, CAST(x AS DOUBLE) AS x, CAST(label AS DOUBLE) AS y FROM ({CELLS})) SELECT CAST(position AS INTEGER) AS position, round({_corr_sql('x', 'y')}, 6) AS r FROM c GROUP BY 1")
def embedding_target_corr(spark, d):
    """A5 for wide corpora, by position."""
    return rounded(p.array_target_correlation(table(spark, d, "embeddings"), "embedding", "label"))


@query(
    "covariance_derived",
    f"SELECT 'l_quantity' AS \"left\", 'l_extendedprice' AS \"right\", round({_corr_sql('l_quantity', 'l_extendedprice')} * stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 2) AS covariance FROM lineitem",
)
def covariance_derived(spark, d):
    """Covariance from correlation and deviations."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    found = table(spark, d, "lineitem").agg(p.pearson(x, y).alias("r"), F.stddev_pop(x).alias("a"), F.stddev_pop(y).alias("b"))
    return found.select(F.lit("l_quantity").alias("left"), F.lit("l_extendedprice").alias("right"), F.round(s.covariance(F.col("r"), F.col("a"), F.col("b")), 2).alias("covariance"))


@query(
    "linear_mse",
    f"""WITH m AS (SELECT unnest([1, 2, 3]) AS model), v AS (SELECT vec_id, label, sum(x * (position % 7)) AS s FROM ({CELLS}) GROUP BY 1, 2)
SELECT CAST(model AS INTEGER) AS model, count(*) AS records, round(avg(pow(label - s * model / 10.0, 2)), 4) AS mse FROM v, m GROUP BY 1""",
)
def linear_mse(spark, d):
    """A few models scored on every record; the models travel, records don't move."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % 7).cast("double"))
    dot = F.aggregate(F.zip_with(F.col("embedding"), weights, lambda a, w: a.cast("double") * w), F.lit(0.0), lambda a, x: a + x)
    rows = table(spark, d, "embeddings").select("label", dot.alias("s")).select("label", "s", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("model"))
    return rows.groupBy("model").agg(F.count("*").alias("records"), F.round(F.avg(F.pow(F.col("label") - F.col("s") * F.col("model") / 10.0, F.lit(2))), 4).alias("mse"))


@query(
    "residual_ols_rank",
    f"""WITH c AS (SELECT 'input-' || position AS source, CAST(x AS DOUBLE) AS x, CAST(label AS DOUBLE) - 4.5 AS e FROM ({CELLS})),
g AS (SELECT source, {_corr_sql('x', 'e')} AS r, (sum(x * e) - sum(x) * sum(e) / count(*)) / (sum(x * x) - sum(x) * sum(x) / count(*)) AS slope FROM c GROUP BY 1)
SELECT source, round(r, 6) AS direction, round(abs(r), 6) AS score, round(slope, 6) AS ols_weight FROM g""",
)
def residual_ols_rank(spark, d):
    """Sources by correlation of their activation with the residual."""
    cells = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("position", "x"), (F.col("label").cast("double") - 4.5).alias("e"))
    cells = cells.withColumn("source", F.concat(F.lit("input-"), F.col("position").cast("string")))
    return rounded(p.residual_regression(cells, "source", "x", "e").select("source", "direction", "score", "ols_weight"))


@query(
    "activation_rank",
    f"""WITH g AS (SELECT 'input-' || position AS source, greatest(stddev_pop(CAST(x AS DOUBLE)), 0.001) AS sd FROM ({CELLS}) GROUP BY 1)
SELECT source, round(sd / (1 + sd) * 0.05, 6) AS score, round(0.001 / sd, 6) AS weight_scale FROM g""",
)
def activation_rank(spark, d):
    """Sources by spread of activation."""
    cells = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("position", "x")).withColumn("source", F.concat(F.lit("input-"), F.col("position").cast("string")))
    return rounded(p.activation_rank(cells, "source", "x"))


SQUASH = "CASE l_linenumber % 4 WHEN 0 THEN 'TANH' WHEN 1 THEN 'LOGISTIC' WHEN 2 THEN 'RELU' ELSE 'HARD_TANH' END"


@query(
    "activation_statistics",
    f"""WITH a AS (SELECT {SQUASH} AS squash, (l_quantity - 25) / 10.0 AS pre, l_tax FROM lineitem),
b AS (SELECT *, CASE squash WHEN 'TANH' THEN (exp(pre) - exp(-pre)) / (exp(pre) + exp(-pre)) WHEN 'LOGISTIC' THEN 1 / (1 + exp(-pre)) WHEN 'RELU' THEN greatest(pre, 0) ELSE greatest(-1, least(1, pre)) END AS post FROM a),
c AS (SELECT *, CASE squash WHEN 'TANH' THEN greatest(1 - post * post, 0) WHEN 'LOGISTIC' THEN greatest(post * (1 - post), 0) WHEN 'RELU' THEN CASE WHEN post > 0 THEN 1 ELSE 0 END ELSE CASE WHEN abs(post) < 1 - 1e-6 THEN 1 ELSE 0 END END AS slope,
 CASE squash WHEN 'TANH' THEN abs(post) > 0.99 WHEN 'LOGISTIC' THEN NOT (post BETWEEN 0.01 AND 0.99) WHEN 'RELU' THEN post <= 0 ELSE abs(post) >= 1 - 1e-6 END AS sat FROM b)
SELECT squash, count(*) AS records, round(avg(pre), 6) AS pre_mean, round(var_pop(pre), 6) AS pre_variance, round(avg(post), 6) AS post_mean, round(avg(CASE WHEN sat THEN 1.0 ELSE 0 END), 6) AS saturation_fraction,
 round(avg(CASE WHEN abs(post) < 1e-6 THEN 1.0 ELSE 0 END), 6) AS near_zero_fraction, round(avg(l_tax - post), 6) AS mean_error, round(avg(abs(l_tax - post)), 6) AS mean_abs_error, round(avg((l_tax - post) * slope), 6) AS mean_adjusted_error, round(avg(slope), 6) AS mean_derivative FROM c GROUP BY 1""",
)
def activation_statistics(spark, d):
    """Focus statistics in one aggregate with conditional sums."""
    kind = F.col("l_linenumber") % 4
    squash = F.when(kind == 0, "TANH").when(kind == 1, "LOGISTIC").when(kind == 2, "RELU").otherwise("HARD_TANH")
    rows = table(spark, d, "lineitem").select(squash.alias("squash"), ((F.col("l_quantity") - 25) / 10.0).alias("pre"), "l_tax")
    rows = rows.withColumn("post", s.activation(F.col("squash"), F.col("pre"))).withColumn("slope", s.squash_derivative(F.col("squash"), F.col("post")))
    error = s.local_residual(F.lit(True), F.col("l_tax"), F.col("post"))
    share = lambda c: F.avg(c.cast("double"))
    return rounded(
        rows.groupBy("squash").agg(
            F.count("*").alias("records"), F.avg("pre").alias("pre_mean"), F.var_pop("pre").alias("pre_variance"), F.avg("post").alias("post_mean"), share(s.saturated(F.col("squash"), F.col("post"))).alias("saturation_fraction"),
            share(s.near_zero(F.col("post"))).alias("near_zero_fraction"), F.avg(error).alias("mean_error"), F.avg(F.abs(error)).alias("mean_abs_error"), F.avg(error * F.col("slope")).alias("mean_adjusted_error"), F.avg("slope").alias("mean_derivative"),
        )
    )


@query(
    "call_cost_fit",
    """WITH c AS (SELECT o_orderpriority AS phase, count(*) AS creatures, any_value(o_totalprice) AS ms FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority)
SELECT phase, count(*) AS calls, count(DISTINCT creatures) AS distinct_sizes, round(avg(creatures), 6) AS mean_creatures, round(avg(ms), 4) AS mean_ms, round(regr_intercept(ms, creatures), 4) AS fixed_ms, round(regr_slope(ms, creatures), 4) AS marginal_ms_per_creature,
 round(regr_r2(ms, creatures), 6) AS r_squared, round(regr_intercept(ms, creatures) / avg(ms), 6) AS fixed_ms_share_at_mean FROM c GROUP BY 1""",
)
def call_cost_fit(spark, d):
    """Fixed and marginal cost of a call by phase."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("creatures"))
    calls = table(spark, d, "orders").join(lines, "o_orderkey")
    found = p.least_squares(calls.withColumnRenamed("o_orderpriority", "phase"), ["phase"], "creatures", "o_totalprice")
    return rounded(found.withColumns({c: F.round(c, 4) for c in ("mean_ms", "fixed_ms", "marginal_ms_per_creature")}))


@query(
    "spearman_by_flag",
    """WITH r AS (SELECT l_returnflag AS strategy, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
SELECT strategy, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""",
)
def spearman_by_flag(spark, d):
    """Rank correlation by strategy."""
    return rounded(p.spearman(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "strategy"), ["strategy"], "l_quantity", "l_extendedprice"))


@query("distinct_points", "SELECT l_returnflag AS strategy, count(*) AS points FROM (SELECT DISTINCT l_returnflag, l_quantity, l_discount FROM lineitem) GROUP BY 1")
def distinct_points(spark, d):
    """Points that differ."""
    points = p.distinct_points(table(spark, d, "lineitem"), ["l_returnflag", "l_quantity", "l_discount"])
    return points.groupBy(F.col("l_returnflag").alias("strategy")).agg(F.count("*").alias("points"))


@query("prefix_sample", f"WITH e AS ({EXPERIMENTS}), r AS (SELECT *, row_number() OVER (ORDER BY experiment, rn) - 1 AS record_id FROM e) SELECT count(*) AS records, round(avg(score), 4) AS mean_score FROM r WHERE record_id < 2500")
def prefix_sample(spark, d):
    """The first N records in order, as a top-N and not as an arbitrary limit."""
    return experiments(spark, d).orderBy("experiment", "rn").limit(2500).agg(F.count("*").alias("records"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("stratified_phase_sample", "SELECT (event_id // 1) % 20 AS phase, count(*) AS records, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def stratified_phase_sample(spark, d):
    """Systematic samples at rate 1/20, one for each phase."""
    return table(spark, d, "events").groupBy(F.pmod("event_id", F.lit(20)).alias("phase")).agg(F.count("*").alias("records"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("chunk_partials", "SELECT event_id // 2048 AS chunk_id, count(*) AS records, round(sum(value), 4) AS total, round(sum(value * value), 2) AS squares FROM events GROUP BY 1")
def chunk_partials(spark, d):
    """Partial sums by chunk of 2,048 records, which merge in chunk order."""
    return table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 2048).alias("chunk_id")).agg(F.count("*").alias("records"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.col("value") * F.col("value")), 2).alias("squares"))


@query("unit_scaled_inputs", "WITH g AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT unnest(embedding) AS x FROM embeddings)) SELECT lo >= -1.05 AND hi <= 1.05 AS unit_scaled FROM g")
def unit_scaled_inputs(spark, d):
    """Whether all inputs lie in the unit range."""
    cells = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("position", "x"))
    by = cells.groupBy("position").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n"))
    return by.agg(s.unit_scaled(F.col("low"), F.col("high"), F.col("n")).alias("unit_scaled"))


@query(
    "scalar_budgets",
    """SELECT c_custkey, CAST(least(greatest(round(sqrt(c_custkey) * 2.5), 4), 60) AS BIGINT) AS budget,
 round(greatest(1e-6, least(1e-3, greatest(1e-6, least(2.0, abs(c_acctbal / 1000))) * log2(greatest(c_custkey, 2)) * (1.1920928955078125e-07 * 64))), 9) AS epsilon,
 round(CASE WHEN c_custkey % 200 > 168 THEN 0 ELSE pow(0.5, (c_custkey % 200) / 24.0) END * 0.5, 6) AS confidence,
 round(greatest(c_acctbal / 1000, 0) * 0 + (greatest(c_acctbal, 0) + 0.05 * (c_custkey % 7)) / (c_custkey / 1000.0 + 10), 6) AS value FROM customer""",
)
def scalar_budgets(spark, d):
    """Scalar functions: budgets, drift, confidence, value."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    return c.select(
        "c_custkey", s.sublinear_budget(4, key, 2.5, 60).alias("budget"), F.round(s.drift_epsilon(key, F.col("c_acctbal") / 1000), 9).alias("epsilon"),
        F.round(s.prior_confidence(key % 200, F.lit(0.5), F.lit(1.0)), 6).alias("confidence"), F.round(s.reward_rate(F.col("c_acctbal"), key % 7, key, 1.0), 6).alias("value"),
    )


@query("rule_deltas", "SELECT l_returnflag AS strategy, round(avg(0.3 * l_quantity - 0.2 * l_discount * l_tax + 0.1 * l_extendedprice * l_discount * l_discount), 4) AS mean_delta FROM lineitem GROUP BY 1")
def rule_deltas(spark, d):
    """P20: a sparse linear rule over edge features."""
    delta = s.rule_delta({"x": 0.3, "yr": -0.2, "wyy": 0.1}, F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice"), F.col("l_tax"))
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("strategy")).agg(F.round(F.avg(delta), 4).alias("mean_delta"))


@query(
    "proposal_weights",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN greatest(-0.08, least(0.08, (p_retailprice - 1000) / 100 * 0.05)) ELSE
 (CASE WHEN abs((p_size - 25) / 25.0) > 1e-3 THEN sign((p_size - 25) / 25.0) ELSE 1 END) * greatest(1e-5, least(0.08, p_retailprice / 50000)) END AS weight FROM part""",
)
def proposal_weights(spark, d):
    """Proposal arithmetic: slope fraction, else a small step along the residual."""
    ols = F.when(F.col("p_size") % 3 == 0, (F.col("p_retailprice") - 1000) / 100)
    weight = s.suggested_weight(F.when(F.abs(ols) > 1e-12, ols), F.col("p_retailprice") / 50000, (F.col("p_size") - 25) / 25.0, F.lit(0.0))
    return table(spark, d, "part").select("p_partkey", weight.alias("weight"))
