"""Operators on hand-computed cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars as s
from quarry.operators import gates, graph, ledgers, optimisers, paired, profile


def one(df):
    return df.first()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_profile_skips_what_is_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (9.0, 5.0), (nan, nan), (inf, None)], "a double, b double")
    rows = {r["column"]: r for r in profile.profile(df, ["a", "b"]).collect()}
    assert rows["a"]["count"] == 4 and rows["a"]["skewness"] == pytest.approx(0.768418, abs=1e-6) and rows["a"]["excess_kurtosis"] == pytest.approx(-1, abs=0.05)
    assert (rows["a"]["non_finite_count"], rows["b"]["skewness"], rows["b"]["variance"]) == (2, 0.0, 0.0)
    empty = one(profile.profile(df.where("false"), ["a"]))
    assert empty is None or empty["count"] == 0


def test_correlation_of_constants_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 3.0), (3.0, 6.0, 3.0)], "a double, b double, c double")
    assert [round(r.r, 9) for r in profile.upper_triangle(df, ["a", "b", "c"]).orderBy("i", "j").collect()] == [1, 1, 0, 1, 0, 0]
    assert one(df.limit(1).agg(profile.pearson(F.col("a"), F.col("b")).alias("r"))).r == 0.0
    poisoned = df.union(spark.createDataFrame([(float("nan"), 1.0, 1.0)], df.schema))
    assert math.isnan(one(poisoned.agg(profile.pearson(F.col("a"), F.col("b")).alias("r"))).r)


def test_quantiles_and_ranks(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (1, 2, 2, 3)], "column string, value double")
    q = {r.quantile: r.value for r in profile.nearest_rank_quantiles(df, "column", "value").collect()}
    assert (q[0.01], q[0.5], q[0.99]) == (1, 2, 3)  # 0.5 * 3 = 1.5 rounds to 2
    assert sorted(r.k for r in df.select(profile.average_rank("value", ["column"]).alias("k")).collect()) == [1, 2.5, 2.5, 4]
    assert {r.quantile for r in profile.approximate_quantiles(df, "column", "value").collect()} == set(profile.QUANTILES)
    two = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 1.0)], "g int, x double, y double")
    assert one(profile.spearman(two, ["g"], "x", "y")).rho is None


def test_cost_fit(spark):
    line = spark.createDataFrame([("a", n, 100.0 + 7 * n) for n in (1, 2, 5)] + [("b", 3, 9.0), ("b", 3, 11.0)], "phase string, n int, ms double")
    fit = {r.phase: r for r in profile.least_squares(line, ["phase"], "n", "ms").collect()}
    assert (fit["a"].fixed_ms, fit["a"].marginal_ms_per_creature, fit["a"].r_squared) == pytest.approx((100, 7, 1))
    assert fit["b"].fixed_ms is None and fit["b"].mean_ms == 10


def test_dead_sources_score_nothing(spark):
    rows = [("input-0", 1.0, 1.0), ("input-0", 1.0, 2.0), ("h", 1.0, 1.0), ("h", 1.0, 2.0), ("g", 1.0, 1.0), ("g", 2.0, 3.0)]
    found = {r.source: r for r in profile.residual_regression(spark.createDataFrame(rows, "source string, x double, e double"), "source", "x", "e").collect()}
    assert found["h"].ols_weight is None and found["h"].score == 0 and found["g"].ols_weight == pytest.approx(2)


@pytest.mark.parametrize(("a", "b", "want"), [(1.0, 1.0 + 1e-7, True), (1.0, 1.001, False), (float("nan"), 1.0, False), (float("inf"), float("inf"), False), (None, 1.0, False)])
def test_tolerance(spark, a, b, want):
    assert value(spark, s.tolerance_equal(F.lit(a).cast("double"), F.lit(b).cast("double"))) is want


def test_scalars(spark):
    assert value(spark, s.stem_index(F.lit("candidate-007"))) == 7 and value(spark, s.stem_index(F.lit("combo-001-k2"))) is None
    assert value(spark, s.sublinear_budget(4, F.lit(100), 1.0, 8)) == 8 and value(spark, s.sublinear_budget(4, F.lit(100), 0.0, 8)) == 4
    assert value(spark, s.stratum(F.lit(float("nan")), F.lit(0.0), F.lit(1.0), 4)) == 0 and value(spark, s.stratum(F.lit(9.0), F.lit(0.0), F.lit(1.0), 4)) == 3
    assert value(spark, s.stack_scale(F.lit(4))) == 0.5 and value(spark, s.stack_scale(F.lit(1))) == 1
    assert value(spark, s.age_live(F.lit(50), F.lit(10), 5)) is True and value(spark, s.age_live(F.lit(1), F.lit(10), 5)) is False
    with pytest.raises(Exception, match="no baseline"):
        value(spark, s.score_delta(F.lit(1.0), F.lit(None).cast("double")))
    shapes = [(1.0, 1.0, 1.0, 1.0, 1.0, "flat"), (1.0, 2.0, 1.0, 1.5, 1.0, "edge"), (1.0, 1.4, 1.4, 1.1, 1.1, "smooth"), (1.0, 1.4, 1.4, 1.2, 1.2, "kinked"), (1.0, 1.5, 0.5, 1.2, 0.8, "indeterminate")]
    for *losses, shape in shapes:
        assert value(spark, s.axis_shape(*map(F.lit, losses))) == shape


def screened(spark, rows):
    return spark.createDataFrame(rows, "experiment long, stem string, strategy string, delta double, full_delta double")


def test_gates(spark):
    rows = screened(spark, [(1, f"candidate-00{i}", "s", d, d) for i, d in enumerate((1.0, -1.0, 2.0, 10.0))] + [(2, "candidate-000", "s", 5.0, 5.0)])
    t = {r.experiment: r for r in gates.gate_thresholds(rows).collect()}
    assert t[1].sigma == pytest.approx(1.0 / 0.3186393639643754) and t[2].threshold == 1e-6
    assert [r.stem for r in gates.promoted(rows, gates.gate_thresholds(rows, k=1.0)).where("experiment = 1").collect()] == ["candidate-003"]
    assert {r.experiment: r.stem for r in gates.winners(rows).collect()} == {1: "candidate-003", 2: "candidate-000"}
    ties = screened(spark, [(1, "candidate-002", "s", 1.0, 0.0), (1, "candidate-001", "s", 1.0, 0.0)])
    assert one(gates.winners(ties)).stem == "candidate-001"


def test_gate_replay_is_monotone_and_combos_need_all_members(spark):
    rng = np.random.default_rng(0)
    rows = screened(spark, [(e, f"candidate-{i:03d}", "s", float(rng.normal()), 0.0) for e in range(5) for i in range(8)])
    accepted = spark.createDataFrame([(0, "combo-000-k2", ["candidate-000", "candidate-001"]), (1, "combo-000-k2", [])], "experiment long, stem string, members array<string>")
    counts = [one(gates.gate_replay(rows, rows.select("experiment", "stem"), accepted, k=k)).promoted_under_gate for k in (0.5, 1.0, 2.0, 4.0)]
    assert counts == sorted(counts, reverse=True)
    found = one(gates.gate_replay(rows, rows.select("experiment", "stem"), accepted, k=50.0))
    assert (found.accepts_kept, found.accepts_dropped, found.promoted_as_run) == (0, 2, 40)


def multiplier(spark, pairs, floor=1.0, bar=0.5):
    prior = F.array(*[F.struct(F.lit(a).alias("screen_delta"), F.lit(b).alias("full_delta")) for a, b in pairs])
    return value(spark, gates.calibrated_multiplier(prior, floor, bar))


def test_calibrated_multiplier(spark):
    assert multiplier(spark, [(1.0, -1.0)] * 7) is None
    assert multiplier(spark, [(1.0, -1.0)] * 7 + [(6.0, 1.0)]) == 3.0
    assert multiplier(spark, [(1.0, -1.0)] * 7 + [(-6.0, 1.0)]) == 0.125
    assert multiplier(spark, [(float(i), -1.0) for i in range(1, 9)]) == 4.5
    assert multiplier(spark, [(float(i), -1.0) for i in range(1, 9)] + [(3.0, 0.2)]) == 1.5
    assert multiplier(spark, [(float(i), -1.0) for i in range(1, 9)] + [(-3.0, 0.2)]) is None
    assert multiplier(spark, [(100.0, -1.0)] * 8) == 8.0


def test_prior_window_leaves_own_experiment_out(spark):
    rows = screened(spark, [(e, f"candidate-00{i}", "s", float(e), 0.0) for e in (1, 2, 3) for i in (0, 1)])
    got = {r.experiment: [p.screen_delta for p in r.prior] for r in gates.prior_window(rows.withColumnRenamed("delta", "screen_delta"), "strategy", ["experiment", "stem"], "experiment", 3).collect()}
    assert got == {1: [], 2: [1.0, 1.0], 3: [1.0, 2.0, 2.0]}


def test_controls_and_decisions(spark):
    rows = screened(spark, [(1, f"candidate-{i:03d}", "s", float(i - 9), 0.0) for i in range(10)])
    drawn = gates.control_draw(rows, 0.25, 7)
    assert drawn.count() == 3 and sorted(r.stem for r in drawn.collect()) == sorted(r.stem for r in gates.control_draw(rows.repartition(5), 0.25, 7).collect())
    decided = gates.screen_decisions(rows, spark.createDataFrame([(1, "s", 2.0)], "experiment long, strategy string, multiplier double"), -4.0, 0.1)
    assert decided.where("promoted").count() == decided.where("control").count() + rows.where("delta > -8").count()


def test_threshold_replay_keeps_unscreened_winners(spark):
    rows = screened(spark, [(1, "candidate-000", "s", 2.0, 1.0)]).withColumnRenamed("delta", "screen_delta")
    found = one(gates.threshold_replay(rows, rows.withColumnRenamed("screen_delta", "delta"), spark.createDataFrame([(1, "combo-000-k2"), (1, "candidate-000")], "experiment long, stem string"), 1.0, ["experiment", "stem"]))
    assert (found.accepts_kept, found.accepts_dropped) == (2, 0)


def test_evidence_fold_equals_closed_form(spark):
    rng = np.random.default_rng(4)
    rows = [("j", i, str(rng.choice(["a", "b", "c"])), bool(rng.random() < 0.3), 1.0, 0.5, float(rng.random()), 10.0) for i in range(60)]
    df = spark.createDataFrame(rows, "journal string, seq long, arm string, accepted boolean, trials double, promotions double, score_gain double, cost_ms double")
    a = {r.arm: r for r in ledgers.decayed_evidence(df, ["journal"], ["seq"], "arm").collect()}
    b = {r.arm: r for r in ledgers.fold_evidence(df, ["journal"], ["seq"], "arm").collect()}
    for arm in a:
        for name in ("trials", "promotions", "score_gain", "cost_ms", "accepts"):
            assert a[arm][name] == pytest.approx(b[arm][name])


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.range(500).selectExpr("'j' AS journal", "id AS seq", "'abc' AS arm", "id % 7 = 0 AS accepted", "1.0D AS trials", "0.0D AS promotions", "1.0D AS score_gain", "2.0D AS cost_ms")
    want = None
    for n in (1, 4, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = one(ledgers.decayed_evidence(rows.repartition(n), ["journal"], ["seq"], "arm")).asDict()
        want = want or got
        assert got == pytest.approx(want)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_slots_sum_to_the_budget(spark):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        arms = spark.createDataFrame([(f"a{i}", float(rng.integers(0, 50)), 1.0, float(rng.random()) * 1e-5, float(rng.random()) * 1e4) for i in range(7)], "arm string, trials double, promotions double, score_gain double, cost_ms double")
        found = ledgers.slots(arms, 29)
        assert one(found.agg(F.sum("slots").alias("n"), F.min("slots").alias("m"))).n == 29


def test_guardrail_cache_and_axes(spark):
    rows = spark.createDataFrame([("j", i, 0.0, 100.0) for i in range(25)], "journal string, seq long, saved double, spent double")
    out = ledgers.rolling_guardrail(rows, ["journal"], ["seq"], "saved", "spent").orderBy("seq").collect()
    assert [r.stood_down for r in out] == [False] * 19 + [True] * 6
    probes = spark.createDataFrame([("b", 1.0), ("b", None), ("b", 2.0), ("c", 1.0)], "bucket string, v double")
    cache = spark.createDataFrame([("b", 1.0 + 1e-8), ("b", None)], "bucket string, v double")
    assert sorted((r.bucket, r.v) for r in ledgers.cache_misses(probes, cache, ["bucket"], "v").collect()) == [("b", 2.0), ("c", 1.0)]
    near = spark.createDataFrame([("b", 1, 1.0), ("b", 2, 1.0 + 9e-7), ("b", 3, 1.0 + 1.8e-6)], "bucket string, n int, v double")
    assert sorted(r.n for r in ledgers.first_of_near(near, ["bucket"], ["n"], "v").collect()) == [1, 3]
    axes = spark.createDataFrame([("j", 1, False, ["x"]), ("j", 2, True, ["y"]), ("j", 3, False, ["z"])], "journal string, seq int, accepted boolean, axis_failures array<string>")
    assert {r.axis for r in ledgers.retired_axes(axes, ["journal"], ["seq"]).collect()} == {"y", "z"}


def test_bootstrap_and_verdicts(spark):
    rows = spark.createDataFrame([("c", float(v), False) for v in (-1, -2, -3, -2)], "cell string, difference double, failed boolean")
    found = one(paired.bootstrap_interval(rows, ["cell"], 400))
    assert -3 <= found.ci_low <= -2 <= found.ci_high <= -1
    again = one(paired.bootstrap_interval(rows.repartition(3), ["cell"], 400))
    assert (found.ci_low, found.ci_high) == (again.ci_low, again.ci_high)
    v = lambda a, b, n: value(spark, paired.verdict(F.lit(a), F.lit(b), F.lit(n)))
    assert (v(-2.0, -1.0, 5), v(1.0, 2.0, 5), v(-1.0, 1.0, 5), v(-2.0, -1.0, 2)) == ("better", "worse", "inconclusive", "insufficient")
    runs = spark.createDataFrame([("c", 1, "t", 1.0, 0, None), ("c", 1, "u", 2.0, 1, None), ("c", 2, "t", 1.0, 2, "boom"), ("c", 2, "u", 1.0, 3, None), ("c", 3, "t", 1.0, 4, None)], "cell string, seed int, arm string, m double, line int, error string")
    summary = one(paired.paired_summary(paired.pair_arms(runs, ["cell"], "seed", "m", "t", "u"), ["cell"]))
    assert (summary.pairs, summary.mean, summary.wins, summary.failures) == (1, -1.0, 1, 2)
    assert one(paired.overall(spark.createDataFrame([("better",), ("inconclusive",)], "verdict string"))).overall == "positive"


def test_easy_skip_counts(spark):
    rows = spark.range(100).selectExpr("id", "id % 10 = 0 AS protected", "CAST(id AS DOUBLE) AS e")
    kept = paired.easy_skip(rows, "id", "e", 0.5, 0.25).where("keep")
    assert kept.count() == 50 and kept.where("protected").count() == 10 and kept.where("drawn").count() == 10


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 4.0), ("x", "a", 1.0)], "from_id string, to_id string, weight double")
    places = spark.createDataFrame([("x", 0), ("a", 1), ("b", 2), ("c", 3)], "id string, pos int")
    assert {r.id: r.hops for r in graph.hops_to(edges, spark.createDataFrame([("c",)], "id string")).collect()} == {"c": 0, "b": 1, "a": 1, "x": 2}
    region = graph.grow_region(edges, spark.createDataFrame([("a",)], "id string"), 2, 3, 1)
    assert {r.id for r in region.collect()} == {"a", "c"} or region.count() <= 3
    assert graph.add_edge(edges, places, "x", "c", 0.5).count() == 5
    for bad in (("c", "a"), ("a", "b")):
        with pytest.raises(ValueError):
            graph.add_edge(edges, places, *bad, 0.5)
    split = {(r.from_id, r.to_id): r.weight for r in graph.split_edge(edges, "b", "c", "m").collect()}
    assert split["b", "m"] == 1.0 and split["m", "c"] == 2.0 and ("b", "c") not in split
    assert [r.to_id for r in graph.insertion_order(edges, places).collect()] == ["a", "b", "c", "c"]


def test_decision_loop_sets(spark):
    assert optimisers.combination_sets(3) == [(0, 1), (0, 2), (1, 2), (0, 1, 2)]
    assert len(optimisers.combination_sets(40, 50)) == 10
    twins = optimisers.mirror_twins(spark.createDataFrame([(1.0, 0.25)], "old_value double, delta double")).collect()
    assert {(t.role, t.new_value) for t in twins} == {("original", 1.25), ("mirror", 0.75)}
    probes = optimisers.follow_up_probes(spark.createDataFrame([(1.0, 2.0)], "old_value double, new_value double")).collect()
    assert sorted(p.probe for p in probes) == [1.5, 2.5, 3.0]
    assert optimisers.synthetic_corpus(spark, 50, 3).count() == 50


def test_bench_arms_have_equal_budgets(spark):
    runs = optimisers.run_bench(spark, ["tanh"], [4], [1, 2], 200).collect()
    assert len(runs) == 4 and all(r.error is None and 150 < r.evaluations <= 200 and r.final_loss <= r.start_loss for r in runs)


def test_bootstrap_draws_are_not_rows(spark):
    rows = spark.createDataFrame([("c", float(v * v % 37), False) for v in range(60)] + [("d", 2.5, False), ("d", None, True)], "cell string, difference double, failed boolean")
    found = paired.bootstrap_interval(rows, ["cell"], 100, seed=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # a join of draws is as large as resamples times pairs
    draws = spark.range(1, 101).selectExpr("'c' AS cell", "CAST(id AS INT) AS b", "explode(sequence(1, 60)) AS k").selectExpr("b", "pmod(xxhash64(3, cell, b, k), 60L) AS at").collect()
    known = sorted(float(v * v % 37) for v in range(60))
    means = sorted(sum(known[r.at] for r in draws if r.b == b) / 60 for b in range(1, 101))
    got = {r.cell: (r.ci_low, r.ci_high) for r in found.collect()}
    assert got["d"] == (2.5, 2.5) and got["c"] == pytest.approx((means[round(0.025 * 99)], means[round(0.975 * 99)]))
