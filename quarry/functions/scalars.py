"""Column functions of the experiment domain: predicates, activations, budgets, confidence.

Every function takes and returns Columns, so expressions stay inside generated code.
IDs in brackets name the operators of the inventory that a function covers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_NORMAL_QUARTILE = 0.3186393639643754
F32_EPSILON = 1.1920928955078125e-07


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def score_delta(score: Column, baseline: Column) -> Column:
    """[P1] Delta against the baseline of the same call; a missing baseline is an error [P5]."""
    return score - F.coalesce(baseline, F.raise_error(F.lit("scores have no baseline to measure deltas against")).cast("double"))


def accepts(delta: Column, least: float = 1e-6) -> Column:
    """[P2] Strictly better than the bar."""
    return delta > F.lit(least)


def is_candidate(stem: Column) -> Column:
    """[P3] Everything but the baseline."""
    return stem != "baseline"


def stem_index(stem: Column, strict: bool = True) -> Column:
    """[P4] The index in ``candidate-NNN``: digits only, or any integer that parses."""
    pattern = r"^candidate-([0-9]+)$" if strict else r"^candidate-(\+?[0-9]+)$"
    digits = F.regexp_extract(stem, pattern, 1)
    return F.when(digits != "", digits).try_cast("bigint")


def tolerance_equal(a: Column, b: Column, absolute: float = 1e-9, relative: float = 1e-6) -> Column:
    """[P6] Within the greater of two bounds; values that aren't finite match nothing."""
    bound = F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(finite(a) & finite(b) & (F.abs(a - b) <= bound), F.lit(False))


def parity_agrees(mine: Column, authority: Column, absolute: float, relative: float) -> Column:
    """[P7] Either bound suffices; the relative one is of at least 1."""
    apart = F.abs(mine - authority)
    return (apart <= absolute) | (apart <= F.lit(relative) * F.greatest(F.abs(authority), F.lit(1.0)))


def nearly_equal(a: Column, b: Column) -> Column:
    """[P8]"""
    return parity_agrees(a, b, 1e-9, 1e-6)


def saturated(squash: Column, post: Column) -> Column:
    """[P9] Saturation by squash family."""
    return (
        F.when(squash.isin("TANH", "BIPOLAR_SIGMOID"), F.abs(post) > 0.99)
        .when(squash.isin("LOGISTIC", "SIGMOID"), ~post.between(0.01, 0.99))
        .when(squash.isin("RELU", "LEAKY_RELU"), post <= 0.0)
        .when(squash.isin("CLIPPED", "HARD_TANH"), F.abs(post) >= 1.0 - 1e-6)
        .otherwise(F.abs(post) > 0.99)
    )


def squash_derivative(squash: Column, post: Column) -> Column:
    """[P10] Derivative at the activation's output."""
    one = F.lit(1.0)
    return (
        F.when(squash == "IDENTITY", one)
        .when(squash.isin("HARD_TANH", "CLIPPED"), F.when(F.abs(post) < 1.0 - 1e-6, one).otherwise(0.0))
        .when(squash.isin("TANH", "BIPOLAR_SIGMOID"), F.greatest(one - post * post, F.lit(0.0)))
        .when(squash.isin("LOGISTIC", "SIGMOID"), F.greatest(post * (one - post), F.lit(0.0)))
        .when(squash == "RELU", F.when(post > 0.0, one).otherwise(0.0))
        .when(squash == "LEAKY_RELU", F.when(post > 0.0, one).otherwise(0.01))
        .otherwise(F.when(F.abs(post) < 0.99, one).otherwise(0.0))
    )


def activation(squash: Column, pre: Column) -> Column:
    """[P11] Outputs of the activation families."""
    return (
        F.when(squash.isin("TANH", "BIPOLAR_SIGMOID"), F.tanh(pre))
        .when(squash.isin("LOGISTIC", "SIGMOID"), F.lit(1.0) / (F.lit(1.0) + F.exp(-pre)))
        .when(squash == "RELU", F.greatest(pre, F.lit(0.0)))
        .when(squash == "LEAKY_RELU", F.when(pre > 0, pre).otherwise(pre * 0.01))
        .when(squash.isin("HARD_TANH", "CLIPPED"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pre)))
        .when(squash == "ABSOLUTE", F.abs(pre))
        .otherwise(pre)
    )


def near_zero(post: Column) -> Column:
    """[P12]"""
    return F.abs(post) < 1e-6


def forward_edge(from_pos: Column, to_pos: Column) -> Column:
    """[P13] An edge must go forward in topological order."""
    return from_pos < to_pos


def unit_scaled(low: Column, high: Column, count: Column, slack: float = 0.05) -> Column:
    """[P14] An aggregate: all columns with values lie in the unit range, and there is one."""
    fits = F.bool_and(F.when(count > 0, finite(low) & finite(high) & (low >= -1.0 - slack) & (high <= 1.0 + slack)))
    return F.coalesce(fits, F.lit(False))


def age_live(inserted: Column, now: Column, most: int) -> Column:
    """[P18] Clocks that go backwards expire nothing; 0 means no limit."""
    return F.lit(True) if most == 0 else F.greatest(now - inserted, F.lit(0)) < most


def covariance(r: Column, sd_a: Column, sd_b: Column) -> Column:
    """[P19] Derived, never stored."""
    return r * sd_a * sd_b


RULE_FEATURES = ("x", "y", "w", "r", "xy", "xr", "yr", "wyy", "xyy")


def rule_delta(coefficients: dict[str, float], x: Column, y: Column, w: Column, r: Column) -> Column:
    """[P20] A sparse linear rule over nine features of an edge."""
    known = {"x": x, "y": y, "w": w, "r": r, "xy": x * y, "xr": x * r, "yr": y * r, "wyy": w * y * y, "xyy": x * y * y}
    terms = [F.lit(c) * known[name] for name, c in coefficients.items()]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def local_residual(is_output: Column, target: Column, post: Column) -> Column:
    """[P21] Known for outputs alone."""
    return F.when(is_output, target - post)


def stratum(value: Column, low: Column, high: Column, bins: int) -> Column:
    """[P22] Equal-width bins from 0, clamped; NaN and an empty range are bin 0."""
    place = (value - low) / F.when(high > low, high - low) * bins
    return F.when(place.isNull() | F.isnan(value) | (place <= 0), 0).otherwise(F.least(F.floor(place), F.lit(bins - 1))).cast("int")


def axis_shape(base: Column, plus: Column, minus: Column, plus_half: Column, minus_half: Column) -> Column:
    """[P23] Shape of a loss along an axis, from the losses at two step sizes."""
    plus_flat, minus_flat = F.abs(plus - base) <= base * 1e-6, F.abs(minus - base) <= base * 1e-6
    wide, narrow = plus + minus - base * 2, plus_half + minus_half - base * 2
    return (
        F.when(plus_flat & minus_flat, "flat")
        .when(plus_flat | minus_flat, "edge")
        .when(F.abs(wide) <= F.greatest(base, F.lit(1e-12)) * 1e-9, "indeterminate")
        .when((narrow == 0) | (F.signum(narrow) != F.signum(wide)), "kinked")
        .when(F.abs(F.try_divide(wide, narrow) / 4.0 - 1.0) > 0.25, "kinked")
        .otherwise("smooth")
    )


def is_input_source(uuid: Column) -> Column:
    """[P24]"""
    return uuid.startswith("input-")


def nonnegative_squash(squash: Column) -> Column:
    """[P24]"""
    return squash.isin("ABSOLUTE", "ReLU", "RELU", "ReLU6", "Softplus")


def sublinear_budget(floor: int, population: Column, gain: float, ceiling: int) -> Column:
    """Budgets: round(gain * sqrt(n)) between a floor and a ceiling."""
    if not 0 < gain < float("inf"):
        return F.lit(floor).cast("long")
    return F.least(F.greatest(F.round(F.sqrt(population) * gain), F.lit(floor)), F.lit(max(ceiling, floor))).cast("long")


def drift_epsilon(records: Column, error_scale: Column) -> Column:
    """Tolerated drift of a remembered baseline: float32 rounding, grown with log2 of the records."""
    scale = F.when(finite(error_scale), F.greatest(F.lit(1e-6), F.least(F.lit(2.0), F.abs(error_scale)))).otherwise(1.0)
    return F.greatest(F.lit(1e-6), F.least(F.lit(1e-3), scale * F.log2(F.greatest(records, F.lit(2)).cast("double")) * (F32_EPSILON * 64)))


def reward_rate(score_gain: Column, promotions: Column, cost_ms: Column, least: float = 1e-6) -> Column:
    """Reward units a second of an arm, with 10 s of prior cost."""
    units = F.greatest(score_gain / (least if least > 0 else 1.0), F.lit(0.0)) + promotions * 0.05
    return F.when(cost_ms >= 0, F.greatest(units / (cost_ms / 1000.0 + 10.0), F.lit(0.0))).otherwise(0.0)


def prior_confidence(age_hours: Column, corpus: Column, source: Column, half_life: float = 24.0, most: float = 168.0) -> Column:
    """Age halves it; a mismatch of corpus or source scales it."""
    age = F.when(age_hours > most, 0.0).otherwise(F.pow(F.lit(0.5), age_hours / half_life))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), age * corpus * source))


def candidate_arm(follow_up: Column, neighbourhood: Column) -> Column:
    """[P15] Arm of a candidate by its nullable structs: follow-ups are excluded; those with a
    region link to another neuron than the root are adjacent, all others isolated."""
    return F.when(follow_up.isNotNull(), "excluded").when(neighbourhood.isNotNull() & ~neighbourhood["role"].eqNullSafe("root"), "adjacent").otherwise("isolated")


def targets_root(neighbourhood: Column) -> Column:
    """[P15] Whether a candidate's region link names the root."""
    return F.coalesce(neighbourhood["role"] == "root", F.lit(False))


def stack_scale(k: Column) -> Column:
    """[G14] Weight scale where k variants add to one target."""
    return F.when(k <= 1, 1.0).otherwise(F.pow(k.cast("double"), F.lit(-0.5)))


def per_hour(value: Column, ms: Column, candidates: Column) -> Column:
    """[A27] Null where nothing was measured."""
    return F.when((candidates > 0) & (ms > 0), value / (ms / 3.6e6))


def suggested_weight(ols: Column, weight_scale: Column, direction: Column, error: Column, scale: float = 0.05, most: float = 0.08) -> Column:
    """Proposal weight: a fraction of the regression slope, else a small step along the residual."""
    fitted = F.when(finite(ols) & (F.abs(ols) > 1e-12), F.greatest(F.lit(-most), F.least(F.lit(most), ols * scale)))
    size = F.greatest(F.lit(1e-5), F.least(F.lit(most), weight_scale * (scale / 0.05)))
    sign = F.when(F.abs(direction) > 1e-3, F.signum(direction)).when(F.abs(error) > 1e-9, F.signum(error)).otherwise(1.0)
    return F.coalesce(fitted, sign * size)


def duration_label(ms: Column) -> Column:
    """Milliseconds below a second as such, else seconds with one digit; null stays null."""
    return F.when(ms >= 1000, F.format_string("%.1fs", ms / 1000.0)).when(ms.isNotNull(), F.concat(ms.cast("string"), F.lit("ms")))


def merge_sum(a: Column, b: Column) -> Column:
    """Two maps of numbers added key by key; a key or map that is missing counts as zero."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return F.coalesce(both, a, b)
