"""Optimiser arms and the decision loop over sets of candidates.

Arms of a bench are independent: one group a (cell, seed, arm) runs in one task. The
problems are small; records of a cell travel with it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "family string, dimension int, seed long, arm string, start_loss double, final_loss double, evaluations int, error string"


def combination_sets(improvers: int, most: int = 50) -> list[tuple[int, ...]]:
    """[K13] Index sets of two and more in lexicographic order by size, capped at most - improvers."""
    out: list[tuple[int, ...]] = []
    room = max(most - improvers, 0)
    for k in range(2, improvers + 1):
        for c in combinations(range(improvers), k):
            if len(out) >= room:
                return out
            out.append(c)
    return out


def mirror_twins(candidates: DataFrame) -> DataFrame:
    """[G17] Each perturbation and its opposite, with their roles."""
    ways = F.array(F.struct(F.lit("original").alias("role"), F.lit(1.0).alias("sign")), F.struct(F.lit("mirror").alias("role"), F.lit(-1.0).alias("sign")))
    both = candidates.select("*", F.explode(ways).alias("m"))
    return both.select(*candidates.columns, F.col("m.role").alias("role"), (F.col("old_value") + F.col("delta") * F.col("m.sign")).alias("new_value"))


def follow_up_probes(changes: DataFrame, fractions: tuple[float, ...] = (0.5, -0.5, 1.0)) -> DataFrame:
    """[G18] Further steps along what an accepted change did."""
    return changes.select("*", F.explode(F.array(*map(F.lit, fractions))).alias("fraction")).withColumn("probe", F.col("new_value") + F.col("fraction") * (F.col("new_value") - F.col("old_value")))


def synthetic_corpus(spark: SparkSession, records: int, inputs: int, seed: int = 1) -> DataFrame:
    """[S22] Seeded uniform inputs and a smooth target, the same under any partitioning."""
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(k)), F.lit(1 << 24)) / float(1 << 23) - 1).cast("float").alias(f"x{k}") for k in range(inputs)]
    rows = spark.range(records).select(F.col("id").alias("record_id"), F.array(*u).alias("inputs"))
    target = F.tanh(F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x.cast("double")))
    return rows.withColumn("outputs", F.array(target.cast("float")))


def _objective(family: str, dimension: int, seed: int):
    rng = np.random.default_rng([seed, dimension])
    x = rng.uniform(-1, 1, (64, dimension))
    truth = rng.normal(0, 1, dimension)
    squash = {"tanh": np.tanh, "relu": lambda v: np.maximum(v, 0)}.get(family, lambda v: np.clip(v, -1, 1))
    y = squash(x @ truth)
    return lambda w: float(((squash(x @ w) - y) ** 2).mean()), rng.normal(0, 1, dimension)


def axis_refine(loss, start: np.ndarray, budget: int, rng) -> tuple[float, int]:
    """[G23] Random axes, a step that grows on success and shrinks on failure."""
    best, w, step, used = loss(start), start.copy(), 0.5, 1
    while used < budget:
        trial = w.copy()
        trial[rng.integers(len(w))] += rng.normal() * step
        value, used = loss(trial), used + 1
        if value < best:
            best, w, step = value, trial, step * 1.2
        else:
            step = max(step * 0.95, 1e-6)
    return best, used


def evolution(loss, start: np.ndarray, budget: int, rng) -> tuple[float, int]:
    """[G23] Covariance-adapting evolution with rank-mu updates and cumulative step control."""
    n = len(start)
    size = 4 + int(3 * np.log(n))
    mu = size // 2
    weights = np.log(mu + 0.5) - np.log(np.arange(1, mu + 1))
    weights /= weights.sum()
    eff = 1 / (weights**2).sum()
    c_path, c_cov, c_one = (eff + 2) / (n + eff + 5), min(1.0, eff / (n + 4) ** 2), 2 / ((n + 1.3) ** 2 + eff)
    damp = 1 + 2 * max(0, np.sqrt((eff - 1) / (n + 1)) - 1) + c_path
    mean, sigma, cov, path, one = start.copy(), 0.5, np.eye(n), np.zeros(n), np.zeros(n)
    expected = np.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))
    best, used = loss(start), 1
    while used + size <= budget:
        values, vectors = np.linalg.eigh(cov)
        root = vectors * np.sqrt(np.maximum(values, 1e-20))
        steps = rng.standard_normal((size, n)) @ root.T
        losses = np.array([loss(mean + sigma * s) for s in steps])
        used += size
        order = np.argsort(losses)[:mu]
        best = min(best, float(losses[order[0]]))
        move = weights @ steps[order]
        mean = mean + sigma * move
        whiten = vectors @ ((vectors.T @ move) / np.sqrt(np.maximum(values, 1e-20)))
        path = (1 - c_path) * path + np.sqrt(c_path * (2 - c_path) * eff) * whiten
        one = (1 - c_path) * one + np.sqrt(c_path * (2 - c_path) * eff) * move
        cov = (1 - c_one - c_cov) * cov + c_one * np.outer(one, one) + c_cov * (steps[order].T * weights) @ steps[order]
        sigma *= float(np.exp(np.clip(c_path / damp * (np.linalg.norm(path) / expected - 1), -1, 1)))
    return best, used


ARMS = {"refine": axis_refine, "cma-es": evolution}


def run_bench(spark: SparkSession, families: list[str], dimensions: list[int], seeds: list[int], budget: int, arms: tuple[str, ...] = ("refine", "cma-es")) -> DataFrame:
    """[G23, G24, S21] Runs of all arms with equal budgets; a failure is a row with its error."""
    cells = [(f, d, s, a) for f in families for d in dimensions for s in seeds for a in arms]
    plan = spark.createDataFrame(cells, "family string, dimension int, seed long, arm string")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        key = [row.family, int(row.dimension), int(row.seed), row.arm]
        try:
            loss, start = _objective(row.family, int(row.dimension), int(row.seed))
            best, used = ARMS[row.arm](loss, start, budget, np.random.default_rng([int(row.seed), list(ARMS).index(row.arm)]))
            out = [*key, loss(start), best, used, None]
        except Exception as error:  # noqa: BLE001
            out = [*key, None, None, 0, str(error)]
        return pd.DataFrame([out], columns=[c.split()[0] for c in RUNS.split(", ")])

    return plan.groupBy("family", "dimension", "seed", "arm").applyInPandas(run, RUNS)
