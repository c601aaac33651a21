"""Queries that once kept a part of their table, against brute force over all of it."""

import math
from collections import defaultdict
from statistics import median

import pyarrow.parquet as pq

from quarry.plans import registry


def pairs_by_strategy(sf):
    orders = defaultdict(list)
    for r in pq.read_table(f"{sf}/lineitem.parquet").to_pylist():
        orders[r["l_orderkey"]].append(r)
    out = defaultdict(list)
    for experiment in sorted(orders):
        first, *rest = sorted(orders[experiment], key=lambda r: (r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["l_extendedprice"]))
        for r in rest:
            base, score = float(first["l_extendedprice"]), float(r["l_extendedprice"])
            out[r["l_returnflag"]].append((experiment, score - base, score * (1 - float(r["l_discount"])) - base))
    return out


def multiplier(prior, floor=500.0, bar=20000.0):
    if len(prior) < 8:
        return None
    clamp = lambda x: max(0.125, min(8.0, x))
    wins = [s for s, full in prior if full > bar]
    if wins:
        return clamp((min(wins) * 0.5 if min(wins) > 0 else floor / 8) / floor)
    losses = [s for s, full in prior if full <= 0]
    better = [s for s, full in prior if full > 0]
    if len(losses) < 8 or (better and min(better) <= 0):
        return None
    target = min(median(losses), min(better) * 0.5) if better else median(losses)
    return clamp(target / floor) if target > 0 else None


def test_calibrated_thresholds_of_every_experiment(spark, sf):
    want = {}
    for strategy, pairs in pairs_by_strategy(sf).items():
        for k, (experiment, _, _) in enumerate(pairs):
            if (strategy, experiment) not in want:
                prior = [p[1:] for p in pairs[max(0, k - 128) : k]]
                want[strategy, experiment] = len(prior), multiplier(prior)
    rows = registry.queries()["calibrated_thresholds"](spark, sf).collect()
    got = {(r.strategy, r.experiment): (r.pairs, r.multiplier) for r in rows}
    assert len(got) == len(rows) and got.keys() == want.keys()
    assert min(n for n, _ in got.values()) == 0
    for key, (pairs, m) in want.items():
        assert got[key][0] == pairs
        assert (got[key][1] is None) == (m is None), key
        assert m is None or math.isclose(got[key][1], m, rel_tol=1e-6, abs_tol=2e-6), key


def test_graft_states_of_every_order(spark, sf):
    lines = pq.read_table(f"{sf}/lineitem.parquet").to_pylist()
    there = {r["l_partkey"] for r in lines if r["l_orderkey"] % 3 == 0}
    parts, required = defaultdict(list), defaultdict(list)
    for r in lines:
        parts[r["l_orderkey"]].append(r["l_partkey"] in there)
        if r["l_quantity"] > 25:
            required[r["l_orderkey"]].append(r["l_partkey"] in there)
    want = {k: "present" if all(v) else "applicable" if all(required[k]) else "inapplicable" for k, v in parts.items()}
    rows = registry.queries()["graft_states"](spark, sf).collect()
    assert len(rows) == len(want) and {r.graft: r.state for r in rows} == want


def test_incoming_statistics_of_every_nation(spark, sf):
    read = lambda name: pq.read_table(f"{sf}/{name}.parquet").to_pylist()
    orders = defaultdict(int)
    for r in read("orders"):
        orders[r["o_custkey"]] += 1
    nations = {r["n_nationkey"] for r in read("nation")}
    want = sorted((r["c_nationkey"], r["c_custkey"], orders[r["c_custkey"]]) for r in read("customer") if r["c_nationkey"] in nations)
    rows = registry.queries()["incoming_statistics"](spark, sf).collect()
    assert sorted((r.to_id, r.from_id, r.orders) for r in rows) == want
