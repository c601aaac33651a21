"""State that stays on the driver, because it is small or one decision follows the other
(S10, S15, S18, S20, G11-G13, G15, G16, G26, K16, K18, K19, P17)."""

from __future__ import annotations

import json
import math
import os
import random
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any


@dataclass
class RememberedBaseline:
    """[G11] A full-corpus baseline that is served for up to ``interval`` calls, then
    verified; drift beyond the tolerance forgets it."""

    interval: int
    epsilon: float
    key: tuple | None = None
    score: float | None = None
    served: int = 0

    def store(self, key: tuple, score: float) -> None:
        self.key, self.score, self.served = key, score, 0

    def serve(self, key: tuple) -> float | None:
        """The score, unless there is none for the key or it is time to verify."""
        if self.interval <= 0 or self.score is None or self.key != key or self.served >= self.interval:
            return None
        self.served += 1
        return self.score

    def verify(self, key: tuple, score: float) -> bool:
        """Takes a fresh score; whether the remembered one had stayed within the tolerance."""
        held = self.key != key or self.score is None or abs(score - self.score) <= self.epsilon
        self.store(key, score)
        return held


class AnalysisMemo:
    """[G12] Results by content key, the least recently used ones dropped first."""

    def __init__(self, capacity: int):
        self.capacity, self.kept = capacity, OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Any, compute: Callable[[], Any]) -> Any:
        if key in self.kept:
            self.hits += 1
            self.kept.move_to_end(key)
            return self.kept[key]
        self.misses += 1
        value = compute()
        if self.capacity > 0:
            self.kept[key] = value
            while len(self.kept) > self.capacity:
                self.kept.popitem(last=False)
        return value

    def invalidate(self) -> None:
        self.kept.clear()


@dataclass
class CallTimings:
    """[S15] Rows of scorer calls: phase, creatures, rate, ms and whether it failed."""

    rows: list[dict] = field(default_factory=list)

    @contextmanager
    def call(self, phase: str, creatures: int, rate: float = 1.0):
        began, failed = time.monotonic(), True
        try:
            yield
            failed = False
        finally:
            self.rows.append({"phase": phase, "creatures": creatures, "sampleRate": rate, "elapsedMs": int(1000 * (time.monotonic() - began)), "failed": failed})


class JsonStore:
    """[S10, S18, S20] A versioned JSON document; a version that doesn't fit is refused."""

    def __init__(self, path: str, version: str):
        self.path, self.version = path, version

    def save(self, content: dict) -> None:
        part = f"{self.path}.{os.getpid()}"
        with open(part, "w") as f:
            json.dump({"version": self.version, **content}, f)
        os.replace(part, self.path)

    def load(self) -> dict | None:
        if not os.path.exists(self.path):
            return None
        with open(self.path) as f:
            found = json.load(f)
        if found.get("version", "").split(".")[0] != self.version.split(".")[0]:
            raise ValueError(f"{self.path} has version {found.get('version')}, not {self.version}")
        return found


def stale_reasons(document: dict, wanted: dict) -> list[str]:
    """[P17] Why cached statistics don't fit: each fact that differs."""
    facts = ("formatVersion", "algorithmVersion", "mode", "sampleRecordLimit", "inputCount", "outputCount", "corpusIdentity")
    return [f"{f}: {document.get(f)!r} isn't {wanted[f]!r}" for f in facts if f in wanted and document.get(f) != wanted[f]]


def select_focus(policy: str, neurons: list[dict], excluded: Iterable[str] = (), seed: int = 0) -> str | None:
    """[K16] A neuron by policy: fixed (the first), random, unsaturated, high-error or weighted."""
    out = set(excluded)
    left = [n for n in neurons if n["uuid"] not in out]
    if policy == "unsaturated":
        left = [n for n in left if n.get("saturation", 0.0) < 0.5] or left
    if not left:
        return None
    rng = random.Random(seed)
    if policy == "fixed":
        return left[0]["uuid"]
    if policy == "high-error":
        return max(left, key=lambda n: (n.get("signal", 0.0), n["uuid"]))["uuid"]
    if policy == "weighted":
        return min(left, key=lambda n: -math.log(1 - rng.random()) / max(n.get("weight", 0.0), 1e-4))["uuid"]
    return rng.choice(left)["uuid"]


def sparse_selection(edges: list[tuple[int, int]], neurons: list[int], ratio: float, seed: int) -> set[int]:
    """[K19] A seeded share of the neurons, and all that lie forward of them."""
    order = list(neurons)
    random.Random(seed).shuffle(order)
    chosen = set(order[: max(1, round(ratio * len(order)))])
    for a, b in sorted(edges):
        if a in chosen:
            chosen.add(b)
    return chosen


def refill(deferred: list[tuple[str, Any]], filled: dict[str, int], quotas: dict[str, int], room: int) -> list[tuple[str, Any]]:
    """[K18] Deferred proposals, always from the arm that is least over its quota."""
    taken, counts = [], dict(filled)
    left = list(enumerate(deferred))
    while left and len(taken) < room:
        at = min(range(len(left)), key=lambda i: (counts.get(left[i][1][0], 0) - quotas.get(left[i][1][0], 0), left[i][0]))
        _, (arm, proposal) = left.pop(at)
        counts[arm] = counts.get(arm, 0) + 1
        taken.append((arm, proposal))
    return taken


def propose(stats: dict, strategies: Iterable[str], scales: Iterable[float], seed: int = 0) -> list[dict]:
    """[G16] The grid of scalar proposals for a focus: every strategy at every scale, without
    repeated values. Structural proposals come from ``graph.top_sources``."""
    rng = random.Random(seed)
    steps = {
        "mean_error_bias": stats.get("mean_error", 0.0), "stats_bias": stats.get("mean_error", 0.0) / max(stats.get("pre_std", 1.0), 1e-3), "stats_weight": stats.get("correlation", 0.0) * 0.1,
        "structural_weaken": -0.5 * stats.get("weight", 0.0), "random": rng.uniform(-0.05, 0.05), "backprop": stats.get("blame", 0.0),
    }
    out, seen = [], set()
    for scale in scales:
        for strategy in strategies:
            value = stats.get("value", 0.0) + scale * steps.get(strategy, 0.0)
            if (strategy, value) not in seen and value != stats.get("value", 0.0):
                seen.add((strategy, value))
                out.append({"strategy": strategy, "old_value": stats.get("value", 0.0), "new_value": value})
    return out


def select_with_combinations(baseline: float, scores: dict[str, float], score_combination: Callable[[list[str]], float | None], bar: float = 1e-6, most: int = 50) -> tuple[str, float, list[str]] | None:
    """[G13, K1, K13] The best single or combination against a baseline of the same call."""
    from quarry.operators.optimisers import combination_sets

    better = sorted(((s - baseline, stem) for stem, s in scores.items() if stem != "baseline" and s - baseline > bar), key=lambda x: (-x[0], x[1]))
    if not better:
        return None
    best = (better[0][1], better[0][0], [better[0][1]])
    for k, members in enumerate(combination_sets(len(better), most)):
        stems = [better[i][1] for i in members]
        score = score_combination(stems)
        if score is not None and score - baseline > best[1]:
            best = (f"combo-{k:03d}-k{len(stems)}", score - baseline, stems)
    return best


def apply_graft(edges: dict[tuple[str, str], float], neurons: set[str], graft: dict) -> dict[tuple[str, str], float]:
    """[G15] A graph with a graft's edges; what it requires must exist, what exists stays."""
    missing = [n for n in graft["requires"] if n not in neurons]
    if missing:
        raise ValueError(f"the graft needs {missing}")
    return {**{(e["from"], e["to"]): e["weight"] for e in graft["synapses"]}, **edges}


def diagnose_axes(loss: Callable[[list[float]], float], start: list[float], step: float = 1e-2) -> list[dict]:
    """[G26, A48] Five losses of every axis, as rows for ``paired.axis_shapes``."""
    base = loss(start)
    rows = []
    for axis in range(len(start)):
        def at(delta: float) -> float:
            moved = list(start)
            moved[axis] += delta  # noqa: B023
            return loss(moved)

        rows.append({"axis": axis, "base": base, "plus": at(step), "minus": at(-step), "plus_half": at(step / 2), "minus_half": at(-step / 2)})
    return rows
