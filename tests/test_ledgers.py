"""Allocation, evidence by experiment, tolerance bands and guarded verdicts."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import ledgers as l
from quarry.operators import paired
from quarry.streaming import journal as sj

ARMS = "arm string, trials double, promotions double, score_gain double, cost_ms double"
ROWS = "journal string, seq long, experiment long, arm string, accepted boolean, trials double, promotions double, score_gain double, cost_ms double"


@pytest.mark.parametrize(("budget", "floor", "reserve"), [(29, 0.2, 6), (100, 0.2, 20), (0, 0.2, 0), (7, 0.0, 0), (5, 2.0, 5), (12, 0.125, 2)])
def test_slots_sum_to_the_budget(spark, budget, floor, reserve):
    arms = spark.createDataFrame([("a", 10.0, 3.0, 2e-6, 4000.0), ("b", 2.0, 0.0, 0.0, 9000.0), ("c", 0.0, 0.0, 0.0, 0.0), ("d", 5.0, 0.0, -1.0, 100.0)], ARMS)
    got = {r.arm: r.slots for r in l.slots(arms, budget, floor).collect()}
    assert sum(got.values()) == budget and min(got.values()) >= reserve // 4
    untried = spark.createDataFrame([(x, 0.0, 0.0, 0.0, 0.0) for x in "abcd"], ARMS)
    even = {r.arm: r.slots for r in l.slots(untried, budget, floor).collect()}
    assert sum(even.values()) == budget and max(even.values()) - min(even.values()) <= 2
    assert l.slots(untried.where("false"), budget, floor).count() == 0


def journal_rows():
    random.seed(4)
    rows, seq = [], 0
    for e in range(40):
        accepted = random.random() < 0.2
        for k in range(random.randint(1, 4)):
            rows.append((f"j{e % 2}", seq, e, f"a{random.randint(0, 2)}", accepted and k == 0, 1.0, float(k == 1), random.random(), 10.0 + k))
            seq += 1
    return rows


def plain_evidence(rows, decay=0.9, retention=0.25):
    out = {}
    for journal in sorted({r[0] for r in rows}):
        held = {}
        mine = [r for r in rows if r[0] == journal]
        for e in sorted({r[2] for r in mine}):
            held = {a: [x * decay for x in v] for a, v in held.items()}
            batch = [r for r in mine if r[2] == e]
            for r in batch:
                v = held.setdefault(r[3], [0.0] * 5)
                for k, x in enumerate([*r[5:9], float(r[4])]):
                    v[k] += x
            if any(r[4] for r in batch):
                held = {a: [x * retention for x in v] for a, v in held.items()}
        out |= {(journal, a): v for a, v in held.items()}
    return out


def test_experiments_decay_once(spark, tmp_path):
    rows = journal_rows()
    want = plain_evidence(rows)
    df = spark.createDataFrame(rows, ROWS)
    names = ["trials", "promotions", "score_gain", "cost_ms", "accepts"]
    for found in (l.decayed_evidence(df, ["journal"], ["seq"], "arm", experiment=["experiment"]), l.fold_evidence(df, ["journal"], ["seq"], "arm", experiment=["experiment"])):
        got = {(r.journal, r.arm): [r[n] for n in names] for r in found.collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    for k in range(3):  # whole experiments come in a batch
        part = [r for r in rows if 14 * k <= r[2] < 14 * (k + 1)]
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = sj.stream_evidence(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), experiment=["experiment"])
        stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    got = {(r.journal, r.arm): [r[n] for n in names] for r in spark.read.parquet(f"{tmp_path}/out/{last}").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def near(a, b):
    if a is None or b is None:
        return a is None and b is None
    return a == a and b == b and abs(a - b) <= max(1e-9, 1e-6 * max(abs(a), abs(b)))


def test_tolerance_bands_lose_no_match(spark):
    random.seed(2)
    values = [None, float("nan"), 0.0, 1e-3, -1e-3, 1e300, -1e300, 5e-324]
    for _ in range(300):
        v = random.choice([-1, 1]) * 10 ** random.uniform(-12, 12)
        values += [v, v * (1 + random.uniform(-2e-6, 2e-6)), v + random.uniform(-2e-9, 2e-9)]
    probes, cache = values[::2], values[1::2] + [None]
    p = spark.createDataFrame([(i, "x", v) for i, v in enumerate(probes)], "id long, k string, v double")
    c = spark.createDataFrame([("x", v) for v in cache] + [("y", v) for v in probes], "k string, v double")
    got = {r.id for r in l.cache_misses(p, c, ["k"], "v").collect()}
    assert got == {i for i, v in enumerate(probes) if not any(near(v, w) for w in cache)}
    kept = []
    for v in probes:
        if v is None or v != v or not any(near(v, w) for w in kept if w is not None):
            kept.append(v)
    rows = l.first_of_near(p, ["k"], ["id"], "v").count()
    assert rows == len(kept)


def test_guards_keep_a_better_interval_inconclusive(spark):
    rows = spark.createDataFrame([(-2.0, -1.0, 9, -0.1, -0.2), (-2.0, -1.0, 9, 0.1, -0.2), (-2.0, -1.0, 9, None, -0.2), (1.0, 2.0, 9, -1.0, -1.0), (-1.0, 1.0, 9, -1.0, -1.0), (-2.0, -1.0, 2, -1.0, -1.0)], "lo double, hi double, n int, g double, h double")
    got = [r[0] for r in rows.select(paired.verdict(F.col("lo"), F.col("hi"), F.col("n"), guards=(F.col("g"), F.col("h")))).collect()]
    assert got == ["better", "inconclusive", "inconclusive", "worse", "inconclusive", "insufficient"]


def test_roulette_takes_the_first_row_that_reaches_the_draw(spark):
    """Weights that aren't positive leave later rows with as small a running weight, or a smaller one."""
    rows = [("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, -2.0), ("a", 4, 2.0), ("b", 1, 1.0), ("b", 2, 1.0), ("b", 3, 0.0), ("b", 4, 0.0), ("b", 5, 2.0)]
    found = l.roulette(spark.createDataFrame(rows[::-1], "g string, id int, w double"), ["g"], "w", 0.5, "id").collect()
    assert {r.g: r.id for r in found} == {"a": 2, "b": 2}
