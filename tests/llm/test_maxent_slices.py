"""Weights of operator 6 are solved in slices, and executors give back memory between steps."""

import tracemalloc

import numpy as np

from quarry.llm import maxent
from quarry.session import release_heaps


def documents(spark, n=120):
    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"w{x}" for x in rng.zipf(1.4, 60) % 900)
    return spark.createDataFrame([(k, text(), k % 10 == 0) for k in range(n)], "doc_id long, text string, held_out boolean")


def test_slices_cut_between_histories(monkeypatch):
    monkeypatch.setattr(maxent, "SOLVE", 100, raising=False)
    codes = np.unique(np.random.default_rng(0).integers(0, 40, 3000) * maxent.TARGETS + np.random.default_rng(1).integers(0, 900, 3000))
    cuts = maxent.slices(codes, maxent.TARGETS)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(codes) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    histories = [set((codes[i:j] // maxent.TARGETS).tolist()) for i, j in cuts]
    assert len(cuts) > 10 and sum(map(len, histories)) == len(set().union(*histories))


def test_slices_change_no_score(spark, monkeypatch):
    """With a few codes a slice, also where most pairs are asked for."""
    docs, found = documents(spark), []
    for solve in (1 << 17, 8):
        monkeypatch.setattr(maxent, "SOLVE", solve, raising=False)
        for most in (1 << 21, 50):
            found.append({r.doc_id: r.score for r in maxent.score_corpus(docs, most).collect()})
    for scores in found[1:]:
        assert np.allclose([scores[k] for k in range(120)], [found[0][k] for k in range(120)], rtol=1e-5)


def test_a_slice_takes_little_memory():
    rng = np.random.default_rng(2)
    v = maxent.Vocabulary([f"w{i}" for i in range(2000)], list(range(2000, 0, -1)), 50, 2_001_050, 2001)
    codes = np.unique(rng.integers(0, 2000, 900_000) * maxent.TARGETS + rng.integers(0, 2000, 900_000))
    n = rng.integers(1, 9, len(codes))
    most = []
    for cuts in ([(0, len(codes))], maxent.slices(codes, maxent.TARGETS)):
        tracemalloc.start()
        for i, j in cuts:
            maxent.solve(v, 3, maxent.PAIR, codes[i:j], n[i:j])
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most[1] < most[0] / 3


def test_training_and_scoring_release_heaps(spark, monkeypatch):
    """What a step leaves in the executors' heaps doesn't stand beside the next one's workers."""
    calls = []
    monkeypatch.setattr(maxent, "release_heaps", calls.append, raising=False)
    maxent.score_corpus(documents(spark, 20), 10)
    assert len(calls) >= 4


def test_releasing_heaps_collects_garbage_on_executors(spark):
    def collected():
        beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans)

    before = collected()
    release_heaps(spark)  # the executor of these tests is the driver's JVM
    assert collected() > before
