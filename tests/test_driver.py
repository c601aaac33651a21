"""Driver-side state."""

import pytest

from quarry.operators import driver as d


def test_remembered_baseline_and_memo():
    b = d.RememberedBaseline(interval=2, epsilon=0.1)
    assert b.serve(("k",)) is None
    b.store(("k",), 1.0)
    assert [b.serve(("k",)), b.serve(("k",)), b.serve(("k",)), b.serve(("x",))] == [1.0, 1.0, None, None]
    assert b.verify(("k",), 1.05) and not b.verify(("k",), 2.0)
    m = d.AnalysisMemo(2)
    assert [m.get(k, lambda k=k: k * 2) for k in (1, 2, 1, 3, 2)] == [2, 4, 2, 6, 4] and (m.hits, m.misses) == (1, 4)


def test_timings_store_and_stale(tmp_path):
    t = d.CallTimings()
    with pytest.raises(RuntimeError), t.call("screen", 3, 0.05):
        raise RuntimeError
    with t.call("promote", 1):
        pass
    assert [(r["phase"], r["failed"]) for r in t.rows] == [("screen", True), ("promote", False)]
    store = d.JsonStore(str(tmp_path / "g.json"), "2.1")
    assert store.load() is None
    store.save({"grafts": [1]})
    assert store.load()["grafts"] == [1]
    with pytest.raises(ValueError):
        d.JsonStore(str(tmp_path / "g.json"), "3.0").load()
    assert d.stale_reasons({"mode": "quick"}, {"mode": "full"}) and not d.stale_reasons({"mode": "full"}, {"mode": "full"})


def test_selection_and_refill():
    neurons = [{"uuid": "a", "saturation": 0.9, "signal": 5.0, "weight": 1}, {"uuid": "b", "signal": 5.0, "weight": 1}]
    assert d.select_focus("high-error", neurons) == "b" and d.select_focus("unsaturated", neurons) == "b" and d.select_focus("fixed", neurons, ["a"]) == "b"
    assert d.select_focus("random", neurons, ["a", "b"]) is None and d.select_focus("weighted", neurons, seed=3) in "ab"
    assert d.sparse_selection([(0, 1), (1, 2), (3, 4)], [0], 1.0, 1) == {0, 1, 2}
    assert [a for a, _ in d.refill([("x", 1), ("x", 2), ("y", 3)], {"x": 2, "y": 0}, {"x": 2, "y": 1}, 2)] == ["y", "x"]


def test_proposals_combinations_grafts_and_axes():
    rows = d.propose({"value": 1.0, "weight": 2.0, "mean_error": 0.5}, ["structural_weaken", "mean_error_bias", "stats_weight"], [1.0, 0.5])
    assert [r["new_value"] for r in rows] == [0.0, 1.5, 0.5, 1.25]
    scores = {"baseline": 1.0, "candidate-000": 1.2, "candidate-001": 1.1, "candidate-002": 0.9}
    assert d.select_with_combinations(1.0, scores, lambda stems: 1.5)[2] == ["candidate-000", "candidate-001"]
    assert d.select_with_combinations(1.0, scores, lambda stems: None)[0] == "candidate-000" and d.select_with_combinations(2.0, scores, lambda s: 9.0) is None
    graft = {"requires": ["a", "b"], "synapses": [{"from": "a", "to": "b", "weight": 0.1}, {"from": "x", "to": "b", "weight": 5.0}]}
    assert d.apply_graft({("x", "b"): 1.0}, {"a", "b", "x"}, graft) == {("a", "b"): 0.1, ("x", "b"): 1.0}
    with pytest.raises(ValueError):
        d.apply_graft({}, {"a"}, graft)
    shape = d.diagnose_axes(lambda w: w[0] ** 2 + 1, [0.0, 0.0])
    assert shape[1]["plus"] == shape[1]["base"] and shape[0]["plus"] == pytest.approx(1.0001)
