"""Arms, evidence, cache and document of journals, by hand."""

import json

import pytest

from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.functions.scalars import duration_label, merge_sum
from quarry.operators import economics as e
from quarry.sources import journal

PROBE, NEAR, ROOT = {"followUp": {"parentExperiment": 1, "parentWinner": "candidate-000"}}, {"neighbourhood": {"role": "successor"}}, {"neighbourhood": {"role": "root"}}
FIRST = [
    {"experimentNumber": 1, "timestampUnix": 100, "focusNeuron": "a", "focusNeurons": [], "candidates": [{"strategy": "x"}, {"strategy": "y", **ROOT}], "scores": {"baseline": 1.0, "candidate-001": 1.5}, "screenScores": {"baseline": 1.0, "candidate-000": 0.5, "candidate-001": 1.5},
     "winner": "candidate-001", "improvement": 0.5, "accepted": True, "analysisMs": 100, "scorerMs": 300, "scorerCalls": [{"phase": "screen", "elapsedMs": 200}, {"phase": "promote", "elapsedMs": 90}, {"phase": "phase0", "elapsedMs": 9}],
     "neighbourhood": {"rootFocus": "a", "members": ["b", "c"]}, "baselineSource": "fresh", "candidatesRequested": 4, "cacheSkipped": 2, "cacheDeduplicated": 1, "cacheSize": 9, "cacheSavedMs": 8.0, "cacheLookupMs": 3, "cacheRebuildMs": 10,
     "strategyAllocation": {"slots": {"x": 3, "silent": 2}}},
    {"experimentNumber": 2, "timestampUnix": 160, "focusNeuron": "b", "candidates": [{"strategy": "x", **PROBE}, {"strategy": "x", **NEAR}, {"strategy": "y"}], "scores": {"baseline": 1.5}, "winner": "combo-1", "comboMemberIndices": [0, 1], "improvement": 0.25, "accepted": True,
     "analysisMs": 0, "scorerMs": 300, "followUp": {"parentExperiment": 1, "parentWinner": "candidate-001"}, "baselineSource": "rememberedVerified", "candidatesRequested": 4, "batchLimit": "exhausted"},
    {"record": "graftReplay", "graftsApplied": 3, "accepted": True, "improvement": 0.125, "scorerFailures": 1},
]
SECOND = [
    {"experimentNumber": 1, "timestampUnix": 200, "focusNeuron": "a", "candidates": [{"strategy": "x"}], "scores": {}, "winner": "candidate-007", "improvement": 1.0, "accepted": True, "analysisMs": 10, "scorerMs": 10,
     "followUp": {"parentExperiment": 1, "parentWinner": "candidate-001"}, "baselineSource": "remembered", "candidatesRequested": 5, "focusStats": {"incomingCount": 4, "meanBlame": -2, "squash": "TANH"}},
    {"experimentNumber": 2, "timestampUnix": 260, "focusNeuron": "a", "accepted": False, "analysisMs": 5, "scorerMs": 5, "focusStats": {"incomingCount": 2}},
]


@pytest.fixture()
def folder(tmp_path):
    for name, rows in (("a.jsonl", FIRST), ("b.jsonl", SECOND)):
        (tmp_path / name).write_text("\n".join(json.dumps(x) for x in rows))
    return str(tmp_path)


@pytest.fixture()
def rows(spark, folder):
    return journal.experiments(journal.checked(journal.read_lines(spark, folder)))


def test_arms(rows):
    f = e.follow_up_arms(rows).first()
    assert (f.bursts, f.burst_experiments, f.followup_candidates, f.ordinary_candidates) == (2, 2, 1, 5)
    assert (f.followup_accepts, f.ordinary_accepts, f.mixed_accepts, f.unattributed_accepts) == (0, 1, 1, 1)
    assert f.followup_ms == pytest.approx(100) and f.ordinary_ms == pytest.approx(620) and f.followup_gain_per_hour == 0
    n = e.neighbourhood_arms(rows).first()
    assert (n.expansions, n.roots, n.members) == (1, 1, 2)
    assert (n.neighbourhood_candidates, n.isolated_candidates, n.excluded_candidates) == (1, 4, 1)
    assert (n.isolated_accepts, n.excluded_accepts, n.mixed_accepts, n.root_accepts, n.adjacent_accepts, n.unattributed_accepts) == (1, 1, 0, 1, 0, 1)


def test_evidence_and_allocation(spark, rows):
    total = {(r.file[-7:], r.strategy): r for r in e.evidence(rows).collect()}
    x, y = total["a.jsonl", "x"], total["a.jsonl", "y"]
    assert (x.trials, x.promotions, x.accepts, x.score_gain) == (3, 0, 2, 0.25) and x.cost_ms == pytest.approx(100 + 200)
    assert (y.trials, y.promotions, y.accepts, y.score_gain) == (2, 1, 1, 0.5) and y.cost_ms == pytest.approx(100 + 90 + 100)
    late = {(r.file[-7:], r.strategy): r for r in e.evidence(rows, 0.5, 0.25).collect()}
    assert late["a.jsonl", "y"].trials == pytest.approx(0.5 * 0.0625 + 0.25)
    assert late["b.jsonl", "x"].trials == pytest.approx(0.5 * 0.25)  # an experiment without candidates decays, too
    prior = spark.createDataFrame([(r.file, "x", 10.0, 0.0, 0.0, 0.0, 0.0) for r in rows.select("file").distinct().collect()], "file string, strategy string, trials double, promotions double, accepts double, score_gain double, cost_ms double")
    report = {(r.file[-7:], r.strategy): r for r in e.allocation_report(rows, 0.5, 0.25, prior).collect()}
    assert (report["a.jsonl", "silent"].allocated_slots, report["a.jsonl", "silent"].trials) == (2, 0)
    left = 10 * 0.25 * 0.0625
    assert report["a.jsonl", "x"].prior_share == pytest.approx(left / (left + late["a.jsonl", "x"].trials)) and report["a.jsonl", "x"].prior_trials == 10


def test_cache_baselines_batches_and_focuses(rows):
    c = e.cache_report(rows).first()
    assert (c.experiments_with_cache, c.proposals_examined, c.cache_hits, c.final_cache_size, c.spent_ms, c.net_ms) == (1, 5, 2, 9, 13.0, -5.0)
    b = e.baseline_reuse(rows).first()
    assert (b.fresh_promote_calls, b.remembered_promote_calls, b.verified_accepts, b.net_creature_scores_saved) == (1, 2, 1, 0)
    n = e.candidate_batches(rows).first()
    assert (n.min_generated, n.max_generated, n.requested, n.exhausted_experiments) == (0, 3, None, 1)
    f = {r.bucket: r for r in e.focus_buckets(rows).collect()}
    assert f["all"].squash_counts == {"TANH": 1, "unknown": 1} and f["accepted"].mean_abs_blame == 2 and f["rejected"].mean_abs_blame is None


def test_document_and_command_line(spark, folder, capsys):
    main(["report", folder])
    found = json.loads(capsys.readouterr().out)
    assert found["graftReplay"]["grafts_applied"] == 3 and found["totals"]["experiments"] == 4 and found["totals"]["net_creature_scores_saved"] == 0
    assert [s["strategy"] for s in found["strategies"]] == ["x", "y"] and found["cache"]["cache_hits"] == 2


def test_empty_journal(rows):
    none = rows.limit(0)
    assert e.follow_up_arms(none).first().bursts == 0 and e.cache_report(none).first().net_ms is None
    assert e.evidence(none, 0.9, 0.25).count() == e.allocation_report(none).count() == e.focus_buckets(none).count() == 0


def test_durations_and_maps(spark):
    rows = spark.createDataFrame([(999, {"a": 1, "b": 2}, {"b": 3}), (61_500, None, {"b": 3}), (None, {"a": 1}, None)], "ms long, x map<string,int>, y map<string,int>")
    got = rows.select(duration_label(F.col("ms")).alias("label"), merge_sum(F.col("x"), F.col("y")).alias("m")).collect()
    assert [(r.label, r.m) for r in got] == [("999ms", {"a": 1, "b": 5}), ("61.5s", {"b": 3}), (None, {"a": 1})]
