"""Corpus and journal sources, networks over corpora, report."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import network, report
from quarry.sources import corpus, journal


def bins(folder, name, rows):
    (folder / name).write_bytes(np.asarray(rows, "<f4").tobytes())


def test_corpus_round_trip_over_files_and_chunks(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(5000, 3)).astype(np.float32)
    bins(tmp_path, "0.bin", data[:3000])
    bins(tmp_path, "1.bin", np.zeros((0, 3)))
    bins(tmp_path, "2.bin", data[3000:])
    df = corpus.read_corpus(spark, str(tmp_path), 2, 1)
    rows = df.orderBy("record_id").collect()
    assert [r.record_id for r in rows] == list(range(5000))
    assert np.allclose([[*r.inputs, *r.outputs] for r in rows], data)
    assert rows[2048].chunk_id == 1 and len({r.file for r in rows}) == 2
    assert corpus.read_corpus(spark, str(tmp_path), 2, 1, max_records=3100).count() == 3100
    assert corpus.prefix(df, 10).count() == 10
    assert sum(corpus.phase_sample(df, 0.05, p).count() for p in range(20)) == 5000
    listing = corpus.corpus_key(spark, str(tmp_path)).first()
    assert (listing.bytes, listing.files) == (60_000, 2)
    before = corpus.identity(str(tmp_path), 2, 1)
    assert before == corpus.identity(str(tmp_path), 2, 1) != corpus.identity(str(tmp_path), 1, 2)


def test_corpus_width_mismatch_is_an_error(tmp_path):
    (tmp_path / "0.bin").write_bytes(b"\0" * 10)
    with pytest.raises(ValueError, match="records"):
        corpus.spans(str(tmp_path), 3)


def test_corpus_write(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("float").alias("a"), F.lit(1.5).cast("float").alias("b")).repartition(3).transform(lambda d: corpus.write_corpus(d, str(tmp_path), ["a", "b"]) or d)
    assert corpus.read_corpus(spark, str(tmp_path), 1, 1).select(F.sum(F.col("inputs")[0])).first()[0] == 4950


MODEL = {
    "input": 2, "output": 1,
    "neurons": [{"type": "hidden", "uuid": "h", "bias": 0.1, "squash": "TANH"}, {"type": "output", "uuid": "o", "bias": 0.0, "squash": "IDENTITY"}],
    "synapses": [{"fromUUID": "input-0", "toUUID": "h", "weight": 0.5}, {"fromUUID": "input-1", "toUUID": "h", "weight": -0.3}, {"fromUUID": "h", "toUUID": "o", "weight": 2.0}],
}


def test_network_scores_and_learns(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 2)), rng.normal(size=(200, 1))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "inputs array<float>, outputs array<float>").repartition(3)
    x, y = x.astype(np.float32).astype(float), y.astype(np.float32).astype(float)
    hidden = np.tanh(x @ [0.5, -0.3] + 0.1)
    out = 2 * hidden
    found = network.errors(df, {"m": json.dumps(MODEL)}).first()
    assert found.records == 200 and found.mse == pytest.approx(((y[:, 0] - out) ** 2).mean())
    assert network.output_errors(df, json.dumps(MODEL)).first().mae == pytest.approx(np.abs(y[:, 0] - out).mean())
    signals = {(r.kind, r.position): r for r in network.learning_signals(df, json.dumps(MODEL)).collect()}
    error = y[:, 0] - out
    blame = error * 2.0 * (1 - hidden**2)
    assert signals["bias", 1].total == pytest.approx(error.sum()) and signals["bias", 0].total == pytest.approx(blame.sum())
    assert signals["edge", 0].total == pytest.approx((blame * x[:, 0]).sum()) and signals["edge", 2].total == pytest.approx((error * hidden).sum())
    backward = dict(MODEL, synapses=[{"fromUUID": "o", "toUUID": "h", "weight": 1.0}])
    with pytest.raises(ValueError, match="forward"):
        network.Network.parse(json.dumps(backward))


LINES = [
    {"record": "runHeader", "timestampUnix": 100, "seed": 1, "version": "1", "config": {"candidates": 3, "minImprovement": 1e-6}},
    {"experimentNumber": 1, "timestampUnix": 100, "focusNeuron": "a", "candidates": [{"strategy": "random"}, {"strategy": "backprop"}, {"strategy": "random"}], "scores": {"baseline": 1.0, "candidate-000": 1.5, "candidate-001": 0.5},
     "screenScores": {"baseline": 1.1, "candidate-000": 1.2, "candidate-001": 1.3, "candidate-002": 1.0}, "winner": "candidate-000", "improvement": 0.5, "accepted": True, "analysisMs": 10, "scorerMs": 20,
     "scorerCalls": [{"phase": "screen", "creatures": 4, "elapsedMs": 30}, {"phase": "screen", "creatures": 2, "elapsedMs": 20}, {"phase": "promote", "creatures": 3, "elapsedMs": 9}]},
    {"experimentNumber": 2, "timestampUnix": 160, "focusNeuron": "a", "focusNeurons": ["a", "b"], "candidates": [{"strategy": "random"}, {"strategy": "backprop"}], "scores": {"baseline": 1.5, "candidate-000": 1.6, "candidate-001": 1.7, "combo-000-k2": 2.0}, "winner": "combo-000-k2",
     "comboMemberIndices": [0, 1], "comboMembers": 2, "improvement": 0.5, "accepted": True, "analysisMs": 5, "scorerMs": 25, "memoHits": 3, "memoMisses": 1},
    {"experimentNumber": 3, "timestampUnix": 220, "focusNeuron": "b", "candidates": [{"strategy": "backprop"}], "scores": {}, "scorerError": "down", "accepted": False, "analysisMs": 1, "scorerMs": 2},
]


@pytest.fixture()
def lines(spark, tmp_path):
    (tmp_path / "experiments.jsonl").write_text("\n".join(json.dumps(x) for x in LINES[:2]) + "\n\n  \n" + "\n".join(json.dumps(x) for x in LINES[2:]) + "\n")
    return journal.read_lines(spark, str(tmp_path))


def test_journal_lines_and_modes(spark, lines, tmp_path):
    assert [(r.line_no, r.kind) for r in lines.orderBy("line_no").collect()] == [(1, "runHeader"), (2, None), (3, None), (4, None)]
    assert journal.headers(lines).first().config.candidates == 3
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "b.jsonl").write_text('{"record":"mystery"}\nnot json\n{"experimentNumber":9}\n')
    bad = journal.read_lines(spark, str(broken))
    assert journal.checked(bad, strict=False).count() == 1 and journal.bad_lines(bad).first().bad == 2
    with pytest.raises(Exception, match="unknown journal record"):
        journal.checked(bad).collect()
    journal.append(spark.createDataFrame([(1,)], "experimentNumber long"), str(tmp_path / "out"))
    journal.append(spark.createDataFrame([(2,)], "experimentNumber long"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_report(lines):
    rows = journal.experiments(journal.checked(lines))
    t = report.totals(rows).first()
    assert (t.experiments, t.acceptances, t.scorer_failures, t.opening_baseline) == (3, 2, 1, 1.0)
    assert (t.time_to_first_accept_ms, t.analysis_ms, t.scorer_ms, t.wall_ms) == (30, 16, 47, 120_000)
    assert (t.candidates_scored, t.screen_candidates_scored, t.combo_acceptances) == (5, 3, 1)
    assert t.total_improvement == pytest.approx(1.0) and t.memo_hit_rate == 0.75 and t.candidates_per_wall_minute == 2.5
    s = {r.strategy: (r.appearances, r.wins) for r in report.strategies(rows).collect()}
    assert s == {"random": (3, 2), "backprop": (3, 1)}
    f = {r.focus: (r.experiments, r.accepts, r.improvement) for r in report.focuses(rows).collect()}
    assert f == {"a": (2, 2, 0.75), "b": (2, 1, 0.25)}
    c = {r.phase: r for r in report.call_costs(rows).collect()}
    assert c["screen"].marginal_ms_per_creature == pytest.approx(5) and c["screen"].fixed_ms == pytest.approx(10) and c["promote"].fixed_ms is None
    pairs = {r.stem: r for r in report.screen_pairs(rows).collect()}
    assert set(pairs) == {"candidate-000", "candidate-001"} and pairs["candidate-001"].full_delta == -0.5
