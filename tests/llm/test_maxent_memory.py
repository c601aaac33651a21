"""What a worker of operator 6 holds at once."""

import numpy as np
import pytest

from quarry.llm import maxent


def model():
    rng = np.random.default_rng(0)
    m = maxent.Model(maxent.Vocabulary([f"w{i}" for i in range(500)], list(range(500, 0, -1)), 50, 125_300, 501))
    m.previous[:600] = rng.normal(0, 1, (600, maxent.CLASSES)).astype(np.float16)
    m.skipped[:600] = rng.normal(0, 1, (600, maxent.CLASSES)).astype(np.float16)
    m.often[:, :600] = rng.integers(0, maxent.SCALES, (2, 600))
    m.codes = np.unique(rng.integers(0, 500, 2000) * maxent.TARGETS + rng.integers(0, 500, 2000))
    m.weights = np.full(len(m.codes), 0.5, np.float32)
    return m, rng.integers(0, 501, 300)


class Shared:
    """A broadcast as workers see it, which reads its value when that is asked for."""

    def __init__(self, data):
        self._path, self.data = "of a file", data

    @property
    def value(self):
        self._value = self.data
        return self._value


def test_an_unpacked_model_lets_its_bytes_go():
    m, tokens = model()
    one, two = maxent.history(tokens, np.array([0, 300]))
    scales = np.linspace(0.3, 1.2, 2 * maxent.SCALES)
    packed = m.packed()
    assert len(packed) > 6  # each array by itself
    shared = Shared(packed)
    raw = maxent.Model.unpacked("a", shared)
    assert not hasattr(shared, "_value")
    assert (raw.codes == m.codes).all() and (raw.weights == m.weights).all()
    found, rare = maxent.Model.unpacked("a", shared, scales).log10_held(tokens, one, two)
    assert len(maxent._unpacked) == 1  # the scaled model replaces the other
    m.scales = scales
    assert found == pytest.approx(m.log10(tokens, one, two), rel=1e-5)
    code = one * maxent.TARGETS + tokens
    assert rare.tolist() == np.flatnonzero(~np.isin(code, m.codes)).tolist()


def test_batches_of_texts_and_counts_are_small(spark):
    docs = spark.createDataFrame([(k, " ".join(f"v{k}x{i}" for i in range(9000)), False) for k in range(12)], "doc_id long, text string, held_out boolean")
    counts = maxent.count_words(docs.coalesce(1))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 20
    assert counts.count() == 12 * 9000 and counts.agg({"n": "sum"}).first()[0] == 12 * 9000
    maxent.encode_documents(docs, model()[0].vocabulary, 2)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 20
