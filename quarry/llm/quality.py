"""Operator 10: document quality by attention-based multiple-instance learning.

A document is a bag of passages of about ``PASSAGE`` bytes, cut at white space. Each
passage becomes a vector of its byte histogram and of how its words repeat; a dense tanh
layer encodes it. Gated attention, softmax over the document of w . (tanh(Vh) *
sigmoid(Uh)), weighs the encodings; a logistic layer scores their weighted mean. All
layers are learnt together by Adam, in numpy, from document labels alone.

At most ``rows`` labelled documents of each value fit the model; every passage of every
text is scored.

Defined cases: a null or empty text is one empty passage; where labels lack one of the
values, all scores are 0 or 1 after the value that exists (1 without labels, so that
nothing is rejected); rows with the same doc_id are separate documents; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.labelled import labelled_sample, remainder
from quarry.session import small_batches, tidy

PASSAGE = 1024


def passages(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    out, at = [], 0
    while len(data) - at > PASSAGE * 3 // 2:
        cut = max(data.rfind(b" ", at + PASSAGE // 2, at + PASSAGE), data.rfind(b"\n", at + PASSAGE // 2, at + PASSAGE))
        cut = at + PASSAGE if cut < 0 else cut
        out.append(data[at:cut])
        at = cut
    out.append(data[at:])
    return out


def describe(passage: bytes) -> np.ndarray:
    """Square roots of byte shares, and how words and pairs of words repeat."""
    histogram = np.bincount(np.frombuffer(passage, np.uint8), minlength=256)
    words = passage.split()
    n = max(len(words), 1)
    pairs = len(set(zip(words, words[1:]))) / max(n - 1, 1)
    upper = histogram[65:91].sum() / max(histogram[97:123].sum() + histogram[65:91].sum(), 1)
    marks = histogram[33:48].sum() + histogram[58:65].sum() + histogram[91:97].sum() + histogram[123:127].sum()
    more = [len(set(words)) / n, pairs, len(passage) / n / 10, upper, marks / n, histogram[48:58].sum() / n, np.log1p(len(words)), histogram[10] / n]
    return np.concatenate([np.sqrt(histogram / max(len(passage), 1)), more])


WIDTH = 256 + 8


class MilModel:
    """Encoder, gated attention and output layer; ``constant`` stands for a model without labels."""

    def __init__(self, constant: float | None = None, hidden: int = 24, gate: int = 12, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.constant = constant
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {
            "W": rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)),
            "b": np.zeros(hidden),
            "V": rng.normal(0, hidden**-0.5, (hidden, gate)),
            "U": rng.normal(0, hidden**-0.5, (hidden, gate)),
            "w": rng.normal(0, gate**-0.5, gate),
            "c": rng.normal(0, hidden**-0.5, hidden),
            "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray):
        p, sizes = self.p, np.diff(np.append(starts, len(x)))
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        e = (t * s) @ p["w"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        logit = z @ p["c"] + p["d"][0]
        return h, t, s, a, z, logit, sizes

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.forward(x, starts)[5], -30, 30)))

    def gradients(self, x, starts, y) -> dict[str, np.ndarray]:
        p = self.p
        h, t, s, a, z, logit, sizes = self.forward(x, starts)
        g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        dz = np.repeat(g[:, None] * p["c"], sizes, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
        dpre = dh * (1 - h * h)
        scaled = (x - self.mean) / self.scale
        return {"W": scaled.T @ dpre, "b": dpre.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g, "d": np.array([g.sum()])}


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of all texts, and where each text's begin."""
    cut = [passages(text) for text in texts]
    starts = np.cumsum([0, *map(len, cut)])[:-1]
    return np.array([describe(x) for c in cut for x in c]), starts


def fit(good: list[str], bad: list[str], epochs: int = 30, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 10) -> MilModel:
    if not good or not bad:
        return MilModel(constant=0.0 if bad else 1.0)
    model = MilModel(seed=seed)
    rng = np.random.default_rng(seed)
    y = np.array([1.0] * len(good) + [0.0] * len(bad))
    x, starts = bags(good + bad)
    ends = np.append(starts[1:], len(x))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 0.02
    first, second, step = {}, {}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            part = np.concatenate([x[starts[r] : ends[r]] for r in rows])
            begin = np.cumsum([0, *(ends[r] - starts[r] for r in rows)])[:-1]
            step += 1
            for name, g in model.gradients(part, begin, y[rows]).items():
                g = g + decay * model.p[name]
                first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                second[name] = 0.999 * second.get(name, 0) + 0.001 * g * g
                size = rate * (1 - epoch / epochs)
                model.p[name] -= size * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = 2500) -> MilModel:
    """Fits the model on labelled rows whose crc32 remainder by 3 isn't 1."""
    texts, _ = labelled_sample(docs, labels, "quality", 3, 1, {1: rows, 0: rows})
    return fit(texts[1], texts[0])


def score_documents(docs: DataFrame, model: MilModel, keep: list[str], name: str = "quality_score") -> DataFrame:
    """The columns ``keep`` and the score as a double ``name`` for every document."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = []
            for at in range(0, len(texts), 100):
                x, starts = bags(texts[at : at + 100])
                found.append(model.scores(x, starts))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(found) if found else [], pa.float64())], [*keep, name])

    chosen = docs.select(*keep, *([] if "text" in keep else ["text"]))
    text = chosen.columns.index("text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(tidy(score), f"{schema}, `{name}` double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
