"""Operator 2: toxicity by compression distance.

Two zstandard dictionaries are trained: one on all windows of the ordinary texts, one on
the words of toxic texts that have a telling byte 6-gram, eight words a sample: one in at
least 2 % (and 3) of the toxic texts, whose share of them is over 12 times that of ordinary
ones. A text is cut at spaces
into windows, or after 256 bytes without one. Each window is compressed with the ordinary dictionary, and with the toxic
one standing before it; how many bytes the toxic dictionary saves is the window's gain,
near 0 for ordinary text. Documents are compared by their greatest gains, the sum of
gains that reach the window threshold, and the number of windows; the thresholds, one
for windows and one logistic curve for documents, are calibrated on labelled documents
that trained neither of the dictionaries that judge them.

At most ``toxic_rows`` and ``ordinary_rows`` labelled texts fit the model. Every window
of every text is compressed.

Defined cases: a null or empty text has one empty window; where labels lack one of the
values, all scores are 0 or 1 after the value that exists (0 without labels); rows with
the same doc_id are separate documents; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.labelled import labelled_sample, remainder
from quarry.session import small_batches, tidy

WINDOW, LONGEST = 64, 256
GRAM, HEAD = 6, 5


def spelled(text: str | None) -> bytes:
    """The text with one space around words, their first HEAD letters large, others small:
    what begins a word then matches nothing inside words."""
    return (" " + " ".join([w[:HEAD].upper() + w[HEAD:] for w in (text or "").lower().split()]) + " ").encode()


def windows(text: str | None, size: int = WINDOW, longest: int = LONGEST) -> list[bytes]:
    """Windows of at least ``size`` bytes that begin and end at a space; where none comes
    within ``longest`` bytes, as in scripts without spaces, a window ends there."""
    data = spelled(text)
    out, at, end = [], 0, len(data) - 1
    while True:
        cut = data.find(b" ", at + size, at + max(longest, size) + 1)
        if cut < 0 and end - at > max(longest, size):
            out.append(data[at : at + max(longest, size)])
            at += max(longest, size)
            continue
        if cut < 0 or cut >= end:
            out.append(data[at:])
            return out
        out.append(data[at : cut + 1])
        at = cut


@functools.lru_cache(maxsize=4)
def compressor(dictionary: bytes):
    import zstandard as z

    settings = z.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=32, strategy=z.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=settings)


def gains(text: str | None, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Bytes that the toxic dictionary saves on each window, greatest first."""
    plain, both = compressor(ordinary).compress, compressor(toxic + ordinary).compress
    return np.sort([len(plain(w)) - len(both(w)) for w in windows(text)])[::-1]


def features(found: np.ndarray, threshold: int) -> list[float]:
    strong = found[found >= threshold]
    top = np.concatenate([found[:3], np.zeros(3)])[:3]
    return [*np.maximum(top, 0), np.log1p(strong.sum()), len(strong) / len(found), np.log(len(found)), float(np.maximum(found, 0).mean())]


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: int = 3
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    constant: float | None = 0.0

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        x = (np.array(features(gains(text, self.ordinary, self.toxic), self.threshold)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Intercept and weights by Newton's method with a ridge on the weights."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-9] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary; the samples themselves where there are too few to train one."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[str], ordinary: list[str], ordinary_bytes: int = 16_384, toxic_bytes: int = 4_096) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""

    def grams(text: str) -> set[bytes]:
        data = spelled(text)
        return {data[i : i + GRAM] for i in range(len(data) - GRAM + 1)}

    in_toxic, in_ordinary = Counter(), Counter()
    for texts, counter in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for text in texts:
            counter.update(grams(text))
    least = max(3, 0.02 * len(toxic))
    telling = {g for g, n in in_toxic.items() if n >= least and n * len(ordinary) > 12 * (in_ordinary[g] + 1) * len(toxic)}
    passages = []
    for text in toxic:
        for word in spelled(text).split():
            word = b" " + word + b" "
            if any(word[i : i + GRAM] in telling for i in range(len(word) - GRAM + 1)):
                passages.append(word)
    ordinary_windows = [w for text in ordinary for w in windows(text, 256)]
    return _trained(ordinary_bytes, ordinary_windows), _trained(toxic_bytes, [b" ".join(passages[i : i + 8]) for i in range(0, len(passages), 8)])


def fit(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Dictionaries of each half of the texts judge the other half, which calibrates the
    thresholds; the model's own dictionaries come from all texts."""
    if not toxic or not ordinary:
        return ToxicityModel(constant=1.0 if toxic else 0.0)
    found, y = [], []
    for half in (0, 1):
        pair = dictionaries(toxic[half::2] or toxic, ordinary[half::2] or ordinary)
        for texts, label in ((toxic[1 - half :: 2], 1.0), (ordinary[1 - half :: 2], 0.0)):
            found += [gains(text, *pair) for text in texts]
            y += [label] * len(texts)
    y, best = np.array(y), None
    for threshold in range(1, 9):  # the window threshold that fits the labels best
        x = np.array([features(g, threshold) for g in found])
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        w = logistic((x - mean) / scale, y)
        p = 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[1:] + w[0], -30, 30)))
        loss = -np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))
        if best is None or loss < best[0]:
            best = loss, threshold, mean.tolist(), scale.tolist(), w.tolist()
    _, threshold, mean, scale, weights = best
    return ToxicityModel(*dictionaries(toxic, ordinary), threshold, mean, scale, weights, None)


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1500, ordinary_rows: int = 3000) -> ToxicityModel:
    """Fits the model on labelled rows whose crc32 remainder by 4 isn't 2.

    The logistic curve is then shifted to the odds of all labelled rows.
    """
    texts, counts = labelled_sample(docs, labels, "toxic", 4, 2, {1: toxic_rows, 0: ordinary_rows})
    model = fit(texts[1], texts[0])
    if model.constant is None:
        model.weights[0] += float(np.log(counts[1] / counts[0]) - np.log(len(texts[1]) / len(texts[0])))
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, keep: list[str], name: str = "toxic_score") -> DataFrame:
    """The columns ``keep`` and the score as a double ``name`` for every document."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(text) for text in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.float64())], [*keep, name])

    chosen = docs.select(*keep, *([] if "text" in keep else ["text"]))
    text = chosen.columns.index("text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(tidy(score), f"{schema}, `{name}` double")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"))
