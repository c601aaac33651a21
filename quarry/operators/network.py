"""Networks over corpora: forward passes, errors and learning signals.

A model is a small document; it is compiled once and travels with the task, while
records stay where they are. Batches are evaluated as matrices.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SQUASH = {
    "TANH": np.tanh,
    "BIPOLAR_SIGMOID": np.tanh,
    "LOGISTIC": lambda x: 1 / (1 + np.exp(-x)),
    "SIGMOID": lambda x: 1 / (1 + np.exp(-x)),
    "RELU": lambda x: np.maximum(x, 0),
    "LEAKY_RELU": lambda x: np.where(x > 0, x, 0.01 * x),
    "HARD_TANH": lambda x: np.clip(x, -1, 1),
    "CLIPPED": lambda x: np.clip(x, -1, 1),
    "ABSOLUTE": np.abs,
}


def _slope(squash: str | None, post: np.ndarray) -> np.ndarray:
    if squash in ("TANH", "BIPOLAR_SIGMOID"):
        return np.maximum(1 - post * post, 0)
    if squash in ("LOGISTIC", "SIGMOID"):
        return np.maximum(post * (1 - post), 0)
    if squash in ("HARD_TANH", "CLIPPED"):
        return (np.abs(post) < 1 - 1e-6).astype(float)
    if squash == "RELU":
        return (post > 0).astype(float)
    if squash == "LEAKY_RELU":
        return np.where(post > 0, 1.0, 0.01)
    return np.ones_like(post)


@dataclass
class Network:
    """Neurons in topological order behind the inputs; edges by target."""

    inputs: int
    outputs: int
    uuids: list[str]
    squashes: list[str | None]
    biases: np.ndarray
    incoming: list[tuple[np.ndarray, np.ndarray]]
    edge_of: list[np.ndarray]

    @classmethod
    def parse(cls, document: str) -> Network:
        """From JSON; an edge that doesn't go forward is an error."""
        d = json.loads(document)
        uuids = [f"input-{i}" for i in range(d["input"])] + [n["uuid"] for n in d["neurons"] if n["type"] != "input"]
        place = {u: i for i, u in enumerate(uuids)}
        neurons = [n for n in d["neurons"] if n["type"] != "input"]
        into: list[list[tuple[int, float, int]]] = [[] for _ in neurons]
        for k, edge in enumerate(d["synapses"]):
            a, b = place[edge["fromUUID"]], place[edge["toUUID"]]
            if a >= b:
                raise ValueError(f"edge {k} doesn't go forward")
            into[b - d["input"]].append((a, edge["weight"], k))
        return cls(
            d["input"], d["output"], uuids, [n.get("squash") for n in neurons], np.array([n.get("bias", 0.0) for n in neurons]),
            [(np.array([e[0] for e in es], int), np.array([e[1] for e in es], float)) for es in into], [np.array([e[2] for e in es], int) for es in into],
        )

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Activations of all nodes for a matrix of records."""
        act = np.zeros((len(x), len(self.uuids)))
        act[:, : self.inputs] = x
        for k, (sources, weights) in enumerate(self.incoming):
            pre = act[:, sources] @ weights + self.biases[k]
            act[:, self.inputs + k] = _SQUASH.get(self.squashes[k], lambda v: v)(pre)
        return act

    def backward(self, act: np.ndarray, target: np.ndarray) -> np.ndarray:
        """[W17] Blame of each neuron, from outputs back in reverse topological order."""
        blame = np.zeros_like(act)
        blame[:, -self.outputs :] = target - act[:, -self.outputs :]
        for k in range(len(self.incoming) - 1, -1, -1):
            at = self.inputs + k
            blame[:, at] *= _slope(self.squashes[k], act[:, at])
            sources, weights = self.incoming[k]
            blame[:, sources] += blame[:, [at]] * weights
        return blame


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def errors(corpus: DataFrame, models: dict[str, str]) -> DataFrame:
    """[S14, J20, A14] (model, records, mse) of every model on every record: partial sums
    by task, one small shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = {name: Network.parse(text) for name, text in models.items()}
        sums = {name: [0, 0.0] for name in nets}
        for batch in batches:
            for name, net in nets.items():
                y = _matrix(batch.column(1), net.outputs)
                out = net.forward(_matrix(batch.column(0), net.inputs))[:, -net.outputs :]
                sums[name][0] += len(y)
                sums[name][1] += float(((y - out) ** 2).mean(axis=1).sum()) if len(y) else 0.0
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s[0] for s in sums.values()]), pa.array([s[1] for s in sums.values()])], ["model", "n", "s"])

    parts = corpus.select("inputs", "outputs").mapInArrow(scan, "model string, n long, s double")
    return parts.groupBy("model").agg(F.sum("n").alias("records"), F.try_divide(F.sum("s"), F.sum("n")).alias("mse"))


def output_errors(corpus: DataFrame, model: str) -> DataFrame:
    """[A7] Mean absolute error and absolute mass of each output."""
    net = Network.parse(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(net.outputs), 0
        for batch in batches:
            y = _matrix(batch.column(1), net.outputs)
            total += np.abs(y - net.forward(_matrix(batch.column(0), net.inputs))[:, -net.outputs :]).sum(axis=0)
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(net.uuids[-net.outputs :]), pa.array([n] * net.outputs), pa.array(total)], ["uuid", "n", "mass"])

    parts = corpus.select("inputs", "outputs").mapInArrow(scan, "uuid string, n long, mass double")
    return parts.groupBy("uuid").agg(F.sum("n").alias("records"), F.sum("mass").alias("abs_error_mass"), F.try_divide(F.sum("mass"), F.sum("n")).alias("mae"))


def learning_signals(corpus: DataFrame, model: str) -> DataFrame:
    """[A13, J19] (kind, position, count, total, abs_total): blame sums of biases and edges.

    The update kernels of the original are external; these sums are this library's own
    definition: blame for biases, blame times the source's activation for edges.
    """
    net = Network.parse(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = sum(len(e) for e in net.edge_of)
        bias, edge = np.zeros((3, len(net.incoming))), np.zeros((3, edges))
        for batch in batches:
            act = net.forward(_matrix(batch.column(0), net.inputs))
            blame = net.backward(act, _matrix(batch.column(1), net.outputs))
            for k, (sources, _) in enumerate(net.incoming):
                b = blame[:, net.inputs + k]
                bias[:, k] += len(b), b.sum(), np.abs(b).sum()
                g = b[:, None] * act[:, sources]
                edge[:, net.edge_of[k]] += np.stack([np.full(len(sources), len(b)), g.sum(axis=0), np.abs(g).sum(axis=0)])
        rows = [("bias", i, *bias[:, i]) for i in range(bias.shape[1])] + [("edge", i, *edge[:, i]) for i in range(edges)]
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["kind", "position", "n", "total", "abs_total"])

    parts = corpus.select("inputs", "outputs").mapInArrow(scan, "kind string, position long, n double, total double, abs_total double")
    return parts.groupBy("kind", "position").agg(F.sum("n").cast("long").alias("count"), F.sum("total").alias("total"), F.sum("abs_total").alias("abs_total"))
