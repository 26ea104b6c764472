"""The multilayer perceptron, trained from counted rows where many rows are equal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songsift.operators.forest import WORTH_COUNTING
from songsift.session import settle

# The steps that L-BFGS remembers, and the halvings of a step before it gives up.
MEMORY, HALVINGS = 10, 20


class CountedPerceptronClassifier(MultilayerPerceptronClassifier):
    """The same network and loss, in time that follows the different rows.

    Equal rows are counted, and each different row weighs as much as it occurs.
    L-BFGS runs on the driver, on the few weights of the network; Spark adds up loss
    and gradient.  The found weights are handed to the library, whose model scores.
    Where most rows differ, or with another solver, this is the library's own fit.
    """

    def _fit(self, dataset: DataFrame) -> Model:
        if self.getSolver() != "l-bfgs":
            return super()._fit(dataset)
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y")
        )
        counted = settle(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "counted", spread=True)
        found = counted.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows")).first()
        if not found["cells"] or found["rows"] < WORTH_COUNTING * found["cells"]:
            return super()._fit(dataset)
        layers = self.getLayers()

        def loss(weights: np.ndarray) -> tuple[float, np.ndarray]:
            parts = counted.mapInArrow(_gradient(layers, weights), "g array<double>")
            sums = parts.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
            whole = np.array([r["v"] for r in sorted(sums.collect(), key=lambda r: r["i"])]) / found["rows"]
            return whole[0], whole[1:]

        given = self.getInitialWeights() if self.isSet("initialWeights") else None
        start = _start(layers, self.getSeed()) if given is None else given.toArray()
        weights = minimize(loss, start, self.getMaxIter(), self.getTol())
        # No iteration: the library makes its model of the given weights.
        ready = self.copy().setInitialWeights(Vectors.dense(weights)).setMaxIter(0)
        return MultilayerPerceptronClassifier._fit(ready, dataset.limit(1))


def _start(layers: list[int], seed: int) -> np.ndarray:
    random = np.random.default_rng(seed % 2**63)
    return np.concatenate([random.uniform(-2.4, 2.4, (a + 1) * b) / a for a, b in zip(layers, layers[1:])])


def _unpacked(layers: list[int], weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The matrix, by columns as the library keeps it, and the offsets of each layer."""
    parts, at = [], 0
    for a, b in zip(layers, layers[1:]):
        parts.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return parts


def _gradient(layers: list[int], weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The loss of a task's rows and its gradient, in one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, parts = np.zeros(1 + len(weights)), _unpacked(layers, weights)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            y, n = batch.column("y").to_numpy(), batch.column("n").to_numpy().astype(float)
            outputs = [x]
            for i, (matrix, offset) in enumerate(parts):
                z = outputs[-1] @ matrix + offset
                if i + 1 < len(parts):
                    outputs.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            z -= z.max(axis=1, keepdims=True)
            logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            at = np.arange(len(y))
            total[0] -= n @ logs[at, y]
            delta = np.exp(logs)
            delta[at, y] -= 1
            delta *= n[:, None]
            found = []
            for i in reversed(range(len(parts))):
                found += [delta.sum(axis=0), (outputs[i].T @ delta).ravel()]
                if i:
                    delta = delta @ parts[i][0].T * outputs[i] * (1 - outputs[i])
            total[1:] += np.concatenate(found[::-1])
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["g"])

    return run


def minimize(
    loss: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, max_iter: int, tol: float
) -> np.ndarray:
    """L-BFGS with steps halved until the loss falls enough."""
    value, slope = loss(at)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        direction, factors = -slope, []
        for s, y in reversed(pairs):
            factors.append(s @ direction / (s @ y))
            direction = direction - factors[-1] * y
        if pairs:
            s, y = pairs[-1]
            direction = direction * (s @ y / (y @ y))
        for (s, y), factor in zip(pairs, reversed(factors)):
            direction = direction + (factor - y @ direction / (s @ y)) * s
        fall = slope @ direction
        if fall >= 0:
            direction, fall, pairs = -slope, -(slope @ slope), []
        step = 1.0 if pairs else 1 / max(np.linalg.norm(direction), 1e-300)
        for _ in range(HALVINGS):
            there = at + step * direction
            new, new_slope = loss(there)
            if new <= value + 1e-4 * step * fall:
                break
            step /= 2
        else:
            break
        s, y = there - at, new_slope - slope
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-MEMORY:]
        done = value - new <= tol * max(abs(value), abs(new), 1e-6)
        at, value, slope = there, new, new_slope
        if done:
            break
    return at
