"""k-means for several numbers of clusters at once, from shared passes over the points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songsift.session import settle, temporary

# The library's iterations, tolerance, and rounds and oversampling of its starting points.
MAX_ITER, TOLERANCE, INIT_STEPS, OVERSAMPLING = 20, 1e-4, 2, 2
#: Iterations on the weighted candidates among which the starting points are chosen.
LOCAL_ITER = 30

Batches = Iterator[pa.RecordBatch]


class CentersModel(Model, HasFeaturesCol, HasPredictionCol):
    """Assigns each point to its nearest centre; the first of several at the same distance."""

    def __init__(self, centers: np.ndarray, features: str, prediction: str):
        super().__init__()
        self.centers = centers
        self._set(featuresCol=features, predictionCol=prediction)

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centers)

    def setPredictionCol(self, value: str) -> CentersModel:
        return self._set(predictionCol=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        centers = self.centers

        @F.arrow_udf("int")
        def cluster(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.int32())
            return pa.array(_nearest(_matrix(x), centers)[0].astype(np.int32))

        return dataset.withColumn(self.getPredictionCol(), cluster(vector_to_array(self.getFeaturesCol())))


def fit_all(df: DataFrame, ks: list[int], features: str, seed: int) -> dict[int, np.ndarray]:
    """The centres for each k.

    Starting points are chosen as in k-means||: each of two rounds draws points by
    their squared distance from those drawn before, twice the largest k of them on
    average; the drawn ones are weighted by the points next to them, and k-means++
    chooses k of these.  Then Lloyd's iterations, up to 20 or until no centre of that
    k moves, run for all k in the same pass.  The points are written as arrays first,
    and a pass takes a batch of them at a time as a matrix, so no task holds more.
    """
    with temporary(df.sparkSession):
        points = settle(df.select(vector_to_array(features).alias("x")), "points")
        drawn = _candidates(points, max(ks), seed)
        if not len(drawn):
            raise ValueError("no points to cluster")
        weights = np.zeros(len(drawn))
        for r in points.mapInArrow(_count_nearest(drawn), "c int, n bigint").groupBy("c").agg(F.sum("n")).collect():
            weights[r[0]] = r[1]
        centers = {k: _choose(drawn, weights, k, seed) for k in ks}
        moving = set(ks)
        for _ in range(MAX_ITER):
            if not moving:
                break
            at = {k: centers[k] for k in sorted(moving)}
            parts = points.mapInArrow(_add_up(at), "k int, c int, n bigint, s array<double>")
            sums = [F.sum(F.get("s", F.lit(i))) for i in range(drawn.shape[1])]
            moved = {k: c.copy() for k, c in at.items()}
            # A row for each centre.  One without points stays where it is.
            for k, c, n, *s in parts.groupBy("k", "c").agg(F.sum("n"), *sums).collect():
                moved[k][c] = np.array(s) / n
            for k in at:
                steps = ((moved[k] - at[k]) ** 2).sum(axis=1)
                centers[k] = moved[k]
                if steps.max() <= TOLERANCE**2:
                    moving.remove(k)
    return centers


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _matrices(batches: Batches) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield _matrix(batch.column("x"))


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and half its squared distance less the point's own half square."""
    halves = np.einsum("ij,ij->i", centers, centers) / 2 - x @ centers.T
    own = halves.argmin(axis=1)
    return own, halves[np.arange(len(x)), own]


def _costs(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The squared distance of each point from the nearest centre, by differences, so equal points have 0."""
    return ((x - centers[_nearest(x, centers)[0]]) ** 2).sum(axis=1)


def _random(seed: int, step: int) -> np.random.Generator:
    """A repeated task draws the same."""
    return np.random.default_rng([seed % 2**63, step, TaskContext.get().partitionId()])


def _candidates(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """One point by chance, then in each round points by their cost."""

    def one(batches: Batches) -> Batches:
        random, best = _random(seed, 0), None
        for x in _matrices(batches):
            keys = random.random(len(x))
            i = int(keys.argmax())
            if best is None or keys[i] > best[0]:
                best = (float(keys[i]), x[i])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]])], ["key", "x"])

    first = points.mapInArrow(one, "key double, x array<double>").orderBy(F.desc("key"), "x").limit(1).collect()
    drawn = np.array([r["x"] for r in first])
    for step in range(1, INIT_STEPS + 1) if len(drawn) else ():
        total = points.mapInArrow(_cost(drawn), "cost double").agg(F.sum("cost")).first()[0]
        if not total:
            break
        more = points.mapInArrow(_by_cost(drawn, OVERSAMPLING * k / total, seed, step), "x array<double>").collect()
        if more:
            drawn = np.unique(np.vstack([drawn, [r["x"] for r in more]]), axis=0)
    return drawn


def _cost(centers: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        total = sum(_costs(x, centers).sum() for x in _matrices(batches))
        yield pa.RecordBatch.from_arrays([pa.array([float(total)])], ["cost"])

    return run


def _by_cost(centers: np.ndarray, scale: float, seed: int, step: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        random = _random(seed, step)
        for x in _matrices(batches):
            chosen = x[random.random(len(x)) < scale * _costs(x, centers)]
            if len(chosen):
                yield pa.RecordBatch.from_arrays([pa.array(list(chosen))], ["x"])

    return run


def _count_nearest(centers: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        counts = np.zeros(len(centers), np.int64)
        for x in _matrices(batches):
            counts += np.bincount(_nearest(x, centers)[0], minlength=len(centers))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centers), dtype=np.int32)), pa.array(counts)], ["c", "n"])

    return run


def _add_up(centers: dict[int, np.ndarray]) -> Callable[[Batches], Batches]:
    """Number and sum of a task's points by their nearest centre, for each k."""

    def run(batches: Batches) -> Batches:
        counts = {k: np.zeros(len(c), np.int64) for k, c in centers.items()}
        sums = {k: np.zeros(c.shape) for k, c in centers.items()}
        for x in _matrices(batches):
            for k, c in centers.items():
                own = _nearest(x, c)[0]
                counts[k] += np.bincount(own, minlength=len(c))
                sums[k] += (own == np.arange(len(c))[:, None]).astype(float) @ x
        rows = [(k, i, n, s) for k in centers for i, (n, s) in enumerate(zip(counts[k].tolist(), sums[k])) if n]
        if rows:
            k, c, n, s = map(list, zip(*rows))
            columns = [pa.array(k, pa.int32()), pa.array(c, pa.int32()), pa.array(n), pa.array(s)]
            yield pa.RecordBatch.from_arrays(columns, ["k", "c", "n", "s"])

    return run


def _choose(drawn: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` starting points from the weighted candidates: k-means++, then iterations on the candidates."""
    if len(drawn) <= k:
        return drawn
    random = np.random.default_rng([seed % 2**63, k])
    centers = drawn[[random.choice(len(drawn), p=weights / weights.sum())]]
    while len(centers) < k:
        shares = weights * ((drawn[:, None] - centers) ** 2).sum(axis=2).min(axis=1)
        if not shares.sum():
            break
        centers = np.vstack([centers, drawn[random.choice(len(drawn), p=shares / shares.sum())]])
    for _ in range(LOCAL_ITER):
        own = _nearest(drawn, centers)[0]
        moved = centers.copy()
        for c in range(len(centers)):
            here = weights * (own == c)
            if here.sum():
                moved[c] = here @ drawn / here.sum()
        if (moved == centers).all():
            break
        centers = moved
    return centers
