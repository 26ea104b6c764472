"""The random forest, grown from counted rows where many rows are equal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import (
    RandomForestClassifier,
    _ProbabilisticClassifierParams,
    _RandomForestClassifierParams,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songsift.session import settle

#: Rows for each different row from which on a forest is grown from counted rows.
WORTH_COUNTING = 4
#: Numbers in the histograms that a task holds at once.
NUMBERS_AT_ONCE = 2**22


class CountedForestModel(Model, _ProbabilisticClassifierParams, _RandomForestClassifierParams):
    """Trees as arrays: ``nodes[t]`` holds ``feature, left, child, votes`` of tree ``t``."""

    def __init__(self, edges: list[np.ndarray | None], nodes: list[tuple[np.ndarray, ...]], classes: int):
        super().__init__()
        self.edges, self.nodes, self.classes = edges, nodes, classes

    def setRawPredictionCol(self, value: str) -> CountedForestModel:
        return self._set(rawPredictionCol=value)

    def setProbabilityCol(self, value: str) -> CountedForestModel:
        return self._set(probabilityCol=value)

    def setPredictionCol(self, value: str) -> CountedForestModel:
        return self._set(predictionCol=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges, nodes, classes = self.edges, self.nodes, self.classes

        @F.arrow_udf("array<double>")
        def votes(rows: pa.Array) -> pa.Array:
            total = np.zeros((len(rows), classes))
            if len(rows):
                bins = _bins(rows.flatten().to_numpy().reshape(len(rows), -1), edges)
                for feature, left, child, share in nodes:
                    total += share[_walk(bins, feature, left, child)]
            starts = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * classes)
            return pa.ListArray.from_arrays(starts, pa.array(total.ravel()))

        found = dataset.withColumn("_v", votes(vector_to_array(self.getFeaturesCol())))
        raw, share, best = self.getRawPredictionCol(), self.getProbabilityCol(), self.getPredictionCol()
        if raw:
            found = found.withColumn(raw, array_to_vector("_v"))
        if share:
            found = found.withColumn(share, array_to_vector(F.transform("_v", lambda v: v / len(nodes))))
        if best:
            found = found.withColumn(best, (F.array_position("_v", F.array_max("_v")) - 1).cast("double"))
        return found.drop("_v")


class CountedForestClassifier(RandomForestClassifier):
    """The same forest, in time that follows the different rows.

    A tree draws each row as often as a Poisson variable of the subsampling rate
    says, and ``n`` equal rows together as often as one of ``n`` times that rate.
    So equal rows are counted, a tree draws one weight for all of them, and all
    trees grow a level at a time from histograms of the weights by node, feature,
    bin and class, which Spark brings together by tree.  Where most rows differ,
    or trees see only some of the features, this is the library's own fit.

    With ``counts`` the rows come counted already, and that column holds how often
    each occurs; the library's fit then gets each of them as often.
    """

    #: The column of a counted dataset that holds how many rows each stands for.
    counts: str | None = None

    def setCounts(self, column: str | None) -> CountedForestClassifier:
        self.counts = column
        return self

    def _fit(self, dataset: DataFrame) -> Model:
        trees, features, label = self.getNumTrees(), self.getFeaturesCol(), self.getLabelCol()
        counts = (
            trees > 1
            and self.getBootstrap()
            and self.getFeatureSubsetStrategy() == "all"
            and self.getImpurity() == "gini"
            and not (self.isSet("weightCol") or self.getMinWeightFractionPerNode())
        )
        if not counts:
            return super()._fit(self._each(dataset))
        often = F.col(self.counts) if self.counts else F.lit(1)
        rows = dataset.select(
            vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"), often.cast("long").alias("n")
        )
        counted = settle(rows.groupBy("x", "y").agg(F.sum("n").alias("n")), "counted", spread=True)
        found = counted.agg(
            F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"), F.max("y").alias("top"), F.first("x").alias("x")
        ).first()
        if not found["cells"] or found["rows"] < WORTH_COUNTING * found["cells"]:
            return super()._fit(self._each(dataset))
        attributes = dataset.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
        nominal = {a["idx"] for a in attributes.get("nominal", [])}
        edges = _edges(counted, len(found["x"]), nominal, self.getMaxBins())
        classes = found["top"] + 1
        draw = _draw(edges, self.getSubsamplingRate(), trees, self.getSeed())
        keyed = counted.withColumn("key", F.xxhash64("x", "y"))
        cells = settle(keyed.mapInArrow(draw, "bins array<int>, y int, w array<int>"), "drawn")
        nodes = self._grow(cells, edges, nominal, classes)
        return self._copyValues(CountedForestModel(edges, nodes, classes))

    def _each(self, dataset: DataFrame) -> DataFrame:
        """Each row as often as it was counted."""
        return repeated(dataset, self.counts) if self.counts else dataset

    def _grow(self, cells: DataFrame, edges: list, nominal: set[int], classes: int) -> list[tuple[np.ndarray, ...]]:
        """All trees, one level after the other; only chosen splits come to the driver."""
        trees, dims = self.getNumTrees(), len(edges)
        width = max(self.getMaxBins(), max(len(e) for e in edges)) + 1
        # For each node its feature (-1: leaf), the bins that go left, the left child (the right one follows), class weights.
        grown = [
            {"feature": [-1], "left": [np.zeros(width, bool)], "child": [0], "stats": [np.zeros(classes)]}
            for _ in range(trees)
        ]
        at_once = max(1, NUMBERS_AT_ONCE // (dims * width * classes))
        fresh = [(t, 0) for t in range(trees)]
        for level in range(self.getMaxDepth()):
            following = []
            arrays = [_arrays(g) for g in grown]
            for first in range(0, len(fresh), at_once):
                wanted: dict[int, list[int]] = {}
                for t, node in fresh[first : first + at_once]:
                    wanted.setdefault(t, []).append(node)
                add_up = _add_up(arrays, wanted, dims, width, classes)
                best = _best(dims, width, classes, nominal, self.getMinInstancesPerNode(), self.getMinInfoGain())
                sums = cells.mapInArrow(add_up, "tree int, h binary").groupBy("tree")
                splits = sums.applyInArrow(best, "tree int, place int, feature int, left binary, lo array<long>, hi array<long>")
                for r in sorted(splits.collect(), key=lambda r: (r["tree"], r["place"])):
                    own, node = grown[r["tree"]], wanted[r["tree"]][r["place"]]
                    lo, hi = np.array(r["lo"], float), np.array(r["hi"], float)
                    own["stats"][node] = lo + hi
                    if r["feature"] < 0:
                        continue
                    own["feature"][node], own["child"][node] = r["feature"], len(own["feature"])
                    own["left"][node] = np.frombuffer(r["left"], bool)
                    for side in (lo, hi):
                        if level + 1 < self.getMaxDepth() and np.count_nonzero(side) > 1:
                            following.append((r["tree"], len(own["feature"])))
                        own["feature"].append(-1)
                        own["left"].append(np.zeros(width, bool))
                        own["child"].append(0)
                        own["stats"].append(side)
            fresh = following
        return [_arrays(_pruned(g)) for g in grown]


def repeated(counted: DataFrame, counts: str) -> DataFrame:
    """The rows that a counted table stands for."""
    return counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(counts).cast("int")))).drop("_copy")


def _pruned(tree: dict) -> dict:
    """A split between two leaves of one prediction goes, as in the library's trees."""
    feature, child, stats = tree["feature"], tree["child"], tree["stats"]
    for node in reversed(range(len(feature))):
        if feature[node] >= 0:
            lo, hi = child[node], child[node] + 1
            if feature[lo] < 0 and feature[hi] < 0 and stats[lo].argmax() == stats[hi].argmax():
                feature[node] = -1
    return tree


def _arrays(tree: dict) -> tuple[np.ndarray, ...]:
    stats = np.array(tree["stats"])
    share = stats / np.maximum(stats.sum(axis=1, keepdims=True), 1)
    return np.array(tree["feature"]), np.array(tree["left"]), np.array(tree["child"]), share


def _edges(counted: DataFrame, dims: int, nominal: set[int], bins: int) -> list[np.ndarray]:
    """The upper ends of each feature's bins but the last: between all values if they are few, else quantiles.

    A category is its own bin.
    """
    values = counted.select(F.posexplode("x").alias("i", "v")).distinct()
    sizes = {r["i"]: r["count"] for r in values.groupBy("i").count().collect()}
    few = [i for i in range(dims) if i in nominal or sizes[i] <= bins]
    many = [i for i in range(dims) if i not in few]
    edges: list = [None] * dims
    if few:
        for i in few:
            edges[i] = []
        for r in values.filter(F.col("i").isin(few)).collect():
            edges[r["i"]].append(r["v"])
        for i in few:
            own = np.sort(edges[i])
            edges[i] = np.arange(own[-1]) + 0.5 if i in nominal else (own[1:] + own[:-1]) / 2
    if many:
        at = [k / bins for k in range(1, bins)]
        row = repeated(counted, "n").agg(*[F.percentile_approx(F.get("x", F.lit(i)), at, 10_000).alias(f"q{i}") for i in many]).first()
        for i in many:
            edges[i] = np.unique(row[f"q{i}"])
    return edges


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)])


def _walk(bins: np.ndarray, feature: np.ndarray, left: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The node of one tree that each row ends at."""
    node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while True:
        split = feature[node]
        inner = split >= 0
        if not inner.any():
            return node
        right = ~left[node, bins[rows, split]]
        node = np.where(inner, child[node] + right, node)


def _draw(edges: list, rate: float, trees: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bins of each different row and how often each tree draws it.

    The draws follow from the row's values, so a repeated task draws the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            bins = _bins(batch.column("x").flatten().to_numpy().reshape(rows, -1), edges)
            drawn = np.empty((rows, trees), dtype=np.int32)
            keys = batch.column("key").to_numpy().view(np.uint64).tolist()
            for i, (key, n) in enumerate(zip(keys, batch.column("n").to_pylist())):
                drawn[i] = np.random.Generator(np.random.Philox(key=[key, seed % 2**63])).poisson(rate * n, trees)
            lists = [
                pa.ListArray.from_arrays(
                    pa.array(np.arange(rows + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel().astype(np.int32))
                )
                for m in (bins, drawn)
            ]
            yield pa.RecordBatch.from_arrays([lists[0], batch.column("y"), lists[1]], ["bins", "y", "w"])

    return run


def _add_up(arrays: list, wanted: dict[int, list[int]], dims: int, width: int, classes: int):
    """A task's weights by node, feature, bin and class for the wanted nodes of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, -1)
            drawn = batch.column("w").flatten().to_numpy().reshape(batch.num_rows, -1)
            y = batch.column("y").to_numpy()
            for t, own in wanted.items():
                feature, left, child, _ = arrays[t]
                place = np.full(len(feature), -1)
                place[own] = np.arange(len(own))
                at = place[_walk(bins, feature, left, child)]
                here = np.flatnonzero((at >= 0) & (drawn[:, t] > 0))
                weight, start = drawn[here, t].astype(float), at[here] * dims
                for d in range(dims):
                    key = ((start + d) * width + bins[here, d]) * classes + y[here]
                    found = np.bincount(key, weight, len(own) * dims * width * classes)
                    sums[t] = sums[t] + found if t in sums else found
        for t, h in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([t], pa.int32()), pa.array([h.astype(np.int64).tobytes()], pa.binary())], ["tree", "h"]
            )

    return run


def _best(dims: int, width: int, classes: int, nominal: set[int], least: int, min_gain: float):
    """The best split of each wanted node of a tree; feature -1 if there is none."""

    def gini(counts: np.ndarray) -> np.ndarray:
        total = counts.sum(axis=-1)
        return 1 - (counts**2).sum(axis=-1) / np.maximum(total, 1) ** 2

    def run(parts: pa.Table) -> pa.Table:
        tree = parts.column("tree")[0].as_py()
        h = sum(np.frombuffer(part.as_buffer(), np.int64) for part in parts.column("h"))
        h = h.reshape(-1, dims, width, classes).astype(float)
        out = []
        for place, node in enumerate(h):
            whole = node[0].sum(axis=0)
            size, chosen = whole.sum(), (min_gain, -1, None, whole, np.zeros(classes))
            for d in range(dims):
                order = np.arange(width)
                if d in nominal:
                    # Categories in the order of the share of the last class, or of their impurity.
                    rank = node[d][:, 1] / np.maximum(node[d].sum(axis=1), 1) if classes == 2 else gini(node[d])
                    order = np.argsort(rank, kind="stable")
                lo = node[d][order].cumsum(axis=0)[:-1]
                hi = whole - lo
                n_lo, n_hi = lo.sum(axis=1), hi.sum(axis=1)
                gain = gini(whole) - (n_lo * gini(lo) + n_hi * gini(hi)) / max(size, 1)
                gain[(n_lo < least) | (n_hi < least)] = -1
                i = int(gain.argmax())
                if gain[i] > max(chosen[0], 1e-15):
                    left = np.zeros(width, bool)
                    left[order[: i + 1]] = True
                    chosen = (gain[i], d, left, lo[i], hi[i])
            _, d, left, lo_, hi_ = chosen
            out.append((tree, place, d, b"" if left is None else left.tobytes(), lo_.astype(int).tolist(), hi_.astype(int).tolist()))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["tree", "place", "feature", "left", "lo", "hi"]
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    return run
