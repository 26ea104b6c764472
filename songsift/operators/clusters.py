"""Clustering with k-means: fitting, choosing k, and looking into the clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from songsift.operators.features import split_bucket
from songsift.operators.kmeans import CentersModel, fit_all
from songsift.session import settle


def fit_kmeans(
    df: DataFrame,
    k: int,
    features: str = "scaledFeatures",
    seed: int = 1,
    prediction: str = "prediction",
) -> CentersModel:
    return CentersModel(fit_all(df, [k], features, seed)[k], features, prediction)


def fit_many(
    df: DataFrame,
    ks: list[int],
    features: str = "scaledFeatures",
    seed: int = 1,
    parallelism: int = 1,
) -> tuple[DataFrame, dict[int, CentersModel], dict[int, float]]:
    """``df`` with the cluster ``k<k>`` for each k, the models, and the silhouettes.

    ``df`` should be settled, since it is read more than once.  All fits take the
    same passes over the points, so ``parallelism`` changes nothing.  The clusters
    are settled here, so that no score assigns the rows again.
    """
    centers = fit_all(df, ks, features, seed)
    models = {k: CentersModel(centers[k], features, f"k{k}") for k in ks}
    assigned = df
    for model in models.values():
        assigned = model.transform(assigned)
    assigned = settle(assigned, "assigned")
    scores = silhouettes(assigned, [f"k{k}" for k in ks], features)
    return assigned, models, {k: scores[f"k{k}"] for k in ks}


def silhouette(
    df: DataFrame, features: str = "scaledFeatures", prediction: str = "prediction"
) -> float:
    """Mean silhouette with squared Euclidean distance, on the features the model saw."""
    return ClusteringEvaluator(
        featuresCol=features, predictionCol=prediction, metricName="silhouette"
    ).evaluate(df)


def _blocks(batches: Iterator[pa.RecordBatch], predictions: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each batch the points as a matrix, their squared lengths, and their clusters by prediction."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            clusters = [batch.column(p).to_numpy() for p in predictions]
            yield (x, np.einsum("ij,ij->i", x, x), *clusters)


def _add_up(predictions: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number, sum of squares and sum of the points of each cluster that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for x, xx, *clusters in _blocks(batches, predictions):
            for name, own in enumerate(clusters):
                order = np.argsort(own, kind="stable")
                found, first = np.unique(own[order], return_index=True)
                counts = np.diff(np.append(first, len(own)))
                squares, sums = np.add.reduceat(xx[order], first), np.add.reduceat(x[order], first, axis=0)
                for c, *some in zip(found.tolist(), counts.tolist(), squares, sums):
                    known = totals.get((name, c))
                    totals[name, c] = [a + b for a, b in zip(known, some)] if known else some
        if totals:
            rows = [(predictions[name], c, n, q, s) for (name, c), (n, q, s) in totals.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(v)) for v in zip(*rows)], ["name", "c", "n", "q", "s"])

    return run


def _score(predictions: list[str], clusters: dict[str, tuple[np.ndarray, ...]]):
    """The sum of the silhouettes of a task's points, for each prediction.

    Squared distances from all points of a block to all clusters are one matrix product.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, points = np.zeros(len(predictions)), 0
        for x, xx, *owners in _blocks(batches, predictions):
            points += len(x)
            for i, (name, owner) in enumerate(zip(predictions, owners)):
                numbers, n, q, s = clusters[name]
                if len(numbers) < 2:
                    continue
                sums = xx[:, None] * n + q - 2 * (x @ s.T)
                own, at = np.searchsorted(numbers, owner), np.arange(len(x))
                size = n[own]
                a = sums[at, own] / np.maximum(size - 1, 1)
                sums /= n
                sums[at, own] = np.inf
                b = sums.min(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(a < b, 1 - a / b, b / a - 1)
                # A point alone in its cluster scores 0.
                total[i] += np.where((size == 1) | (a == b), 0.0, score).sum()
        if points:
            counts = pa.array([points] * len(predictions))
            yield pa.RecordBatch.from_arrays([pa.array(predictions), counts, pa.array(total)], ["name", "n", "s"])

    return run


def silhouettes(
    df: DataFrame, predictions: list[str], features: str = "scaledFeatures"
) -> dict[str, float]:
    """The same for several clusterings of the rows at once, in two passes.

    The mean squared distance from a point to the points of a cluster follows
    from their number, their sum and their sum of squares.  So one pass adds
    these up for all clusters of all clusterings, a row for each, and the other
    scores every point by all of them.  Both take the points a batch at a time,
    as matrices.
    """
    points = df.select(
        vector_to_array(features).alias("x"), *[F.col(p).cast("int").alias(p) for p in predictions]
    )
    parts = points.mapInArrow(_add_up(predictions), "name string, c bigint, n bigint, q double, s array<double>")
    at = F.posexplode("s").alias("i", "v")
    by_place = parts.select("name", "c", at).groupBy("name", "c", "i").agg(F.sum("v").alias("v"))
    sums = by_place.groupBy("name", "c").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    sizes = parts.groupBy("name", "c").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    # A row for each cluster.
    rows = sizes.join(sums, ["name", "c"]).orderBy("name", "c").collect()
    clusters = {}
    for p in predictions:
        own = [r for r in rows if r["name"] == p]
        clusters[p] = (
            np.array([r["c"] for r in own]),
            np.array([float(r["n"]) for r in own]),
            np.array([r["q"] for r in own]),
            np.array([[v["v"] for v in r["s"]] for r in own]),
        )
    scored = points.mapInArrow(_score(predictions, clusters), "name string, n bigint, s double")
    found = scored.groupBy("name").agg((F.sum("s") / F.sum("n")).alias("mean")).collect()
    return {p: None for p in predictions} | {r["name"]: r["mean"] for r in found}


def sweep_k(
    df: DataFrame,
    ks: list[int],
    features: str = "scaledFeatures",
    seed: int = 1,
    parallelism: int = 1,
) -> tuple[DataFrame, dict[int, CentersModel]]:
    """``k, silhouette`` for each k, and the fitted models for later use."""
    _, models, scores = fit_many(df, ks, features, seed, parallelism)
    for model in models.values():
        model.setPredictionCol("prediction")
    return df.sparkSession.createDataFrame(list(scores.items()), "k int, silhouette double"), models


def best_k(sweep: DataFrame) -> DataFrame:
    """The k with the largest silhouette, the smallest one if several share it."""
    return sweep.orderBy(F.desc("silhouette"), "k").limit(1)


def cluster_centers(df: DataFrame, model: CentersModel, features: list[str]) -> DataFrame:
    """Centres as rows of ``cluster, feature, value``, in the units of the model."""
    rows = [
        (cluster, name, float(value))
        for cluster, center in enumerate(model.clusterCenters())
        for name, value in zip(features, center)
    ]
    return df.sparkSession.createDataFrame(rows, "cluster int, feature string, value double")


def attach_predictions(df: DataFrame, model: CentersModel) -> DataFrame:
    """Every row with its cluster; the model passes all other columns through."""
    return model.transform(df)


def filter_cluster(df: DataFrame, cluster: int) -> DataFrame:
    return df.filter(F.col("prediction") == cluster)


def cluster_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("prediction").agg(F.count(F.lit(1)).alias("count"))


def avg_cluster_size(df: DataFrame) -> DataFrame:
    return cluster_sizes(df).agg(F.avg("count").alias("avgPerCluster"))


def cluster_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean of each feature per cluster, in original units."""
    return df.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("count"), *[F.avg(f).alias(f"avg_{f}") for f in features]
    )


def first_members(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of every cluster in the given order.

    The limit per cluster is applied before the shuffle as well, so a task
    receives at most ``n`` rows of a cluster from each input split.
    """
    rank = F.row_number().over(W.partitionBy("prediction").orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def cluster_names(
    df: DataFrame, n: int | None = None, name: str = "artist_name", per_list: int = 10_000
) -> DataFrame:
    """The different names of every cluster: ``prediction, list, names``.

    All of them, dealt over lists like ``cluster_members``; with ``n`` the first
    ``n`` in one list.
    """
    named = df.select("prediction", name).filter(F.col(name).isNotNull()).distinct()
    if n is None:
        return cluster_members(named, name, per_list).withColumnRenamed("members", "names")
    return (
        first_members(named, n, name)
        .groupBy("prediction")
        .agg(F.array_sort(F.collect_list(name)).alias("names"))
        .select("prediction", F.lit(0).alias("list"), "names")
    )


def cluster_members(
    df: DataFrame, member: str = "artist_id", per_list: int = 10_000
) -> DataFrame:
    """All members of every cluster: ``prediction, list, members``.

    A cluster is dealt by a hash of the member over as many lists as it needs
    for about ``per_list`` members each, so no list grows with the largest
    cluster and every member is in exactly one.  The table of list numbers has
    one row per cluster.
    """
    members = df.select("prediction", member)
    lists = cluster_sizes(members).select(
        "prediction", F.ceil(F.col("count") / per_list).alias("_lists")
    )
    return (
        members.join(F.broadcast(lists), "prediction")
        .withColumn("list", (split_bucket([member], 2**31) % F.col("_lists")).cast("int"))
        .groupBy("prediction", "list")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
    )


def playlist(df: DataFrame, cluster: int, n: int, columns: list[str], *order: str) -> DataFrame:
    """The first ``n`` songs of a cluster in the given order."""
    return filter_cluster(df, cluster).orderBy(*order).limit(n).select(*columns)
