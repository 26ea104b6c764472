"""Grouping songs that sound alike into playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame

from songsift.operators.clusters import attach_predictions, best_k, sweep_k
from songsift.operators.features import standard_scale
from songsift.operators.quality import drop_missing
from songsift.schemas import SONG_CLUSTER_FEATURES
from songsift.session import settle


def song_vectors(
    songs: DataFrame, features: list[str] = SONG_CLUSTER_FEATURES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Settled songs with their scaled feature vector; only the needed columns are kept."""
    columns = list(dict.fromkeys([*keep, *features]))
    complete = drop_missing(songs.select(*columns), features)
    return standard_scale(settle(complete, "songs", spread=True), features).drop("features")


def cluster_songs(
    vectors: DataFrame, ks: range = range(2, 13), seed: int = 1, parallelism: int = 1
) -> tuple[DataFrame, DataFrame]:
    """The silhouette per k, and the songs with their cluster under the best k."""
    sweep, models = sweep_k(vectors, list(ks), seed=seed, parallelism=parallelism)
    winner = best_k(sweep).first()["k"]
    return sweep, attach_predictions(vectors, models[winner])
