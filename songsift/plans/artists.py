"""Grouping similar artists, scored against the artists known to be similar."""

from __future__ import annotations

from pyspark.sql import DataFrame

from songsift.operators.features import standard_scale
from songsift.operators.similarity import artist_features, artist_sweep, ground_truth
from songsift.schemas import ARTIST_CLUSTER_FEATURES, ARTIST_KS
from songsift.session import settle


def artist_vectors(
    songs: DataFrame, features: list[str] = ARTIST_CLUSTER_FEATURES, artists: DataFrame | None = None
) -> DataFrame:
    """Settled artists with their scaled feature vector.

    The songs are read once: what is counted and then dealt over files is the
    written table of artists.  ``artists`` is that table, if there is one.
    """
    if artists is None:
        artists = settle(artist_features(songs, features), "features")
    return standard_scale(settle(artists, "artists", spread=True), features)


def compare_artist_clusterings(
    songs: DataFrame,
    ks: list[int] = ARTIST_KS,
    seed: int = 1,
    parallelism: int = 1,
    artists: DataFrame | None = None,
) -> DataFrame:
    """Cluster size, silhouette and overlap with the known similar artists for each k.

    ``artists`` are the settled features of the artists of ``songs``, if they are there already.
    """
    truth = settle(ground_truth(songs), "truth")
    return artist_sweep(
        artist_vectors(songs, artists=artists), truth, ks, seed=seed, parallelism=parallelism
    )[0]
