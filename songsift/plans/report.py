"""All questions about one catalogue at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from songsift.operators.classify import (
    best_of_grid,
    best_params,
    cross_validate,
    fold_metrics,
    grid_search,
    random_forest,
)
from songsift.operators.clusters import cluster_profile, playlist
from songsift.plans.artists import compare_artist_clusterings
from songsift.plans.genres import compare_classifiers, training_split
from songsift.plans.playlists import cluster_songs, song_vectors
from songsift.plans.popularity import (
    artists_per_country,
    popular_terms,
    songs_per_country,
    songs_per_year,
    sound_of_popular_terms,
)
from songsift.schemas import ARTIST_KS, GENRES, SONG_CLUSTER_FEATURES

# What a playlist shows, and below the clusters and songs listed.
_SHOWN = ["artist_name", "title", "duration", "tempo", "artist_genre"]


def counts_report(songs: DataFrame, country: str | None = None) -> dict[str, DataFrame]:
    """Songs per year and country, artists per country, terms, and how the top terms sound.

    ``country`` names the column with countries, ``artist_country`` by default.
    """
    return {
        "songs_per_year": songs_per_year(songs),
        "songs_per_country": songs_per_country(songs, country),
        "artists_per_country": artists_per_country(songs, country),
        "popular_terms": popular_terms(songs),
        "sound_of_popular_terms": sound_of_popular_terms(songs),
    }


def genres_report(
    songs: DataFrame,
    vocabulary: list[str] = GENRES,
    trees: int = 200,
    max_iter: int = 50,
    folds: int = 5,
    parallelism: int = 1,
    grid: bool = False,
    durations: tuple[float, float] | None = None,
) -> dict[str, DataFrame]:
    """Accuracy of the classifiers, and of the forest over the folds.

    With ``grid`` the folds are run for all 27 settings of ``grid_search``;
    ``durations`` are the bounds beyond which a song is an outlier.
    """
    train, test = training_split(songs, vocabulary, durations=durations)
    comparison, _ = compare_classifiers(train, test, trees, max_iter)
    if grid:
        table = grid_search(train, folds=folds, parallelism=parallelism)
        return {
            "classifiers": comparison,
            "forest_folds": table,
            "forest_params": best_of_grid(table),
        }
    validated = cross_validate(train, random_forest(trees=trees), folds=folds, parallelism=parallelism)
    return {
        "classifiers": comparison,
        "forest_folds": fold_metrics(train, validated),
        "forest_params": best_params(train, validated),
    }


def playlists_report(
    songs: DataFrame,
    ks: range = range(2, 13),
    clusters: tuple[int, ...] = (0, 2),
    length: int = 20,
    parallelism: int = 1,
) -> dict[str, DataFrame]:
    """Silhouette per k, the clusters' mean features, and the first songs of some clusters."""
    shown = [c for c in _SHOWN if c in songs.columns]
    keep = tuple(dict.fromkeys(["song_id", *shown]))
    sweep, clustered = cluster_songs(song_vectors(songs, keep=keep), ks, parallelism=parallelism)
    order = ["song_id", *[c for c in shown if c != "artist_genre"]]
    return {
        "silhouettes": sweep,
        "cluster_means": cluster_profile(clustered, SONG_CLUSTER_FEATURES),
        **{f"playlist_{c}": playlist(clustered, c, length, shown, *order) for c in clusters},
    }


def artists_report(
    songs: DataFrame, ks: list[int] = ARTIST_KS, parallelism: int = 1
) -> dict[str, DataFrame]:
    """How well clusters of artists match the artists known to be similar."""
    return {"artist_clusterings": compare_artist_clusterings(songs, ks, parallelism=parallelism)}
