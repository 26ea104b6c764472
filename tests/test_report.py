import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from songsift.operators.quality import describe_columns
from songsift.plans.growth import add_part, report_of_parts
from songsift.plans.popularity import artists_per_country, popular_terms, songs_per_country
from songsift.plans.report import artists_report, counts_report, genres_report, playlists_report
from songsift.schemas import CATALOGUE
from tests.conftest import song

GENRES = ["rock", "pop", "electronic", "jazz", "folk"]


def catalogue_of(spark, n):
    data = [
        song(
            song_id=f"S{i}",
            title=f"T{i}",
            artist_id=f"A{i % 120}",
            artist_name=f"N{i % 120}",
            artist_terms=[GENRES[i % 5], "seen live"],
            tempo=60.0 + 30 * (i % 5) + i % 7,
            duration=100.0 + i % 11,
            loudness=-5.0 * (i % 5) - 1,
            year=1990 + i % 7,
            key=i % 12,
            time_signature=3 + i % 2,
            similar_artists=[f"A{(i + 5) % 120}"],
        )
        for i in range(n)
    ]
    return spark.createDataFrame(data, CATALOGUE)


def test_reports_answer_every_question(spark):
    songs = catalogue_of(spark, 600)
    answers = {
        **counts_report(songs, "artist_location"),
        **genres_report(songs, trees=3, max_iter=5, folds=2, parallelism=2),
        **playlists_report(songs, range(3, 5), parallelism=2),
        **artists_report(songs, [3, 5], parallelism=2),
    }
    sizes = {name: answer.count() for name, answer in answers.items()}
    assert sizes == {
        "songs_per_year": 7,
        "songs_per_country": 1,
        "artists_per_country": 1,
        "popular_terms": 6,
        "sound_of_popular_terms": 6,
        "classifiers": 3,
        "forest_folds": 1,
        "forest_params": sizes["forest_params"],
        "silhouettes": 2,
        "cluster_means": sizes["cluster_means"],
        "playlist_0": 20,
        "playlist_2": 20,
        "artist_clusterings": 2,
    }
    assert sizes["cluster_means"] in (3, 4) and sizes["forest_params"] > 5
    assert answers["artists_per_country"].first()["count"] == 120


def test_countries_are_those_of_the_ingest(spark):
    songs = catalogue_of(spark, 10)
    with pytest.raises(ValueError, match="artist_country"):
        songs_per_country(songs)
    with_country = songs.withColumn("artist_country", F.lit("X"))
    assert songs_per_country(with_country).columns == ["artist_country", "count"]


def test_command_needs_two_arguments():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run(
        [sys.executable, "-m", "songsift"], cwd=root, capture_output=True, text=True, timeout=120
    )
    assert done.returncode != 0 and "python -m songsift" in done.stderr


def test_parts_answer_like_the_whole(spark, tmp_path):
    songs, path = catalogue_of(spark, 600), str(tmp_path / "states")
    half = F.substring("song_id", 2, 9).cast("int") < 200
    add_part(songs, path, "one", "artist_location")
    add_part(songs.filter(half), path, "one", "artist_location")
    add_part(songs.filter(~half), path, "two", "artist_location")
    answers = report_of_parts(spark, path, songs, 3)
    exact = {r["column"]: r for r in describe_columns(songs, ["tempo", "year", "duration"]).collect()}
    found = {r["column"]: r for r in answers["profile"].collect()}
    for name, row in exact.items():
        for measure in ("count", "mean", "std", "min", "max"):
            assert found[name][measure] == pytest.approx(row[measure]), (name, measure)
    assert answers["artists_per_country"].collect() == artists_per_country(songs, "artist_location").collect()
    assert answers["popular_terms"].collect() == popular_terms(songs).limit(3).collect()


def test_grid_of_the_report(spark, monkeypatch):
    """Asked for, the whole documented grid is run."""
    seen = {}

    def search(train, **options):
        seen.update(options)
        return spark.createDataFrame([(5, 16, 50, 480, 0.4), (5, 32, 50, 480, 0.5)], "max_depth int, max_bins int, trees int, rows bigint, accuracy double")

    monkeypatch.setattr("songsift.plans.report.grid_search", search)
    answers = genres_report(catalogue_of(spark, 300), trees=2, max_iter=2, folds=4, grid=True)
    assert seen == {"folds": 4, "parallelism": 1}
    assert answers["forest_folds"].count() == 2 and answers["forest_params"].first()["max_bins"] == 32
