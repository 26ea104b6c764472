import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from songsift.functions.lists import parse_list
from songsift.operators.similarity import (
    artist_features,
    artist_sweep,
    cluster_peers,
    evaluate_clusters,
    ground_truth,
    overlap_summary,
    peers_of,
    score_overlap,
)
from songsift.operators.clusters import silhouette
from songsift.plans.artists import artist_vectors, compare_artist_clusterings
from songsift.schemas import CATALOGUE
from tests.conftest import rows, song


def test_artist_features(songs):
    artists = {r["artist_id"]: r for r in artist_features(songs.fillna(0.0, "energy").na.replace(float("nan"), 0.0)).collect()}
    assert artists["A2"]["artist_name"] == "Bob"  # the smallest of two names
    assert artists["A2"]["nbSong"] == 2 and artists["A2"]["yearFirstSong"] is None
    assert artists["A3"]["yearFirstSong"] == 1999 and artists["A3"]["yearLastSong"] == 2000
    assert artists["A1"]["avgSongLoudness"] == artists["A1"]["avgLoudness"]
    # S06 has no loudness: the mean is over the other five songs.
    assert artists["A1"]["nbSong"] == 6
    assert artists["A1"]["avgLoudness"] == pytest.approx((-0.5 - 10 * 3 - 60) / 5)
    assert artists["A1"]["avgSongDuration"] == pytest.approx((2.5 + 200 * 4 + 1) / 6)


def test_artists_with_missing_features_are_dropped(spark):
    df = spark.createDataFrame(
        [song(), song(artist_id="A2", energy=None), song(artist_id="A3", tempo=float("nan"))], CATALOGUE
    )
    assert rows(artist_features(df), "artist_id") == [("A1",)]
    assert artist_features(df, None).count() == 3


def test_ground_truth_has_one_list_per_artist(spark):
    df = spark.createDataFrame(
        [
            ("A", 1, "['Y', \"Z\"]"), ("A", 2, "['Y', \"Z\"]"), ("B", 3, None), ("C", 4, "[]"),
            ("D", 6, "['a']"), ("D", 5, "['b']"), ("D", 1, "[]"), ("E", 1, "['z']"), ("E", 1, "['y']"),
        ],
        "artist_id string, song_id int, similar_artists string",
    )
    wanted = [("A", ["Y", "Z"]), ("D", ["b"]), ("E", ["y"])]
    assert rows(ground_truth(df)) == wanted
    typed = df.withColumn("similar_artists", parse_list(F.col("similar_artists")))
    assert rows(ground_truth(typed)) == wanted


def scored_by_lists(truth, clusters):
    """The same score from whole member lists."""
    scores = {}
    for artist, similar in truth.items():
        if artist in clusters:
            peers = {a for a, c in clusters.items() if c == clusters[artist] and a != artist}
            scores[artist] = 100.0 * len(set(similar) & peers) / max(len(similar), 1)
    return scores


def test_overlap_equals_the_list_form(spark):
    rng = random.Random(5)
    ids = [f"A{i}" for i in range(80)]
    clusters = {a: rng.choice([0, 0, 0, 1, 2, 3]) for a in ids[:70]}
    clusters["A69"] = 77  # alone in its cluster
    # A0 is in every list; some lists hold the artist itself, unknown ids or duplicates.
    truth = {a: ["A0", a, "nobody", *rng.choices(ids, k=rng.randint(0, 8))] for a in ids[5:]}
    truth["A6"] = []
    truth["A7"] = ["A0", "A0"]
    t = spark.createDataFrame(list(truth.items()), "artist_id string, similar_artists array<string>")
    c = spark.createDataFrame(list(clusters.items()), "artist_id string, prediction int")
    got = dict(rows(score_overlap(t, c)))
    want = scored_by_lists(truth, clusters)
    assert set(got) == set(want)
    for artist, score in want.items():
        assert got[artist] == pytest.approx(score), artist
    summary = overlap_summary(score_overlap(t, c)).first()
    assert summary["avgPercent"] == pytest.approx(sum(want.values()) / len(want))
    assert summary["maxPercent"] == pytest.approx(max(want.values()))
    peers = set(rows(cluster_peers(t, c)))
    assert peers == {
        (a, b) for a in truth if a in clusters for b in truth[a]
        if b != a and clusters.get(b) == clusters[a]
    }
    own = clusters["A10"]
    assert rows(peers_of(c, "A10"), "artist_id") == sorted(
        (a,) for a, k in clusters.items() if k == own and a != "A10"
    )
    assert peers_of(c, "A79").count() == 0


def test_evaluate_clusters_puts_the_scores_together(spark):
    df = spark.createDataFrame(
        [("A", 0, [0.0]), ("B", 0, [1.0]), ("C", 1, [10.0]), ("D", 1, [11.0])],
        "artist_id string, prediction int, v array<double>",
    ).withColumn("scaledFeatures", array_to_vector("v"))
    truth = spark.createDataFrame([("A", ["B", "C"]), ("C", ["D"])], "artist_id string, similar_artists array<string>")
    got = evaluate_clusters(df, truth).first().asDict()
    assert got == {
        "avgArtistsPerCluster": 2.0,
        "silhouette": pytest.approx(silhouette(df)),
        "avgPercent": 75.0,
        "maxPercent": 100.0,
    }


def test_artist_plan_end_to_end(spark):
    data = [
        song(
            artist_id=f"A{i}",
            artist_name=f"N{i}",
            song_id=f"S{i}",
            tempo=100.0 * (i % 3) + i % 5,
            duration=50.0 * (i % 3) + i % 4,
            similar_artists=[f"A{(i + 3) % 60}", f"A{(i + 1) % 60}"],
        )
        for i in range(60)
    ]
    songs = spark.createDataFrame(data, CATALOGUE)
    table = {r["k"]: r for r in compare_artist_clusterings(songs, [3, 6], parallelism=2).collect()}
    assert table[3]["avgArtistsPerCluster"] == 20.0 and table[3]["avgPercent"] == 50.0
    assert table[3]["maxPercent"] == 50.0 and table[3]["silhouette"] > 0.9
    assert table[6]["avgArtistsPerCluster"] == 10.0
    vectors = artist_vectors(songs)
    single, _ = artist_sweep(vectors, ground_truth(songs), [3])
    assert single.first()["avgPercent"] == 50.0


def test_artist_vectors_read_the_songs_once(spark, songs):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        read.add(1)
        return value

    watched = songs.withColumn("duration", counted("duration"))
    found = artist_vectors(watched).count()
    assert read.value == songs.count()
    assert found == artist_features(songs).count() > 0
