import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from songsift.operators.clusters import (
    attach_predictions,
    avg_cluster_size,
    best_k,
    cluster_centers,
    cluster_members,
    cluster_names,
    cluster_profile,
    cluster_sizes,
    first_members,
    fit_kmeans,
    playlist,
    silhouette,
    silhouettes,
    sweep_k,
)
from songsift.operators.features import assemble
from songsift.plans.playlists import cluster_songs, song_vectors
from tests.conftest import rows


@pytest.fixture(scope="module")
def blobs(spark):
    """Four far groups of 100 points each."""
    points = spark.range(400).select(
        "id",
        (F.col("id") % 4).cast("int").alias("group"),
        (F.col("id") % 2 * 50.0 + F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("x"),
        (F.floor(F.col("id") % 4 / 2) * 50.0 + F.pmod(F.hash("id"), F.lit(100)) / 100).alias("y"),
    )
    return assemble(points, ["x", "y"], "scaledFeatures").repartition(4, "id").cache()


@pytest.fixture(scope="module")
def fixed(spark):
    return spark.range(30).select(
        F.format_string("A%02d", "id").alias("artist_id"),
        F.format_string("name %02d", F.col("id") % 20).alias("artist_name"),
        F.when(F.col("id") < 1, 9).when(F.col("id") < 21, 0).otherwise(1).alias("prediction"),
        F.col("id").cast("double").alias("tempo"),
    )


def test_sweep_finds_the_groups(blobs):
    sweep, models = sweep_k(blobs, [2, 3, 4, 5], parallelism=4)
    scores = dict(rows(sweep))
    assert set(scores) == {2, 3, 4, 5} and all(-1 <= s <= 1 for s in scores.values())
    assert best_k(sweep).first()["k"] == 4 and scores[4] > 0.99
    songs = attach_predictions(blobs, models[4])
    assert songs.groupBy("group").agg(F.count_distinct("prediction").alias("n")).filter("n > 1").count() == 0
    assert [r["count"] for r in cluster_sizes(songs).collect()] == [100] * 4
    assert silhouette(songs) == pytest.approx(scores[4])


def test_silhouettes_equal_those_of_the_library(blobs):
    """Also for a point alone in its cluster, points on the same place, and a single cluster."""
    clustered = blobs.select(
        "scaledFeatures",
        F.when(F.col("id") == 3, 9).otherwise(F.col("group")).alias("lonely"),
        (F.col("id") % 11).cast("int").alias("mixed"),
        F.lit(4).alias("one"),
    )
    names = ["lonely", "mixed"]
    found = silhouettes(clustered, [*names, "one"])
    for name in names:
        assert found[name] == pytest.approx(silhouette(clustered, prediction=name), abs=1e-12)
    assert found["one"] == 0
    assert silhouettes(clustered.limit(0), names) == {"lonely": None, "mixed": None}


def test_points_lie_with_their_nearest_center(blobs):
    model = fit_kmeans(blobs, 7)
    centers = cluster_centers(blobs, model, ["x", "y"])
    assert centers.count() == 14
    by_cluster = centers.groupBy("cluster").pivot("feature", ["x", "y"]).agg(F.first("value"))
    near = (
        attach_predictions(blobs, model)
        .select("id", "prediction", vector_to_array("scaledFeatures").alias("v"))
        .join(F.broadcast(by_cluster.select("cluster", F.col("x").alias("cx"), F.col("y").alias("cy"))), F.lit(True))
        .groupBy("id", "prediction")
        .agg(F.min_by("cluster", F.hypot(F.col("v")[0] - F.col("cx"), F.col("v")[1] - F.col("cy"))).alias("nearest"))
    )
    assert near.filter("nearest <> prediction").count() == 0


def test_best_k_takes_the_smallest_of_equals(spark):
    sweep = spark.createDataFrame([(4, 0.5), (3, 0.5), (2, 0.1)], "k int, silhouette double")
    assert best_k(sweep).first()["k"] == 3


def test_sizes_and_profile(fixed):
    assert rows(cluster_sizes(fixed)) == [(0, 20), (1, 9), (9, 1)]
    assert avg_cluster_size(fixed).first()[0] == 10.0
    profile = {r["prediction"]: r["avg_tempo"] for r in cluster_profile(fixed, ["tempo"]).collect()}
    assert profile == {0: 10.5, 1: 25.0, 9: 0.0}


def test_members_are_whole_and_lists_are_short(fixed):
    lists = cluster_members(fixed, "artist_id", per_list=4).collect()
    members = [(r["prediction"], m) for r in lists for m in r["members"]]
    assert sorted(members) == rows(fixed, "prediction", "artist_id")
    assert max(len(r["members"]) for r in lists) < 20
    assert len({(r["prediction"], r["list"]) for r in lists}) == len(lists)
    whole = cluster_members(fixed, "artist_id")
    assert rows(whole, "prediction", "list") == [(0, 0), (1, 0), (9, 0)]


def test_first_members_and_names(fixed):
    first = first_members(fixed, 2, "artist_id")
    assert rows(first, "prediction", "artist_id") == [
        (0, "A01"), (0, "A02"), (1, "A21"), (1, "A22"), (9, "A00"),
    ]
    names = dict(rows(cluster_names(fixed, 3), "prediction", "names"))
    assert names[9] == ["name 00"] and names[1] == ["name 01", "name 02", "name 03"]
    every = cluster_names(fixed, per_list=5).collect()
    listed = sorted((r["prediction"], n) for r in every for n in r["names"])
    assert listed == sorted(set(rows(fixed, "prediction", "artist_name")))
    assert len(every) > 3


def test_playlist(fixed):
    songs = playlist(fixed, 1, 3, ["artist_name"], "artist_id")
    assert [r[0] for r in songs.collect()] == ["name 01", "name 02", "name 03"]


def test_playlist_plan_end_to_end(songs):
    points = song_vectors(songs, keep=("song_id", "title"))
    assert points.count() == 9  # loudness and tempo are there
    sweep, clustered = cluster_songs(points, range(2, 4))
    assert sweep.count() == 2
    assert {"song_id", "title", "tempo", "prediction"} <= set(clustered.columns)
    assert clustered.count() == 9


def test_all_fits_share_their_passes(blobs, monkeypatch):
    """Several k take as many passes over the points as one; the centres are those of the library."""
    from pyspark.ml.clustering import KMeans

    from songsift.operators.clusters import fit_many

    passes = []
    run = type(blobs).mapInArrow
    monkeypatch.setattr(type(blobs), "mapInArrow", lambda df, *a, **k: passes.append(1) or run(df, *a, **k))
    _, models, _ = fit_many(blobs, [2, 3, 4, 5, 6, 7])
    # One point, two rounds of cost and draw, weights, up to 20 iterations, two passes of the silhouettes.
    assert 8 < len(passes) <= 28
    library = KMeans(k=4, featuresCol="scaledFeatures", seed=1).fit(blobs)
    ours, theirs = (sorted(map(tuple, m.clusterCenters())) for m in (models[4], library))
    assert ours == [pytest.approx(c) for c in theirs]
    assert [len(m.clusterCenters()) for m in models.values()] == [2, 3, 4, 5, 6, 7]


def test_fewer_different_points_than_clusters(spark):
    points = assemble(spark.range(50).selectExpr("cast(id % 3 as double) as x"), ["x"], "scaledFeatures")
    model = fit_kmeans(points, 5)
    assert sorted(c[0] for c in model.clusterCenters()) == [0.0, 1.0, 2.0]
    assert rows(cluster_sizes(attach_predictions(points, model)), "count") == [(16,), (17,), (17,)]
