import os

import numpy as np
from pyspark.sql import functions as F

from songsift import session
from songsift.operators.enrich import EARTH_RADIUS_KM, enrich_country, enrich_tags
from songsift.operators.joins import lookup_by_parts
from songsift.plans import ingest
from songsift.schemas import SONG_GROUPS
from songsift.session import temporary
from songsift.sources.catalogue import write_catalogue
from tests.conftest import plan_of, rows


def sphere(lat, lon):
    phi, lam = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)], -1)


def brute_force(points, places, max_km):
    d = np.linalg.norm(sphere(*points.T)[:, None] - sphere(*places.T)[None], axis=-1)
    nearest = d.argmin(1)
    limit = 2 * np.sin(max_km / (2 * EARTH_RADIUS_KM))
    return [f"C{j}" if d[i, j] <= limit else None for i, j in enumerate(nearest)]


def test_nearest_place_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    def spots(n):
        lat = np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
        return np.stack([lat, rng.uniform(-180, 180, n)], -1)
    points = np.concatenate([spots(400), [[89.9, 0.0], [-89.9, 170.0], [5.0, 179.99], [5.0, -179.99]]])
    # A dense town as well as scattered places, poles and the date line.
    town = np.array([48.0, 11.0]) + rng.normal(0, 0.05, (60, 2))
    places = np.concatenate([spots(200), town, [[90.0, 10.0], [-90.0, 0.0], [5.1, -179.95]]])
    points = np.concatenate([points, np.array([48.0, 11.0]) + rng.normal(0, 0.2, (60, 2))])
    songs = spark.createDataFrame(
        [(i, float(a), float(b)) for i, (a, b) in enumerate(points)],
        "i int, artist_latitude double, artist_longitude double",
    )
    where = spark.createDataFrame(
        [(i, float(a), float(b), f"C{i}") for i, (a, b) in enumerate(places)],
        "place_id int, lat double, lon double, country string",
    )
    for max_km, per_cube in ((300.0, 64), (2500.0, 3)):
        got = enrich_country(songs, where, max_km, "artist_latitude", "artist_longitude", per_cube)
        want = brute_force(points, places, max_km)
        assert [r[0] for r in got.orderBy("i").select("artist_country").collect()] == want


def test_missing_coordinates_and_ties(spark, songs):
    places = spark.createDataFrame(
        [(2, 10.0, 21.0, "East"), (1, 10.0, 19.0, "West"), (3, 10.0, 19.0, "Later")],
        "place_id int, lat double, lon double, country string",
    )
    got = dict(rows(enrich_country(songs, places), "song_id", "artist_country"))
    assert len(got) == 12 and got["S09"] is None and got["S10"] is None
    assert got["S01"] in ("West", "East")
    assert enrich_country(songs, places).columns == [*songs.columns, "artist_country"]
    again = enrich_country(enrich_country(songs.withColumn("lat", F.lit(0)), places), places)
    assert again.columns == [*songs.columns, "lat", "artist_country"]
    same = places.withColumn("lon", F.lit(20.0))
    assert dict(rows(enrich_country(songs, same), "song_id", "artist_country"))["S01"] == "West"


def test_tags_keep_order_and_rows(spark, songs):
    tags = spark.createDataFrame(
        [("Ann", ["rock", "a"]), ("Cy", []), ("Ann", ["rock", "b"]), ("Ann", [])],
        "artist_name string, tags array<string>",
    )
    got = enrich_tags(songs, tags)
    by_song = dict(rows(got, "song_id", "artist_genre"))
    assert len(by_song) == got.count() == 12
    assert by_song["S01"] == ["rock", "a"] and by_song["S09"] is None and by_song["S11"] is None


def test_no_places_need_no_rounds(spark, songs):
    none = spark.createDataFrame([], "place_id int, lat double, lon double, country string")
    with temporary(spark):
        got = enrich_country(songs, none)
        assert got.filter("artist_country is not null").count() == 0 and got.count() == songs.count()
        assert len(session._open[-1]) <= 6


def nested(songs):
    return songs.select(*[F.struct(*names).alias(group) for group, names in SONG_GROUPS.items()])


def test_ingest_shuffles_no_songs_and_keeps_nothing_on_the_way(spark, songs, tmp_path, monkeypatch):
    """Country and tags are looked up for artists; the songs are only written, read and written."""
    places = spark.createDataFrame([(1, 10.0, 21.0, "East")], "place_id int, lat double, lon double, country string")
    tags = spark.createDataFrame([("Ann", ["rock", "a"])], "artist_name string, tags array<string>")
    plans = []

    def write(df, path, *args, **options):
        plans.append(plan_of(df))
        write_catalogue(df, path, *args, **options)

    monkeypatch.setattr(ingest, "write_catalogue", write)
    before = set(os.listdir(session.shared_folder(spark)))
    # Small tables are broadcast anyway; without that songs would be shuffled.
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = ingest.build_catalogue(nested(songs), places, tags, str(tmp_path / "c"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert set(os.listdir(session.shared_folder(spark))) == before
    assert plans and all("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan for plan in plans)
    want = enrich_tags(enrich_country(songs.drop("artist_genre"), places), tags)
    assert built.columns[-2:] == ["artist_country", "artist_genre"]
    assert rows(built, *sorted(want.columns)) == rows(want, *sorted(want.columns))


def test_ingest_in_several_runs_equals_one(spark, songs, tmp_path, monkeypatch):
    places = spark.createDataFrame([(1, 10.0, 21.0, "East")], "place_id int, lat double, lon double, country string")
    tags = spark.createDataFrame([("Ann", ["rock", "a"])], "artist_name string, tags array<string>")
    whole = rows(ingest.build_catalogue(nested(songs), places, tags, str(tmp_path / "one")))

    def one_at_a_time(facts, dim, on, part):
        return lookup_by_parts(facts, dim, on, part, at_once=1)

    monkeypatch.setattr(ingest, "lookup_by_parts", one_at_a_time)
    again = ingest.build_catalogue(nested(songs), places, tags, str(tmp_path / "many"))
    assert rows(again) == whole and len(whole) == songs.count()
    none = ingest.build_catalogue(nested(songs.limit(0)), places, tags, str(tmp_path / "none"))
    assert none.count() == 0 and none.columns == again.columns
