from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from songsift.schemas import CATALOGUE  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("songsift-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return SF_DIR


def rows(df, *columns):
    """Rows as sorted tuples, with NaN as text so that it equals itself."""
    picked = df.select(*columns) if columns else df
    plain = [tuple("NaN" if v != v else v for v in r) for r in picked.collect()]
    return sorted(plain, key=repr)


def plan_of(df) -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


NAN = float("nan")


def song(**values):
    """A song row with sound defaults, in catalogue order."""
    base = {
        "artist_id": "A1",
        "artist_name": "Ann",
        "artist_location": "Here",
        "artist_latitude": 10.0,
        "artist_longitude": 20.0,
        "song_id": "S1",
        "title": "T",
        "song_hotttnesss": 0.5,
        "similar_artists": ["A2"],
        "artist_terms": ["rock"],
        "artist_terms_freq": [1.0],
        "artist_terms_weight": [1.0],
        "duration": 200.0,
        "time_signature": 4,
        "time_signature_confidence": 0.5,
        "beats_start": [0.1],
        "beats_confidence": [0.9],
        "key": 1,
        "key_confidence": 0.5,
        "loudness": -10.0,
        "energy": 0.0,
        "mode": 1,
        "mode_confidence": 0.5,
        "tempo": 120.0,
        "year": 2000,
        "artist_genre": ["rock"],
    }
    base.update(values)
    return tuple(base[f.name] for f in CATALOGUE)


@pytest.fixture(scope="session")
def songs(spark):
    data = [
        song(song_id="S01", artist_terms=["rock", "pop"], duration=2.5, tempo=120.5, loudness=-0.5),
        song(song_id="S02", artist_terms=["pop", "rock"], tempo=0.0),
        song(song_id="S03", artist_terms=["rock 'n roll", "jazz"], time_signature=0),
        song(song_id="S04", artist_terms=["a, b", "c"], artist_id="A2", artist_name="Bob", year=0),
        song(song_id="S05", artist_terms=[], artist_id="A2", artist_name="Bobby", year=0),
        song(song_id="S06", artist_terms=None, loudness=None),
        song(song_id="S07", artist_terms=["Rock", "rock", "rock"], tempo=NAN),
        song(song_id="S08", artist_terms=["folk"], artist_location=None, loudness=-60.0, duration=1.0, tempo=1.0),
        song(song_id="S09", artist_terms=["seen live", "jazz"], artist_id="A3", artist_name="Cy", artist_latitude=NAN),
        song(song_id="S10", artist_terms=["jazz"], artist_id="A3", artist_name="Cy", artist_latitude=None, year=1999),
        song(song_id="S11", artist_terms=["electronic"], artist_id="A4", artist_name="Di", loudness=NAN, energy=None),
        song(song_id="S12", artist_terms=[" pop "], artist_id="A4", artist_name="Di", loudness=0.0, duration=600.0, tempo=240.0),
    ]
    return spark.createDataFrame(data, CATALOGUE)
