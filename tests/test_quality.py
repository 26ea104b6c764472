import numpy as np
import pandas as pd
import pytest

from songsift.operators import quality
from songsift.operators.quality import (
    clip_outliers,
    describe_columns,
    distinct_values,
    drop_missing,
    drop_na,
    drop_null,
    drop_zero,
    exact_quantiles,
    missing_profile,
)
from tests.conftest import NAN, rows


def test_missing_values_are_null_or_nan(songs):
    profile = dict(rows(missing_profile(songs, ["tempo", "loudness", "artist_latitude", "title"])))
    assert profile == {"tempo": 1, "loudness": 2, "artist_latitude": 2, "title": 0}
    assert drop_missing(songs, ["tempo", "loudness", "artist_terms"]).count() == 9
    assert drop_null(songs, "loudness").count() == 11
    assert drop_na(songs, ["loudness"]).count() == 10


def test_sentinels_and_distinct(songs):
    assert drop_zero(songs, "year").count() == 10
    assert rows(drop_zero(songs, "tempo", "time_signature"), "song_id")[0] == ("S01",)
    assert rows(distinct_values(songs, "time_signature")) == [(0,), (4,)]


@pytest.mark.parametrize("rows_per_task", [10, 5_000_000])
def test_exact_quantiles_match_numpy(spark, rows_per_task):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame(
        {
            "normal": rng.normal(size=2000),
            "hot": np.where(rng.random(2000) < 0.4, 5.0, rng.integers(0, 50, 2000)),
            "wide": rng.lognormal(0, 30, 2000),
            "same": np.full(2000, 3.0),
        }
    )
    df = spark.createDataFrame(frame).repartition(5)
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, list(frame), probabilities, rows_per_task, accuracy=100)
    for column in frame:
        for p in probabilities:
            assert got[column, p] == pytest.approx(np.quantile(frame[column], p), rel=1e-12)


def test_three_passes_whatever_the_values(spark, monkeypatch):
    """Values over many magnitudes, and infinities."""
    rng = np.random.default_rng(2)
    wide = np.exp(rng.uniform(-300, 300, 20_000))
    ends = np.concatenate([np.full(5100, -np.inf), np.full(3000, np.inf), wide[8100:]])
    df = spark.createDataFrame(pd.DataFrame({"wide": wide, "ends": ends})).repartition(4)
    narrowed, seen = [], []
    monkeypatch.setattr(quality, "_counted", lambda *a, f=quality._counted: narrowed.append(1) or f(*a))
    monkeypatch.setattr(quality, "_narrow", lambda *a: pytest.fail("a further pass"))
    monkeypatch.setattr(quality, "_in_brackets", lambda *a, f=quality._in_brackets: seen.append(f(*a)) or seen[-1])
    got = exact_quantiles(df, ["wide", "ends"], [0.25, 0.5, 0.75, 0.9], rows_per_task=100)
    for p in (0.25, 0.5, 0.75, 0.9):
        assert got["wide", p] == pytest.approx(np.quantile(wide, p), rel=1e-12)
    assert got["ends", 0.25] == -np.inf and got["ends", 0.9] == np.inf
    assert got["ends", 0.5] == pytest.approx(np.quantile(ends, 0.5), rel=1e-12)
    # The measure with percentiles, one pass of counts, and the values left.
    assert len(narrowed) == 1
    assert seen[0][1].groupBy("slot", "value").count().groupBy("slot").count().agg({"count": "max"}).first()[0] <= 100


def test_quantiles_leave_missing_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (NAN,), (3.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {("x", 0.5): 2.0}
    assert exact_quantiles(df.filter("x > 1e9 and x < 1e10"), ["x"], [0.5]) == {}


def test_describe_matches_pandas(spark):
    frame = pd.DataFrame({"a": [1.0, 2.0, 2.5, 9.0], "b": [0, 0, 1, 3]})
    got = {r["column"]: r for r in describe_columns(spark.createDataFrame(frame), ["a", "b"]).collect()}
    want = frame.describe()
    for column in frame:
        for name, label in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                            ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert got[column][name] == pytest.approx(want[column][label])


def test_clip_outliers(spark):
    df = spark.range(101).selectExpr("cast(id as double) as x")
    assert clip_outliers(df, "x", 10, 20).count() == 11
    assert clip_outliers(df, "x", tail=0.05).agg({"x": "min"}).first()[0] == 5.0
    assert clip_outliers(df.limit(0), "x", tail=0.05).count() == 0
    with pytest.raises(ValueError):
        clip_outliers(df, "x")
