from songsift.operators.counts import (
    avg_metrics_by_token,
    count_by,
    count_entities_by,
    mean_by,
    order_desc,
    preview,
    token_count,
    top_k,
)
from songsift.plans.popularity import popular_terms, songs_per_year, sound_of_popular_terms
from tests.conftest import rows


def test_counts(songs):
    assert rows(songs_per_year(songs)) == [(1999, 1), (2000, 9)]
    assert rows(count_by(songs, "artist_location")) == [("Here", 11)]
    assert rows(count_entities_by(songs, "artist_location", "artist_id")) == [("Here", 4)]
    assert rows(count_entities_by(songs, "artist_location", "artist_id", approx=True)) == [("Here", 4)]


def test_token_count_has_one_row_per_term(songs):
    counts = dict(rows(token_count(songs, "artist_terms")))
    assert counts["rock"] == 4 and counts["Rock"] == 1 and counts["pop"] == 3
    assert counts["rock 'n roll"] == 1 and counts["a, b"] == 1
    assert "" not in counts


def test_token_count_of_text_equals_that_of_arrays(spark, songs):
    text = songs.select("artist_terms").collect()
    as_text = spark.createDataFrame(
        [(None if r[0] is None else repr(list(r[0])),) for r in text], "artist_terms string"
    )
    assert rows(token_count(as_text, "artist_terms")) == rows(token_count(songs, "artist_terms"))


def test_top_k_has_definite_ties(songs):
    top = [tuple(r) for r in top_k(token_count(songs, "artist_terms"), 3, "count", "term").collect()]
    assert top == [("rock", 4), ("jazz", 3), ("pop", 3)]
    assert [r[0] for r in preview(songs, 2, "song_id").select("song_id").collect()] == ["S01", "S02"]
    assert popular_terms(songs).first()[0] == "rock"
    assert order_desc(songs.select("year", "song_id"), "year", "song_id").first()[1] == "S01"


def test_mean_by_skips_unknown_keys(songs):
    means = dict(rows(mean_by(songs, "year", "duration")))
    assert set(means) == {1999, 2000} and means[1999] == 200.0


def test_avg_metric_counts_a_song_once_per_term(spark, songs):
    terms = spark.createDataFrame([("Rock",), ("jazz",), ("polka",), ("rock ",)], "term string")
    got = {r["term"]: r for r in avg_metrics_by_token(songs, "artist_terms", ["tempo", "loudness"], terms).collect()}
    assert set(got) == {"rock", "jazz", "polka"}
    # S01 and S02 have a tempo, S07 has none.
    assert got["rock"]["songs"] == 3 and got["rock"]["avg_tempo"] == (120.5 + 0.0) / 2
    assert got["jazz"]["songs"] == 3 and got["jazz"]["avg_loudness"] == -10.0
    assert got["polka"]["songs"] == 0 and got["polka"]["avg_tempo"] == 0.0
    assert sound_of_popular_terms(songs, k=2).count() == 2
