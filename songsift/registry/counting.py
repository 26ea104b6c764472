"""Counts, means and top-k over the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from songsift.operators.counts import (
    avg_metrics_by_token,
    count_entities_by,
    mean_by,
    preview,
    token_count,
    top_k,
)
from songsift.operators.quality import distinct_values
from songsift.plans.popularity import (
    artists_per_country,
    popular_terms,
    songs_per_country,
    songs_per_year,
    sound_of_popular_terms,
)
from songsift.registry import query
from songsift.registry.data import catalogue, near, near_sql, over_catalogue, tokens_sql
from songsift.session import scratch_path
from songsift.sources.catalogue import read_catalogue, write_catalogue

_TERMS = (
    f"terms AS (SELECT trim(term) AS term, count(*) AS \"count\" FROM "
    f"(SELECT unnest({tokens_sql('artist_terms')}) AS term FROM catalogue) "
    f"WHERE trim(term) <> '' GROUP BY 1)"
)
_TOP = 'top AS (SELECT * FROM terms ORDER BY "count" DESC, term LIMIT 10)'


def _averages(*metrics: str) -> str:
    columns = "".join(f", {near_sql(f'coalesce(avg({m}), 0.0)')} AS avg_{m}" for m in metrics)
    songs = (
        f"songs AS (SELECT {', '.join(metrics)}, unnest(list_distinct(list_transform("
        f"{tokens_sql('artist_terms')}, lambda t: lower(trim(t))))) AS term FROM catalogue)"
    )
    return over_catalogue(
        f"SELECT wanted.term, count(songs.term) AS songs{columns} "
        "FROM (SELECT DISTINCT lower(trim(term)) AS term FROM top) wanted "
        "LEFT JOIN songs ON wanted.term = songs.term GROUP BY wanted.term",
        _TERMS,
        _TOP,
        songs,
    )


def _rounded(df, *columns):
    return df.withColumns({c: near(c) for c in columns})


@query(
    over_catalogue(
        'SELECT year, count(*) AS "count" FROM catalogue WHERE year <> 0 GROUP BY year'
        ' ORDER BY "count" DESC, year'
    )
)
def count_by_year(spark, sf_dir):
    return songs_per_year(catalogue(spark, sf_dir, "year"))


@query(
    over_catalogue(
        'SELECT year, count(*) AS "count" FROM catalogue WHERE year <> 0 GROUP BY year'
        ' ORDER BY "count" DESC, year LIMIT 1'
    )
)
def top_year(spark, sf_dir):
    return top_k(songs_per_year(catalogue(spark, sf_dir, "year")), 1, "count", "year")


@query(
    over_catalogue(
        'SELECT artist_location, count(*) AS "count" FROM catalogue'
        " WHERE artist_location IS NOT NULL GROUP BY artist_location"
    )
)
def count_by_location(spark, sf_dir):
    return songs_per_country(catalogue(spark, sf_dir, "artist_location"), "artist_location")


@query(
    over_catalogue(
        'SELECT artist_location, count(DISTINCT artist_id) AS "count" FROM catalogue'
        " WHERE artist_location IS NOT NULL GROUP BY artist_location"
    )
)
def artists_per_location(spark, sf_dir):
    songs = catalogue(spark, sf_dir, "artist_location", "artist_id")
    return artists_per_country(songs, "artist_location")


@query(
    over_catalogue(
        "SELECT DISTINCT artist_location, true AS near FROM catalogue"
        " WHERE artist_location IS NOT NULL"
    )
)
def artists_per_location_approx(spark, sf_dir):
    """Within three standard errors of the exact count."""
    songs = catalogue(spark, sf_dir, "artist_location", "artist_id")
    exact = count_entities_by(songs, "artist_location", "artist_id")
    about = count_entities_by(songs, "artist_location", "artist_id", approx=True)
    both = about.join(exact.withColumnRenamed("count", "exact"), "artist_location")
    off = F.abs(F.col("count") - F.col("exact"))
    return both.select("artist_location", (off <= 0.15 * F.col("exact")).alias("near"))


@query(over_catalogue("SELECT * FROM terms", _TERMS), "token_count")
def token_counts(spark, sf_dir):
    return popular_terms(catalogue(spark, sf_dir, "artist_terms"))


@query(over_catalogue("SELECT * FROM terms", _TERMS))
def token_count_stored(spark, sf_dir):
    """From a stored catalogue, whose list text is counted before it is parsed."""
    path = scratch_path(spark, "catalogue")
    write_catalogue(catalogue(spark, sf_dir, "artist_terms", "year"), path)
    return popular_terms(read_catalogue(spark, path, lists=False))


@query(over_catalogue("SELECT * FROM top", _TERMS, _TOP))
def top_tokens(spark, sf_dir):
    counts = token_count(catalogue(spark, sf_dir, "artist_terms"), "artist_terms")
    return top_k(counts, 10, "count", "term")


@query(_averages("tempo"))
def avg_tempo_by_token(spark, sf_dir):
    songs = catalogue(spark, sf_dir, "artist_terms", "tempo")
    return _rounded(sound_of_popular_terms(songs, ("tempo",)), "avg_tempo")


@query(_averages("loudness"))
def avg_loudness_by_token(spark, sf_dir):
    songs = catalogue(spark, sf_dir, "artist_terms", "loudness")
    return _rounded(sound_of_popular_terms(songs, ("loudness",)), "avg_loudness")


@query(_averages("tempo", "loudness"))
def sound_by_token(spark, sf_dir):
    songs = catalogue(spark, sf_dir, "artist_terms", "tempo", "loudness")
    return _rounded(sound_of_popular_terms(songs), "avg_tempo", "avg_loudness")


@query(
    over_catalogue(
        "SELECT lower(p_type) AS term, count(*) AS songs, "
        + near_sql(
            "coalesce(avg(CASE WHEN NOT isnan(gappy_loudness) THEN gappy_loudness END), 0.0)"
        )
        + " AS avg_gappy_loudness FROM (SELECT DISTINCT p_type FROM part) JOIN catalogue "
        "ON list_contains(list_transform("
        + tokens_sql("artist_terms")
        + ", lambda t: lower(trim(t))), lower(p_type)) GROUP BY 1"
    )
)
def avg_of_gappy_metric(spark, sf_dir):
    songs = catalogue(spark, sf_dir, "artist_terms", "gappy_loudness")
    terms = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("term"))
    means = avg_metrics_by_token(songs, "artist_terms", ["gappy_loudness"], terms)
    return _rounded(means, "avg_gappy_loudness")


@query(
    over_catalogue(
        f"SELECT year, {near_sql('avg(tempo)')} AS mean FROM catalogue"
        " WHERE year IS NOT NULL AND year <> 0 GROUP BY year"
    )
)
def mean_by_key(spark, sf_dir):
    means = mean_by(catalogue(spark, sf_dir, "year", "tempo"), "year", "tempo")
    return _rounded(means, "mean").orderBy(F.desc("mean"), "year")


@query(
    over_catalogue(
        "SELECT song_id, title, tempo FROM catalogue ORDER BY song_id, title, tempo LIMIT 10"
    )
)
def first_songs(spark, sf_dir):
    songs = catalogue(spark, sf_dir, "song_id", "title", "tempo")
    return preview(songs, 10, "song_id", "title", "tempo")


@query(over_catalogue("SELECT DISTINCT time_signature FROM catalogue"))
def distinct_time_signature(spark, sf_dir):
    return distinct_values(catalogue(spark, sf_dir, "time_signature"), "time_signature")
