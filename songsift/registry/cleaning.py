"""Missing values, sentinels, outliers and list text."""

from __future__ import annotations

from pyspark.sql import functions as F

from songsift.functions.lists import clean_tokens, parse_floats, parse_list
from songsift.functions.sql import register_functions
from songsift.operators.quality import (
    clip_outliers,
    describe_columns,
    drop_missing,
    drop_na,
    drop_null,
    drop_zero,
    missing_profile,
)
from songsift.registry import query
from songsift.registry.data import catalogue, over_catalogue, tokens_sql

_GAPPY = ["gappy_tempo", "gappy_loudness", "gappy_title", "duration"]
_MEASURES = ["tempo", "loudness", "time_signature", "duration"]


@query(
    over_catalogue(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({missing}) AS missing FROM catalogue"
            for c, missing in [
                ("gappy_tempo", "gappy_tempo IS NULL OR isnan(gappy_tempo)"),
                ("gappy_loudness", "gappy_loudness IS NULL OR isnan(gappy_loudness)"),
                ("gappy_title", "gappy_title IS NULL"),
                ("duration", "duration IS NULL OR isnan(duration)"),
            ]
        )
    ),
    "missing_profile",
)
def missing_values(spark, sf_dir):
    return missing_profile(catalogue(spark, sf_dir, *_GAPPY))


@query(
    over_catalogue(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
            + "".join(
                f"round(CAST(quantile_cont({c}, {p}) AS DOUBLE), 6) AS {name}, "
                for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
            )
            + f"round(CAST(max({c}) AS DOUBLE), 6) AS max FROM catalogue"
            for c in _MEASURES
        )
    )
)
def describe_features(spark, sf_dir):
    table = describe_columns(catalogue(spark, sf_dir, *_MEASURES), _MEASURES)
    numbers = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return table.withColumns({c: F.round(c, 6) for c in numbers})


@query(
    over_catalogue(
        "SELECT gappy_tempo, gappy_loudness, gappy_title, duration FROM catalogue"
        " WHERE gappy_tempo IS NOT NULL AND NOT isnan(gappy_tempo)"
        " AND gappy_loudness IS NOT NULL AND NOT isnan(gappy_loudness)"
        " AND gappy_title IS NOT NULL AND NOT isnan(duration)"
    ),
    "drop_missing",
)
def drop_missing_rows(spark, sf_dir):
    return drop_missing(catalogue(spark, sf_dir, *_GAPPY))


@query(
    over_catalogue("SELECT song_id, gappy_title FROM catalogue WHERE gappy_title IS NOT NULL"),
    "drop_null",
)
def drop_null_rows(spark, sf_dir):
    return drop_null(catalogue(spark, sf_dir, "song_id", "gappy_title"), "gappy_title")


@query(
    over_catalogue(
        "SELECT song_id, gappy_loudness, gappy_title FROM catalogue WHERE gappy_title IS NOT NULL"
        " AND gappy_loudness IS NOT NULL AND NOT isnan(gappy_loudness)"
    ),
    "drop_na",
)
def drop_na_rows(spark, sf_dir):
    return drop_na(catalogue(spark, sf_dir, "song_id", "gappy_loudness", "gappy_title"))


@query(
    over_catalogue(
        "SELECT song_id, tempo, time_signature FROM catalogue"
        " WHERE tempo <> 0 AND time_signature <> 0"
    ),
    "drop_zero",
)
def drop_zero_rows(spark, sf_dir):
    songs = catalogue(spark, sf_dir, "song_id", "tempo", "time_signature")
    return drop_zero(songs, "tempo", "time_signature")


@query(
    over_catalogue(
        "SELECT song_id, duration FROM catalogue, (SELECT quantile_cont(duration, 0.01) AS lo,"
        " quantile_cont(duration, 0.99) AS hi FROM catalogue) WHERE duration BETWEEN lo AND hi"
    ),
    "clip_outliers",
)
def clip_outlier_durations(spark, sf_dir):
    return clip_outliers(catalogue(spark, sf_dir, "song_id", "duration"), "duration", tail=0.01)


@query(
    over_catalogue("SELECT song_id, duration FROM catalogue WHERE duration BETWEEN 60.0 AND 600.0")
)
def clip_fixed_durations(spark, sf_dir):
    return clip_outliers(catalogue(spark, sf_dir, "song_id", "duration"), "duration", 60.0, 600.0)


@query(
    over_catalogue(
        "SELECT song_id, array_to_string(terms, '|') AS terms, CAST(len(terms) AS INTEGER) AS n"
        f" FROM (SELECT song_id, {tokens_sql('artist_terms')} AS terms FROM catalogue)"
    )
)
def list_parse(spark, sf_dir):
    songs = catalogue(spark, sf_dir, "song_id", "artist_terms")
    terms = songs.select("song_id", parse_list(F.col("artist_terms")).alias("terms"))
    return terms.select(
        "song_id", F.array_join("terms", "|").alias("terms"), F.size("terms").alias("n")
    )


@query(
    over_catalogue(
        "SELECT song_id, CAST(len(beats) AS INTEGER) AS n, round(list_sum(beats), 6) AS total,"
        " beats[1] AS first_beat FROM (SELECT song_id, list_filter(list_transform("
        "string_split_regex(trim(beats_start, '[] '), '\\s+'), lambda b: try_cast(b AS DOUBLE)),"
        " lambda b: b IS NOT NULL) AS beats FROM catalogue)"
    )
)
def float_parse(spark, sf_dir):
    songs = catalogue(spark, sf_dir, "song_id", "beats_start")
    beats = songs.select("song_id", parse_floats(F.col("beats_start")).alias("beats"))
    total = F.aggregate("beats", F.lit(0.0), lambda total, beat: total + beat)
    return beats.select(
        "song_id",
        F.size("beats").alias("n"),
        F.round(total, 6).alias("total"),
        F.get("beats", F.lit(0)).alias("first_beat"),
    )


@query(
    over_catalogue(
        "SELECT song_id, array_to_string(list_transform(string_split(padded, ','),"
        " lambda t: lower(trim(t))), '|') AS tokens FROM (SELECT song_id,"
        " ' ' || upper(replace(title, ' ', ' , ')) || ' , Rock' AS padded FROM catalogue)"
    )
)
def token_clean(spark, sf_dir):
    songs = catalogue(spark, sf_dir, "song_id", "title")
    words = F.upper(F.replace("title", F.lit(" "), F.lit(" , ")))
    padded = F.concat(F.lit(" "), words, F.lit(" , Rock"))
    tokens = clean_tokens(F.split(padded, ","))
    return songs.select("song_id", F.array_join(tokens, "|").alias("tokens"))


@query(
    over_catalogue(
        "SELECT song_id, array_to_string(terms, '|') AS terms"
        f" FROM (SELECT song_id, {tokens_sql('artist_terms')} AS terms FROM catalogue)"
    )
)
def list_parse_sql(spark, sf_dir):
    """The parser as a function of Spark SQL."""
    register_functions(spark)
    return spark.sql(
        "SELECT song_id, array_join(parseStringList(artist_terms), '|') AS terms FROM {songs}",
        songs=catalogue(spark, sf_dir, "song_id", "artist_terms"),
    )
