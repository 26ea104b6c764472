"""Features, labels and the training split."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from songsift.operators.features import (
    assemble,
    derive_label,
    hash_split,
    index_label,
    minmax_scale,
    one_hot,
    prepare_classification,
    round_features,
    standard_scale,
)
from songsift.operators.quality import drop_missing, drop_zero
from songsift.plans.genres import SPLIT_KEY
from songsift.registry import query
from songsift.registry.data import VOCABULARY, catalogue, over_catalogue, tokens_sql
from songsift.schemas import SONG_CLUSTER_FEATURES
from songsift.session import scratch_path
from songsift.sources.catalogue import read_catalogue, write_catalogue

_NEEDED = ["loudness", "tempo", "time_signature", "beats_start", "duration", "artist_terms"]

ROUNDED = (
    "rounded AS (SELECT CAST(round(loudness + 100) AS INTEGER) AS loudness,"
    " CAST(round(tempo) AS INTEGER) AS tempo, CAST(round(duration) AS INTEGER) AS duration,"
    " time_signature, artist_terms FROM catalogue WHERE time_signature <> 0 AND tempo <> 0)"
)
SCALED = (
    "scaled AS (SELECT rounded.*, "
    + ", ".join(
        f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 2) AS {c}_sc"
        for c in ("loudness", "tempo", "duration")
    )
    + " FROM rounded)"
)


def labelled(source: str) -> str:
    words = ", ".join(f"'{word}'" for word in VOCABULARY)
    return (
        f"labelled AS (SELECT * EXCLUDE (artist_terms), list_filter({tokens_sql('artist_terms')},"
        f" lambda t: t IN ({words}))[1] AS filtered_genre FROM {source}"
        " WHERE filtered_genre IS NOT NULL)"
    )


INDEXED = (
    "indexed AS (SELECT labelled.*, filtered_genre_index FROM labelled JOIN"
    " (SELECT filtered_genre, CAST(row_number() OVER (ORDER BY count(*) DESC, filtered_genre) - 1"
    " AS INTEGER) AS filtered_genre_index FROM labelled GROUP BY filtered_genre)"
    " USING (filtered_genre))"
)
FRAME = (ROUNDED, SCALED, labelled("scaled"), INDEXED)

# The share of a row's md5 that decides its side of the split.
IN_TRAIN = (
    "CAST('0x' || substr(md5(concat_ws('|', "
    + ", ".join(SPLIT_KEY)
    + ")), 1, 8) AS BIGINT) % 100 < 80"
)


def _clean(spark, sf_dir):
    songs = drop_missing(catalogue(spark, sf_dir, *_NEEDED))
    return drop_zero(songs, "time_signature", "tempo").drop("beats_start")


def classification_rows(spark, sf_dir):
    return prepare_classification(catalogue(spark, sf_dir, *_NEEDED), VOCABULARY)


@query(over_catalogue("SELECT * FROM rounded", ROUNDED))
def rounded_features(spark, sf_dir):
    return round_features(_clean(spark, sf_dir))


@query(over_catalogue("SELECT * FROM scaled", ROUNDED, SCALED))
def minmax_features(spark, sf_dir):
    return minmax_scale(round_features(_clean(spark, sf_dir)), ["loudness", "tempo", "duration"])


@query(
    over_catalogue(
        "SELECT song_id, "
        + ", ".join(
            f'round(("{c}" - avg("{c}") OVER ()) / stddev_samp("{c}") OVER (), 6) AS z_{c}'
            for c in SONG_CLUSTER_FEATURES
        )
        + " FROM catalogue"
    )
)
def standard_features(spark, sf_dir):
    songs = catalogue(spark, sf_dir, "song_id", *SONG_CLUSTER_FEATURES)
    values = vector_to_array("scaledFeatures")
    return standard_scale(songs, SONG_CLUSTER_FEATURES).select(
        "song_id",
        *[F.round(values[i], 6).alias(f"z_{c}") for i, c in enumerate(SONG_CLUSTER_FEATURES)],
    )


@query(
    over_catalogue(
        "SELECT song_id, round(duration, 6) AS duration, CAST(\"key\" AS DOUBLE) AS \"key\", tempo"
        " FROM catalogue"
    )
)
def assembled_features(spark, sf_dir):
    columns = ["duration", "key", "tempo"]
    songs = assemble(catalogue(spark, sf_dir, "song_id", *columns), columns)
    values = vector_to_array("features")
    return songs.select(
        "song_id", *[F.round(values[i], 6).alias(c) for i, c in enumerate(columns)]
    )


@query(
    over_catalogue(
        "SELECT * FROM labelled", labelled("(SELECT song_id, artist_terms FROM catalogue)")
    ),
    "derive_label",
)
def label_of_song(spark, sf_dir):
    return derive_label(catalogue(spark, sf_dir, "song_id", "artist_terms"), VOCABULARY)


@query(
    over_catalogue(
        "SELECT * FROM indexed", labelled("(SELECT song_id, artist_terms FROM catalogue)"), INDEXED
    )
)
def label_index(spark, sf_dir):
    songs = derive_label(catalogue(spark, sf_dir, "song_id", "artist_terms"), VOCABULARY)
    return index_label(songs)


@query(
    over_catalogue(
        "SELECT song_id, time_signature, "
        + ", ".join(
            f"CAST(time_signature = {i} AS DOUBLE) AS is_{i}" for i in range(6)
        )
        + " FROM catalogue"
    ),
    "one_hot",
)
def one_hot_signature(spark, sf_dir):
    songs = one_hot(catalogue(spark, sf_dir, "song_id", "time_signature"), "time_signature", "hot")
    values = vector_to_array("hot")
    return songs.select(
        "song_id", "time_signature", *[values[i].alias(f"is_{i}") for i in range(6)]
    )


@query(over_catalogue("SELECT * FROM indexed", *FRAME))
def classification_frame(spark, sf_dir):
    return classification_rows(spark, sf_dir)


@query(
    over_catalogue(
        f"SELECT CASE WHEN {IN_TRAIN} THEN 'train' ELSE 'test' END AS side, filtered_genre,"
        " count(*) AS \"rows\", sum(duration)::BIGINT AS total_duration FROM indexed"
        " GROUP BY ALL",
        *FRAME,
    ),
    "hash_split",
)
def hash_split_sides(spark, sf_dir):
    train, test = hash_split(classification_rows(spark, sf_dir), SPLIT_KEY)
    both = train.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("side", F.lit("test"))
    )
    return both.groupBy("side", "filtered_genre").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("duration").alias("total_duration")
    )


_BOUNDED = ROUNDED.replace("tempo <> 0", "tempo <> 0 AND duration BETWEEN 207 AND 613")


@query(
    over_catalogue("SELECT * FROM indexed", _BOUNDED, SCALED, labelled("scaled"), INDEXED)
)
def classification_frame_in_bounds(spark, sf_dir):
    """Without the songs of unusual duration."""
    songs = catalogue(spark, sf_dir, *_NEEDED)
    return prepare_classification(songs, VOCABULARY, durations=(207.0, 613.0))


@query(over_catalogue("SELECT * FROM indexed", *FRAME))
def classification_frame_stored(spark, sf_dir):
    """From a stored catalogue, whose list text is parsed by the operators."""
    path = scratch_path(spark, "catalogue")
    write_catalogue(catalogue(spark, sf_dir, *_NEEDED), path)
    return prepare_classification(read_catalogue(spark, path, lists=False), VOCABULARY)
