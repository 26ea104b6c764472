"""Column types of the catalogue and of the frames derived from it."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _DOUBLE, _INT = T.StringType(), T.DoubleType(), T.IntegerType()
_STRINGS, _DOUBLES = T.ArrayType(_STRING), T.ArrayType(_DOUBLE)

# The 26 catalogue columns and their logical types.
CATALOGUE = T.StructType(
    [
        T.StructField("artist_id", _STRING),
        T.StructField("artist_name", _STRING),
        T.StructField("artist_location", _STRING),
        T.StructField("artist_latitude", _DOUBLE),
        T.StructField("artist_longitude", _DOUBLE),
        T.StructField("song_id", _STRING),
        T.StructField("title", _STRING),
        T.StructField("song_hotttnesss", _DOUBLE),
        T.StructField("similar_artists", _STRINGS),
        T.StructField("artist_terms", _STRINGS),
        T.StructField("artist_terms_freq", _DOUBLES),
        T.StructField("artist_terms_weight", _DOUBLES),
        T.StructField("duration", _DOUBLE),
        T.StructField("time_signature", _INT),
        T.StructField("time_signature_confidence", _DOUBLE),
        T.StructField("beats_start", _DOUBLES),
        T.StructField("beats_confidence", _DOUBLES),
        T.StructField("key", _INT),
        T.StructField("key_confidence", _DOUBLE),
        T.StructField("loudness", _DOUBLE),
        T.StructField("energy", _DOUBLE),
        T.StructField("mode", _INT),
        T.StructField("mode_confidence", _DOUBLE),
        T.StructField("tempo", _DOUBLE),
        T.StructField("year", _INT),
        T.StructField("artist_genre", _STRINGS),
    ]
)

# Where each catalogue column sits in a nested song record.
SONG_GROUPS = {
    "metadata": [
        "artist_id",
        "artist_name",
        "artist_location",
        "artist_latitude",
        "artist_longitude",
        "song_id",
        "title",
        "song_hotttnesss",
        "similar_artists",
        "artist_terms",
        "artist_terms_freq",
        "artist_terms_weight",
    ],
    "analysis": [
        "duration",
        "time_signature",
        "time_signature_confidence",
        "beats_start",
        "beats_confidence",
        "key",
        "key_confidence",
        "loudness",
        "energy",
        "mode",
        "mode_confidence",
        "tempo",
    ],
    "musicbrainz": [
        "year",
    ],
}

# Feature columns used by the classifiers and the two clusterings.
CLASSIFIER_FEATURES = ["loudness_sc", "tempo_sc", "duration_sc", "time_signature"]
SONG_CLUSTER_FEATURES = ["duration", "key", "loudness", "tempo", "time_signature"]
ARTIST_CLUSTER_FEATURES = [
    "avgSongDuration",
    "avgSongLoudness",
    "avgTempo",
    "avgLoudness",
    "avgEnergy",
]

# The genres a song can be labelled with.
GENRES = ["rock", "pop", "electronic", "jazz", "folk"]

# Numbers of artist clusters that are compared.
ARTIST_KS = [5, 10, 20, 50, 100]
