"""Catalogues that grow by parts, stored layouts, and numbers for any number of labels and peers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songsift.operators.counts import most_common_tokens, token_state
from songsift.operators.features import index_label
from songsift.operators.similarity import artist_features, peer_index, peer_pages, peers_on_page
from songsift.operators.states import (
    RANK_ERROR,
    describe_state,
    entity_state,
    merge_entities,
    merge_profiles,
    profile_state,
    store_state,
    stored_states,
)
from songsift.registry import query
from songsift.registry.clustering import _ARTIST_COLUMNS, FEATURES
from songsift.registry.counting import _TERMS, _TOP
from songsift.registry.data import ARTISTS_SQL, artists, catalogue, near, near_sql, over_catalogue, tokens_sql
from songsift.schemas import ARTIST_CLUSTER_FEATURES
from songsift.session import scratch_path, settle
from songsift.sources.catalogue import typed_catalogue, write_by_artist
from songsift.sources.staging import read_staging_lines

_PROFILED = ["tempo", "gappy_tempo", "gappy_loudness", "duration", "year"]


def _parts(songs: DataFrame) -> dict[str, DataFrame]:
    """Two deliveries of a catalogue, of uneven size."""
    first = F.col("time_signature") < 3
    return {"one": songs.filter(first), "two": songs.filter(~first)}


@query(
    over_catalogue(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count(v) AS missing, count(v) AS \"count\","
            f" {near_sql('avg(v)')} AS mean, {near_sql('stddev_samp(v)')} AS std,"
            f" {near_sql('min(v)')} AS min, {near_sql('max(v)')} AS max, true AS quartiles_hold"
            f" FROM (SELECT CASE WHEN NOT isnan(v) THEN v END AS v"
            f" FROM (SELECT CAST({c} AS DOUBLE) AS v FROM catalogue))"
            for c in _PROFILED
        )
    )
)
def profile_of_parts(spark, sf_dir):
    """From the states of two parts, one of which was delivered twice.

    A quartile holds if the shares of values below it and up to it enclose the
    wanted share, give or take the error of the sketch.
    """
    songs = catalogue(spark, sf_dir, *_PROFILED, "time_signature")
    path = scratch_path(spark, "profiles")
    parts = _parts(songs)
    for name in ("one", "two", "one"):
        store_state(profile_state(parts[name], _PROFILED), path, name)
    table = settle(describe_state(merge_profiles(stored_states(spark, path))), "described")
    rows = {r["column"]: r for r in table.collect()}
    shares = songs.agg(
        *[
            F.struct(*[F.avg((value < rows[c][q]).cast("double")).alias(f"lt_{q}") for q in ("p25", "p50", "p75")],
                     *[F.avg((value <= rows[c][q]).cast("double")).alias(f"le_{q}") for q in ("p25", "p50", "p75")]).alias(c)
            for c in _PROFILED
            for value in [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))]
        ]
    ).first()
    held = [
        (c, all(shares[c][f"lt_{q}"] - RANK_ERROR <= p <= shares[c][f"le_{q}"] + RANK_ERROR
                for q, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))))
        for c in _PROFILED
    ]
    held = spark.createDataFrame(held, "column string, quartiles_hold boolean")
    numbers = ["mean", "std", "min", "max"]
    return table.join(held, "column").select(
        "column", "missing", "count", *[near(c).alias(c) for c in numbers], "quartiles_hold"
    )


@query(
    over_catalogue(
        'SELECT artist_location, count(DISTINCT artist_id) AS "count" FROM catalogue'
        " WHERE artist_location IS NOT NULL GROUP BY artist_location"
    )
)
def artists_of_parts(spark, sf_dir):
    """Artists of each place from the sketches of two parts that share most artists."""
    songs = catalogue(spark, sf_dir, "artist_location", "artist_id", "time_signature")
    path = scratch_path(spark, "entities")
    for name, part in _parts(songs).items():
        store_state(entity_state(part, "artist_location", "artist_id"), path, name)
    return merge_entities(stored_states(spark, path), "artist_location")


_NAMES = (
    "names AS (SELECT artist_name AS term, count(*) AS \"count\" FROM catalogue GROUP BY artist_name"
    " ORDER BY \"count\" DESC, term LIMIT 10)"
)


@query(
    over_catalogue(
        'SELECT \'terms\' AS list, term, "count" FROM top UNION ALL'
        ' SELECT \'names\' AS list, term, "count" FROM names',
        _TERMS,
        _TOP,
        _NAMES,
    )
)
def top_tokens_of_parts(spark, sf_dir):
    """The most common terms, from stored sketches of two parts, and names, which are all about as common."""
    songs = catalogue(spark, sf_dir, "artist_terms", "artist_name", "time_signature")
    path = scratch_path(spark, "tokens")
    for name, part in _parts(songs).items():
        store_state(token_state(part, "artist_terms"), path, name)
    terms = most_common_tokens(songs, "artist_terms", 10, stored_states(spark, path))
    names = songs.select(F.array("artist_name").alias("names"))
    names = most_common_tokens(names, "names", 10, tracked=64)
    return terms.select(F.lit("terms").alias("list"), "term", "count").union(
        names.select(F.lit("names").alias("list"), "term", "count")
    )


@query(
    over_catalogue(
        "SELECT song_id, artist_name, CAST(place AS INTEGER) AS artist_name_index FROM catalogue JOIN"
        " (SELECT artist_name, row_number() OVER (ORDER BY count(*) DESC, artist_name) - 1 AS place"
        " FROM catalogue GROUP BY artist_name) USING (artist_name)"
    )
)
def artist_name_index(spark, sf_dir):
    """A label with as many values as there are artists."""
    return index_label(catalogue(spark, sf_dir, "song_id", "artist_name"), "artist_name")


_PLACED = (
    "placed AS (SELECT prediction, artist_id,"
    " row_number() OVER (PARTITION BY prediction ORDER BY artist_id) - 1 AS place FROM artists)"
)


@query(
    f"WITH {ARTISTS_SQL}, {_PLACED} SELECT prediction, place // 100 AS page, min(artist_id) AS first,"
    " max(artist_id) AS last, count(*) AS artists FROM placed GROUP BY prediction, place // 100"
)
def peer_pages_of_clusters(spark, sf_dir):
    """Every artist on exactly one page of its cluster."""
    return peer_pages(peer_index(artists(spark, sf_dir)), 100)


@query(
    f"WITH {ARTISTS_SQL}, {_PLACED} SELECT artist_id, prediction, place FROM placed"
    " WHERE prediction = (SELECT prediction FROM artists WHERE artist_id = 'AR3')"
    " AND place BETWEEN 20 AND 39 AND artist_id <> 'AR3'"
)
def peers_on_second_page(spark, sf_dir):
    """The second page of twenty among the peers of one artist of the largest cluster."""
    index = settle(peer_index(artists(spark, sf_dir)), "peers")
    return peers_on_page(index, "AR3", 1, 20)


@query(
    over_catalogue(
        "SELECT artist_id, artist_name, nbSong, "
        + ", ".join(f"{near_sql(c)} AS {c}" for c in ARTIST_CLUSTER_FEATURES)
        + ", yearFirstSong, yearLastSong FROM features",
        FEATURES,
    )
)
def artist_features_by_bucket(spark, sf_dir):
    """From a catalogue that is stored by artist, so that nothing is shuffled."""
    stored = write_by_artist(
        catalogue(spark, sf_dir, *_ARTIST_COLUMNS),
        scratch_path(spark, "by-artist"),
        f"songsift_{uuid.uuid4().hex}",
        buckets=8,
    )
    frame = artist_features(stored)
    return frame.withColumns({c: near(c) for c in ARTIST_CLUSTER_FEATURES})


# How some staging lines are spoilt, by the key of the song.
_LINE = (
    "concat(song_id, ',', artist_name, ',', CASE WHEN key IN (1, 3) THEN 'MCM' ELSE CAST(year AS {text}) END,"
    " ',', CASE WHEN key = 3 THEN 'x' ELSE CAST(key AS {text}) END,"
    " CASE WHEN key = 0 THEN '' WHEN key = 2 THEN ',rock' ELSE concat(',\"', replace(artist_terms, '''', '\"\"'), '\"') END)"
)
_STAGED = ["song_id", "artist_name", "year", "key", "artist_terms"]


def _staged(spark, sf_dir):
    """Both sides of a staging folder in which some lines are spoilt."""
    songs = catalogue(spark, sf_dir, *_STAGED)
    path = scratch_path(spark, "staging")
    lines = songs.select(F.expr(_LINE.format(text="STRING").replace("''''", "'\\''")).alias("line"))
    header = spark.createDataFrame([(",".join(_STAGED),)], "line string")
    lines.union(header).write.text(path)
    return read_staging_lines(spark, path, typed_catalogue(songs).schema)


@query(
    over_catalogue(
        'SELECT song_id, artist_name, year, "key", array_to_string('
        + tokens_sql("artist_terms")
        + ", '|') AS artist_terms FROM catalogue WHERE \"key\" > 3"
    )
)
def staging_sound(spark, sf_dir):
    sound, _ = _staged(spark, sf_dir)
    return sound.withColumn("artist_terms", F.array_join("artist_terms", "|"))


@query(
    over_catalogue(
        f"SELECT {_LINE.format(text='VARCHAR').replace(' key ', ' "key" ').replace('(key ', '("key" ')} AS line,"
        " CASE \"key\" WHEN 0 THEN 'not 5 fields' WHEN 1 THEN 'wrong type: year'"
        " WHEN 2 THEN 'wrong type: artist_terms' ELSE 'wrong type: year, key' END AS reason"
        ' FROM catalogue WHERE "key" <= 3'
    )
)
def staging_rejects(spark, sf_dir):
    return _staged(spark, sf_dir)[1].select("line", "reason")
