"""From nested song records to the stored, enriched catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songsift.operators.enrich import enrich_country, enrich_tags
from songsift.operators.joins import lookup_by_parts
from songsift.schemas import CATALOGUE, SONG_GROUPS
from songsift.session import scratch_path, settle, temporary, tidy_shuffles
from songsift.sources.catalogue import (
    decode_text_columns,
    read_catalogue,
    select_song_fields,
    write_catalogue,
)
from songsift.sources.ragged import assemble_ragged, whole_arrays
from songsift.sources.staging import read_staging_csv, write_staging_csv

#: What country and tags depend on, and the number of parts that songs are staged in by it.
_ARTIST = ["artist_latitude", "artist_longitude", "artist_name"]
_PARTS = 16


def nest_records(
    scalars: DataFrame,
    arrays: dict[str, tuple[DataFrame, DataFrame]],
    part_size: int = 100_000,
) -> DataFrame:
    """Song records from the tables of a flat source.

    ``scalars`` has ``file, songidx`` and any of the catalogue's plain fields.
    ``arrays`` gives for each array field its own offsets ``file, songidx, idx``
    and values ``file, pos, v``, as fields may lie in different tables of a
    file.  Fields that are not given are null.
    """
    songs = scalars
    for name, (offsets, values) in arrays.items():
        whole = whole_arrays(assemble_ragged(offsets, values, part_size))
        songs = songs.join(whole.withColumnRenamed("values", name), ["file", "songidx"], "left")
    types = {field.name: field.dataType for field in CATALOGUE}

    def field(name: str) -> Column:
        value = F.col(name) if name in songs.columns else F.lit(None)
        return value.cast(types[name]).alias(name)

    return songs.select(
        *[F.struct(*map(field, names)).alias(group) for group, names in SONG_GROUPS.items()]
    )


def stage(records: DataFrame, path: str) -> DataFrame:
    """Write the catalogue fields of the records as a staging CSV and read them back, with the ``_part`` of the artist."""
    songs = decode_text_columns(select_song_fields(records))
    dealt = songs.withColumn("_part", F.pmod(F.xxhash64(*_ARTIST), F.lit(_PARTS)).cast("int"))
    write_staging_csv(dealt, path, partition_by=("_part",), packed=True)
    return read_staging_csv(records.sparkSession, path, dealt.schema)


def build_catalogue(
    records: DataFrame,
    places: DataFrame,
    artist_tags: DataFrame,
    path: str,
    max_km: float = 500.0,
) -> DataFrame:
    """Stage the records, add country and tags, store the result and read it back.

    Country and tags are found for each different artist, and the songs of a few
    parts at a time get those of their artists, so that the wide rows are only
    written and read.  What is staged on the way goes when the result is stored.
    """
    spark = records.sparkSession
    with temporary(spark), tidy_shuffles(spark):
        songs = stage(records, scratch_path(spark, "staging"))
        artists = settle(songs.select(*_ARTIST, "_part").distinct(), "artists")
        artists = settle(enrich_tags(enrich_country(artists, places, max_km), artist_tags), "artists")
        mode = "overwrite"
        for some in lookup_by_parts(songs, artists, _ARTIST, "_part"):
            write_catalogue(some, path, mode=mode)
            mode = "append"
    return read_catalogue(spark, path)
