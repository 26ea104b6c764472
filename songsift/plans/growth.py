"""A catalogue that arrives in parts: what each part adds, and the answers over all of them.

Each part is read once, when it arrives.  Its states are small tables, kept below
one folder, and a part that is delivered again replaces its own.  The answers
merge the states and read no song; only the counts of the most common terms
go back to the songs, where few terms are left to count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songsift.operators.counts import most_common_tokens, token_state
from songsift.operators.states import (
    describe_state,
    entity_state,
    merge_entities,
    merge_profiles,
    profile_state,
    store_state,
    stored_states,
)
from songsift.plans.popularity import country_column


def _numbers(songs: DataFrame) -> list[str]:
    return [f.name for f in songs.schema if isinstance(f.dataType, T.NumericType)]


def add_part(songs: DataFrame, path: str, part: str, country: str | None = None) -> None:
    """Store what ``part`` of the catalogue adds below ``path``."""
    place = country_column(songs, country)
    base = path.rstrip("/")
    store_state(profile_state(songs, _numbers(songs)), f"{base}/profile", part)
    store_state(entity_state(songs, place, "artist_id"), f"{base}/artists", part)
    store_state(token_state(songs, "artist_terms"), f"{base}/terms", part)


def report_of_parts(
    spark: SparkSession, path: str, songs: DataFrame | None = None, k: int = 10
) -> dict[str, DataFrame]:
    """Profile and artists per country of all parts; with the ``songs`` of all parts the top terms too."""
    base = path.rstrip("/")
    artists = stored_states(spark, f"{base}/artists")
    place = next(c for c in artists.columns if c != "sketch")
    answers = {
        "profile": describe_state(merge_profiles(stored_states(spark, f"{base}/profile"))).orderBy("column"),
        "artists_per_country": merge_entities(artists, place).orderBy(F.desc("count"), place),
    }
    if songs is not None:
        terms = stored_states(spark, f"{base}/terms")
        answers["popular_terms"] = most_common_tokens(songs, "artist_terms", k, terms)
    return answers
