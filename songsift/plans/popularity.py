"""Which years, countries and terms are the most common, and how their songs sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songsift.operators.counts import (
    average_tokens,
    count_by,
    count_entities_by,
    count_tokens,
    list_totals,
    order_desc,
    token_count,
    top_k,
)
from songsift.operators.quality import drop_zero
from songsift.session import settle


def songs_per_year(songs: DataFrame) -> DataFrame:
    """Songs per known year, most productive year first."""
    return order_desc(count_by(drop_zero(songs, "year"), "year"), "count", "year")


def country_column(songs: DataFrame, country: str | None) -> str:
    """``country``, or else ``artist_country``, which the ingest adds."""
    if country is None and "artist_country" not in songs.columns:
        raise ValueError("no artist_country: enrich the songs first, or name the column")
    return country or "artist_country"


def songs_per_country(songs: DataFrame, country: str | None = None) -> DataFrame:
    """Songs per country, largest first."""
    country = country_column(songs, country)
    return order_desc(count_by(songs, country), "count", country)


def artists_per_country(songs: DataFrame, country: str | None = None) -> DataFrame:
    """Different artists per country, largest first."""
    country = country_column(songs, country)
    return order_desc(count_entities_by(songs, country, "artist_id"), "count", country)


def popular_terms(songs: DataFrame, terms: str = "artist_terms") -> DataFrame:
    return order_desc(token_count(songs, terms), "count", "term")


def sound_of_popular_terms(
    songs: DataFrame,
    metrics: tuple[str, ...] = ("tempo", "loudness"),
    k: int = 10,
    terms: str = "artist_terms",
) -> DataFrame:
    """Mean of every metric for the ``k`` most common terms.

    The catalogue is read once: the totals per different list are settled, and
    both the ranking and the means are taken from them.
    """
    lists = settle(list_totals(songs, terms, list(metrics)), "lists")
    top = top_k(count_tokens(lists, terms), k, "count", "term")
    return average_tokens(lists, terms, list(metrics), F.broadcast(top))
