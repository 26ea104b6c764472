"""Countries by nearest place, and tags by artist name."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from songsift.functions.numeric import is_missing
from songsift.operators.joins import lookup
from songsift.session import settle

EARTH_RADIUS_KM = 6371.0088

_CUBE = ["cx", "cy", "cz"]
_MAX_LEVEL = 30
# Far more than rounding can move a cube's wall, and less than a hundredth of a millimetre.
_SLACK = 1e-12


def _chord(km: float) -> float:
    """Straight-line length, on the unit sphere, of an arc of ``km``."""
    return 2 * math.sin(km / (2 * EARTH_RADIUS_KM))


def _on_sphere(lat: str, lon: str) -> list[Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]


def _add_sphere(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumns(
        {f"{prefix}{axis}": value for axis, value in zip("xyz", _on_sphere("lat", "lon"))}
    )


def _cube_of(prefix: str, level: int | Column, radius: float) -> list[Column]:
    """The cube of a point; its edge is ``radius``, halved ``level`` times."""
    scale = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level) / radius
    return [F.floor(F.col(f"{prefix}{axis}") * scale) for axis in "xyz"]


def _length(steps: list[Column]) -> Column:
    return F.sqrt(steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2])


def _levels_needed(sites: DataFrame, radius: float, per_cube: int) -> int:
    """How often cubes must be halved until none holds more than ``per_cube`` places."""
    level = F.col("level")
    fullest = (
        sites.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_MAX_LEVEL))))
        .select("level", *[c.alias(n) for c, n in zip(_cube_of("p", level, radius), _CUBE)])
        .groupBy("level", *_CUBE)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("level")
        .agg(F.max("n").alias("n"))
    )
    found = fullest.agg(
        F.count(F.lit(1)).alias("levels"), F.min(F.when(F.col("n") <= per_cube, level)).alias("fits")
    ).first()
    if not found["levels"]:
        return 0
    return _MAX_LEVEL if found["fits"] is None else found["fits"]


def nearest_country(
    points: DataFrame,
    places: DataFrame,
    max_km: float,
    per_cube: int = 64,
) -> DataFrame:
    """``lat, lon, artist_country``: the country of the place nearest to each point.

    Points and places sit on the unit sphere, cut into cubes with an edge of
    ``max_km``.  A place within that distance lies in one of the 27 cubes around
    a point.  These cubes are halved until none holds more than ``per_cube``
    places.  At each step a point keeps only the halves that may hold its
    nearest place: those not farther away than a place already known.  So the
    work for a point depends on the places at about the nearest distance, not on
    how many a region holds.  A point with no place that near has no row.  Equal
    distances go to the smaller ``place_id``.
    """
    radius = _chord(max_km)
    known = ~is_missing(places, "lat") & ~is_missing(places, "lon")
    sites = settle(
        _add_sphere(
            places.filter(known)
            .groupBy("lat", "lon")
            .agg(F.min(F.struct("place_id", "country")).alias("place")),
            "p",
        ).drop("lat", "lon"),
        "places",
    )
    placed = settle(_add_sphere(points, "q"), "points")
    candidates = settle(_cubes_around(placed, sites, radius), "candidates")
    depth = _levels_needed(sites, radius, per_cube)
    for level in range(1, depth + 1):
        halves = _halves(candidates, sites, level, radius)
        candidates = settle(halves, "candidates")
    homes = sites.withColumns(dict(zip(_CUBE, _cube_of("p", depth, radius))))
    distance = _length([F.col(f"q{axis}") - F.col(f"p{axis}") for axis in "xyz"])
    found = F.struct(
        distance.alias("d"),
        F.col("place.place_id").alias("place_id"),
        F.col("place.country").alias("country"),
    )
    return (
        lookup(candidates, homes, _CUBE, "inner")
        .groupBy("lat", "lon")
        .agg(F.min(F.when(distance <= radius, found)).alias("best"))
        .filter("best IS NOT NULL")
        .select("lat", "lon", F.col("best.country").alias("artist_country"))
    )


def _cubes_around(
    points: DataFrame, sites: DataFrame, radius: float
) -> DataFrame:
    """Each point with the cubes around it, of edge ``radius``, that hold a place."""
    own = [f"own_{axis}" for axis in "xyz"]
    around = sites.select(
        *[c.alias(n) for c, n in zip(_cube_of("p", 0, radius), _CUBE)]
    ).distinct()
    for name, cube in zip(own, _CUBE):
        around = around.withColumn(name, F.explode(F.sequence(F.col(cube) - 1, F.col(cube) + 1)))
    placed = points.withColumns(dict(zip(own, _cube_of("q", 0, radius))))
    return lookup(placed, around, own, "inner").drop(*own)


def _halves(
    candidates: DataFrame, sites: DataFrame, level: int, radius: float
) -> DataFrame:
    """The candidate cubes of each point at the next level, as far as they can still win."""
    small = [f"s{axis}" for axis in "xyz"]
    halves = (
        sites.withColumns(dict(zip(_CUBE, _cube_of("p", level - 1, radius))))
        .withColumns(dict(zip(small, _cube_of("p", level, radius))))
        .groupBy(*_CUBE, *small)
        .agg(F.min(F.struct("px", "py", "pz")).alias("known"))
    )
    edge = radius / 2**level
    outside = [
        F.greatest(
            F.col(s) * edge - F.col(f"q{axis}"),
            F.col(f"q{axis}") - (F.col(s) + 1) * edge,
            F.lit(0.0),
        )
        for axis, s in zip("xyz", small)
    ]
    to_known = _length([F.col(f"q{axis}") - F.col(f"known.p{axis}") for axis in "xyz"])
    reach = F.least(F.min(to_known).over(W.partitionBy("lat", "lon")), F.lit(radius))
    return (
        lookup(candidates, halves, _CUBE, "inner")
        .withColumn("reach", reach)
        .filter(_length(outside) <= F.col("reach") + _SLACK)
        .select("lat", "lon", "qx", "qy", "qz", *[F.col(s).alias(c) for s, c in zip(small, _CUBE)])
    )


def enrich_country(
    df: DataFrame,
    places: DataFrame,
    max_km: float = 500.0,
    lat: str = "artist_latitude",
    lon: str = "artist_longitude",
    per_cube: int = 64,
) -> DataFrame:
    """Add ``artist_country``; null where a coordinate is missing or nothing is near.

    ``places`` has ``place_id, lat, lon, country``.  Every different coordinate
    is looked up once, however many songs share it.
    """
    df = df.drop("artist_country")
    known = ~is_missing(df, lat) & ~is_missing(df, lon)
    keyed = df.withColumns({"_lat": F.when(known, F.col(lat)), "_lon": F.when(known, F.col(lon))})
    points = keyed.filter("_lat IS NOT NULL").selectExpr("_lat AS lat", "_lon AS lon").distinct()
    countries = nearest_country(points, places, max_km, per_cube).withColumnsRenamed(
        {"lat": "_lat", "lon": "_lon"}
    )
    return lookup(keyed, countries, ["_lat", "_lon"]).drop("_lat", "_lon")


def enrich_tags(
    df: DataFrame, artist_tags: DataFrame, name: str = "artist_name"
) -> DataFrame:
    """Set ``artist_genre``, the ordered tags of the artist; null where none are known.

    ``artist_tags`` has ``artist_name, tags``.  Empty lists say nothing; of
    several others for a name the smallest is taken.
    """
    tags = (
        artist_tags.filter(F.size("tags") > 0)
        .groupBy(F.col("artist_name").alias(name))
        .agg(F.min("tags").alias("artist_genre"))
    )
    df = df.drop("artist_genre")
    return lookup(df, tags, name).select(*df.columns, "artist_genre")
