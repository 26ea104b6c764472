"""A song catalogue on top of the star-schema test tables.

Every column is one SQL expression that Spark and DuckDB read the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# column -> (tables it needs besides lineitem, expression)
COLUMNS: dict[str, tuple[str, str]] = {
    "song_id": ("", "'SO' || (l_orderkey * 10 + l_linenumber)"),
    "artist_id": ("orders", "'AR' || o_custkey"),
    "artist_name": ("orders customer", "c_name"),
    "artist_location": ("orders customer nation", "n_name"),
    "artist_latitude": (
        "orders",
        "CASE WHEN o_custkey % 11 = 0 THEN NULL "
        "WHEN o_custkey % 13 = 0 THEN CAST('NaN' AS DOUBLE) "
        "ELSE CAST(o_custkey * 3701 % 17000 AS DOUBLE) / 100 - 85 END",
    ),
    "artist_longitude": ("orders", "CAST(o_custkey * 7907 % 36000 AS DOUBLE) / 100 - 180"),
    "title": ("part", "p_name"),
    "duration": ("", "l_extendedprice / 100"),
    "loudness": ("", "-600 * l_discount"),
    "tempo": ("", "CASE WHEN l_quantity <= 2 THEN 0 ELSE l_quantity * 4 END"),
    "energy": ("", "l_tax"),
    "key": ("part", "CAST(p_size % 12 AS INT)"),
    "time_signature": ("", "CAST(l_linenumber % 7 AS INT)"),
    "year": (
        "orders",
        "CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE year(o_orderdate) END AS INT)",
    ),
    "artist_terms": (
        "part",
        "'[''' || replace(p_name, ' ', ''', ''') || ''', ''' || lower(p_type) || ''']'",
    ),
    "similar_artists": (
        "orders",
        "'[''AR0'', ''AR' || (o_custkey + 1) || ''', ''AR' || (o_custkey - o_custkey % 3)"
        " || ''', ''AR' || o_custkey || ''']'",
    ),
    "beats_start": (
        "",
        "'[' || l_linenumber || '. 0.' || l_suppkey || ' ... ' || (l_orderkey % 97) || '.5e-1 ]'",
    ),
    # The same numbers with gaps, for the operators that deal with missing values.
    "gappy_tempo": ("", "CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE l_quantity * 4 END"),
    "gappy_loudness": (
        "",
        "CASE WHEN l_suppkey % 19 = 0 THEN CAST('NaN' AS DOUBLE) "
        "WHEN l_suppkey % 23 = 0 THEN NULL ELSE -600 * l_discount END",
    ),
    "gappy_title": ("part", "CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE p_name END"),
}

# The words of the test titles that stand in for genres.
VOCABULARY = ["economy", "promo", "standard", "large", "medium"]

_JOINS = {
    "orders": "l_orderkey = o_orderkey",
    "customer": "o_custkey = c_custkey",
    "nation": "c_nationkey = n_nationkey",
    "part": "l_partkey = p_partkey",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(
    spark: SparkSession, sf_dir: str, *columns: str, of_part: dict[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """The catalogue with the given columns (all of them if none are named).

    Every song has its order, customer, nation and part, so a table that no
    column needs is not joined.  ``of_part`` names columns that need a song's part
    alone, and what to make of them: both are worked out on the rows of ``part``,
    once for all songs of a part.
    """
    columns, of_part = columns or tuple(COLUMNS), of_part or {}
    needed = {t for c in columns for t in COLUMNS[c][0].split()}
    songs = table(spark, sf_dir, "lineitem")
    if "orders" in needed:
        # Customer and nation are joined to the orders, which are fewer than the songs.
        orders = table(spark, sf_dir, "orders")
        for name in ("customer", "nation"):
            if name in needed:
                orders = orders.join(table(spark, sf_dir, name), F.expr(_JOINS[name]))
        songs = songs.join(orders, F.expr(_JOINS["orders"]))
    if "part" in needed:
        part = table(spark, sf_dir, "part")
        part = part.withColumns({f"_{c}": F.expr(COLUMNS[c][1]) for c in of_part})
        part = part.withColumns({f"_{c}": make(F.col(f"_{c}")) for c, make in of_part.items()})
        songs = songs.join(part, F.expr(_JOINS["part"]))
    return songs.select(*[(F.col(f"_{c}") if c in of_part else F.expr(COLUMNS[c][1])).alias(c) for c in columns])


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as artists with a fixed cluster; cluster 0 holds more than a third."""
    return table(spark, sf_dir, "customer").select(
        F.expr("'AR' || c_custkey").alias("artist_id"),
        F.col("c_name").alias("artist_name"),
        F.expr("CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 7 END AS INT)").alias(
            "prediction"
        ),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vectors, with their label as a fixed cluster."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("label").alias("prediction"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("scaledFeatures"),
    )


# Sums of doubles differ in their last bits with the order of the rows.  A mean of
# prices often ends on a 5, so it is moved off that edge before it is rounded.
_NUDGE = 1e-9


def near(column: Column | str) -> Column:
    """The value to six digits, the same on both engines."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + F.lit(_NUDGE), 6)


def near_sql(expression: str) -> str:
    return f"round({expression} + CAST({_NUDGE} AS DOUBLE), 6)"


CATALOGUE_SQL = (
    "catalogue AS (SELECT "
    + ", ".join(f'{expression} AS "{name}"' for name, (_, expression) in COLUMNS.items())
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    " JOIN part ON l_partkey = p_partkey)"
)

ARTISTS_SQL = (
    "artists AS (SELECT 'AR' || c_custkey AS artist_id, c_name AS artist_name, "
    "CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 7 END AS INTEGER) AS prediction "
    "FROM customer)"
)


def tokens_sql(column: str) -> str:
    """List text to a list, in DuckDB."""
    return f"""from_json(replace({column}, '''', '"'), '["VARCHAR"]')"""


def over_catalogue(body: str, *steps: str) -> str:
    """A query on the catalogue, with further named steps before it."""
    return "WITH " + ", ".join([CATALOGUE_SQL, *steps]) + " " + body
