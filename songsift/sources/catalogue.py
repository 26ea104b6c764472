"""The catalogue table: Parquet in, Parquet out, and its typed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songsift.functions.lists import parse_floats, parse_list
from songsift.schemas import CATALOGUE, SONG_GROUPS


def read_catalogue(
    spark: SparkSession, path: str, typed: bool = True, lists: bool = True
) -> DataFrame:
    """Scan a catalogue table; ``typed`` turns list text into arrays on the way.

    Columns are only renamed or parsed, never moved behind an opaque step, so
    column pruning and filters still reach the Parquet scan.  Without ``lists``
    list text stays as stored: the operators take either form, and count or
    compare the text before they parse what is left of it.
    """
    stored = spark.read.parquet(path)
    return typed_catalogue(stored, lists) if typed else stored


def typed_catalogue(df: DataFrame, lists: bool = True) -> DataFrame:
    """Bring every known catalogue column that ``df`` has to its logical type."""
    known = {
        field.name: field.dataType
        for field in CATALOGUE
        if lists or not isinstance(field.dataType, T.ArrayType)
    }
    return df.select(
        *[
            _typed(field, known[field.name]) if field.name in known else F.col(field.name)
            for field in df.schema
        ]
    )


def _typed(field: T.StructField, target: T.DataType) -> Column:
    column, stored = F.col(field.name), field.dataType
    if isinstance(target, T.ArrayType) and isinstance(stored, T.StringType):
        is_text = isinstance(target.elementType, T.StringType)
        column = parse_list(column) if is_text else parse_floats(column)
    elif isinstance(target, T.IntegralType) and isinstance(stored, T.IntegralType):
        return column  # a wider integer stays as it is: a cast would block filter pushdown
    elif stored != target:
        column = column.cast(target)
    return column.alias(field.name)


def write_catalogue(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite"
) -> None:
    """Write the catalogue as Parquet, replacing what is there or, with ``append``, adding to it."""
    df.write.mode(mode).partitionBy(*partition_by).option("compression", "zstd").parquet(path)


def write_by_artist(
    df: DataFrame, path: str, name: str, buckets: int, key: str = "artist_id"
) -> DataFrame:
    """Write the catalogue in buckets by ``key``, each file sorted by it, and read it as table ``name``.

    What groups or joins by artist then reads its buckets and needs no shuffle.
    An artist with very many songs is written by several tasks, and read as part
    of one bucket; where one artist holds a large share of all songs, an ordinary
    table serves better.  ``open_by_artist`` opens the table in another session.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    (
        df.hint("rebalance", buckets, F.col(key))
        .write.mode("overwrite")
        .format("parquet")
        .option("path", path)
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(name)
    )
    return spark.table(name)


def open_by_artist(
    spark: SparkSession, path: str, name: str, buckets: int, key: str = "artist_id"
) -> DataFrame:
    """The table that ``write_by_artist`` left at ``path``, with what it knows about its buckets."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    spark.sql(
        f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`)"
        f" INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def select_song_fields(df: DataFrame) -> DataFrame:
    """Pick the 25 catalogue fields out of nested song records."""
    return df.select(
        *[F.col(f"{group}.{name}") for group, names in SONG_GROUPS.items() for name in names]
    )


def decode_text_columns(df: DataFrame) -> DataFrame:
    """Read every binary column, and every array of binaries, as UTF-8 text; other bytes are an error."""

    def decoded(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.BinaryType):
            return F.validate_utf8(column.cast("string")).alias(field.name)
        if isinstance(field.dataType, T.ArrayType) and isinstance(
            field.dataType.elementType, T.BinaryType
        ):
            return F.transform(column.cast("array<string>"), F.validate_utf8).alias(field.name)
        return column

    return df.select(*[decoded(field) for field in df.schema])
