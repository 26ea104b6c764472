"""Preparing features and labels for classification and clustering."""

from __future__ import annotations


from pyspark.ml.feature import (
    MinMaxScaler,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
    VectorIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songsift.functions.lists import first_listed, parse_list
from songsift.functions.numeric import round_int, shift_round
from songsift.operators.joins import lookup
from songsift.operators.quality import clip_outliers, drop_missing, drop_zero
from songsift.operators.ranks import number_rows
from songsift.schemas import GENRES
from songsift.session import settle


def assemble(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    """Numeric columns to one vector column; drop missing values first."""
    return VectorAssembler(inputCols=columns, outputCol=output).transform(df)


def standard_scale(
    df: DataFrame, columns: list[str], output: str = "scaledFeatures"
) -> DataFrame:
    """Add a vector of the columns with mean 0 and sample deviation 1."""
    assembled = assemble(df, columns)
    scaler = StandardScaler(inputCol="features", outputCol=output, withMean=True, withStd=True)
    return scaler.fit(assembled).transform(assembled)


def minmax_scale(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """Add ``<column>_sc``, the column scaled to [0, 1] and rounded."""
    assembled = assemble(df, columns, "_raw")
    scaled = (
        MinMaxScaler(inputCol="_raw", outputCol="_scaled").fit(assembled).transform(assembled)
    )
    values = vector_to_array("_scaled")
    return scaled.withColumns(
        {f"{c}_sc": F.round(values[i], digits) for i, c in enumerate(columns)}
    ).drop("_raw", "_scaled")


def round_features(df: DataFrame, loudness_shift: float = 100.0) -> DataFrame:
    """Duration and tempo to whole numbers; loudness shifted above zero, then rounded."""
    return df.withColumns(
        {
            "duration": round_int(F.col("duration")),
            "tempo": round_int(F.col("tempo")),
            "loudness": shift_round(F.col("loudness"), loudness_shift),
        }
    )


def song_label(df: DataFrame, vocabulary: list[str], terms: str = "artist_terms") -> Column:
    """The first of the song's own terms that is in ``vocabulary``; case matters."""
    is_text = isinstance(df.schema[terms].dataType, T.StringType)
    return first_listed(parse_list(F.col(terms)) if is_text else F.col(terms), vocabulary)


def derive_label(
    df: DataFrame,
    vocabulary: list[str] = GENRES,
    terms: str = "artist_terms",
    label: str = "filtered_genre",
) -> DataFrame:
    """Label the songs; those without a known term are dropped, and so is the term column."""
    return keep_labelled(df.withColumn(label, song_label(df, vocabulary, terms)), label).drop(terms)


def keep_labelled(df: DataFrame, label: str) -> DataFrame:
    """Keep rows whose label is there and not empty."""
    return df.filter(F.col(label) != "")


def index_label(
    df: DataFrame, label: str = "filtered_genre", vocabulary: list[str] | None = None
) -> DataFrame:
    """Add ``<label>_index``: 0 for the most frequent label, equal counts by name.

    Labels out of a ``vocabulary`` are few and may be held by the driver.  Without
    one there may be any number of them: they are counted, numbered and joined
    back by Spark, and a label with most of the rows does not matter.  A null
    label then has no index.
    """
    index = f"{label}_index"
    if vocabulary is not None:
        indexer = StringIndexer(inputCol=label, outputCol=index, stringOrderType="frequencyDesc")
        return indexer.fit(df).transform(df).withColumn(index, F.col(index).cast("int"))
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    numbered = number_rows(counts, [F.desc("_n"), F.asc(label)], output=index)
    numbers = numbered.select(label, F.col(index).cast("int").alias(index))
    return lookup(df, numbers, label).select(*df.columns, index)


def one_hot(df: DataFrame, index: str, output: str, drop_last: bool = True) -> DataFrame:
    """Add the one-hot vector of a small category index."""
    encoder = OneHotEncoder(inputCols=[index], outputCols=[output], dropLast=drop_last)
    return encoder.fit(df).transform(df)


def index_vector(max_categories: int = 20) -> VectorIndexer:
    """Pipeline stage that finds categorical features, to be fitted on training rows only."""
    return VectorIndexer(
        inputCol="features",
        outputCol="indexedFeatures",
        maxCategories=max_categories,
        handleInvalid="keep",
    )


def prepare_classification(
    df: DataFrame,
    vocabulary: list[str] = GENRES,
    durations: tuple[float, float] | None = None,
) -> DataFrame:
    """The classification frame: clean, round, scale, label and index the songs.

    Songs shorter or longer than ``durations`` are outliers and go first.

    The scaling range is taken over all clean songs, before unlabelled ones go.
    The catalogue is read and its terms are parsed once: the rounded and
    labelled songs are settled, and both fits run on that narrow table.
    """
    clean = drop_zero(
        drop_missing(
            df.select(
                "loudness", "tempo", "time_signature", "beats_start", "duration", "artist_terms"
            )
        ),
        "time_signature",
        "tempo",
    )
    if durations:
        clean = clip_outliers(clean, "duration", *durations)
    rounded = round_features(clean).select(
        "loudness",
        "tempo",
        "duration",
        "time_signature",
        song_label(clean, vocabulary).alias("filtered_genre"),
    )
    settled = settle(rounded, "rounded")
    scaled = minmax_scale(settled, ["loudness", "tempo", "duration"])
    return index_label(keep_labelled(scaled, "filtered_genre"), vocabulary=vocabulary)


def split_bucket(columns: list[str], buckets: int = 100) -> Column:
    """A number below ``buckets`` that depends on the row's values only."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets


def hash_split(
    df: DataFrame, key: list[str], share: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, the same ones in every run and on every cluster."""
    return split_at(df.withColumn("_bucket", split_bucket(key)), "_bucket", share)


def split_at(df: DataFrame, bucket: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The two sides by a stored ``split_bucket``, whose column is dropped."""
    limit = round(share * 100)
    train, test = df.filter(F.col(bucket) < limit), df.filter(F.col(bucket) >= limit)
    return train.drop(bucket), test.drop(bucket)
