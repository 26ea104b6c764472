"""Artists: features, known similar artists, and how well clusters match them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songsift.functions.lists import parse_list
from songsift.operators.clusters import fit_many, silhouette
from songsift.operators.kmeans import CentersModel
from songsift.operators.joins import lookup
from songsift.operators.quality import drop_na
from songsift.operators.ranks import number_rows
from songsift.schemas import ARTIST_CLUSTER_FEATURES


def artist_features(
    df: DataFrame, required: list[str] | None = ARTIST_CLUSTER_FEATURES
) -> DataFrame:
    """One row per artist: name, number of songs, means, first and last year.

    Numbers are first summed per (artist, name), in a hash aggregate that
    combines before the shuffle; only its small result is sorted for the name,
    the smallest one an artist has.  Year 0 means unknown and is left out.
    Artists that miss one of ``required`` are dropped.
    """
    means = {
        "avgSongDuration": "duration",
        "avgSongLoudness": "loudness",
        "avgTempo": "tempo",
        "avgLoudness": "loudness",
        "avgEnergy": "energy",
    }
    metrics = sorted(set(means.values()))
    year = F.when(F.col("year") != 0, F.col("year"))
    per_name = df.groupBy("artist_id", "artist_name").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(m).alias(f"sum_{m}") for m in metrics],
        *[F.count(m).alias(f"n_{m}") for m in metrics],
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
    )
    artists = per_name.groupBy("artist_id").agg(
        F.min("artist_name").alias("artist_name"),
        F.sum("n").alias("nbSong"),
        *[
            (F.sum(f"sum_{m}") / F.nullif(F.sum(f"n_{m}"), F.lit(0))).alias(name)
            for name, m in means.items()
        ],
        F.min("first_year").alias("yearFirstSong"),
        F.max("last_year").alias("yearLastSong"),
    )
    return drop_na(artists, required) if required else artists


def ground_truth(df: DataFrame) -> DataFrame:
    """``artist_id, similar_artists``: the artist's known similar artists as an array.

    The songs of an artist mostly carry the same long list, so equal lists are
    merged by hash first, and each is parsed once.  Empty lists say nothing; of
    several others the one of the song with the smallest ``song_id`` is taken,
    and the smaller list if one song has two.
    """
    lists = (
        df.filter(F.col("similar_artists").isNotNull())
        .groupBy("artist_id", "similar_artists")
        .agg(F.min("song_id").alias("song_id"))
    )
    if isinstance(df.schema["similar_artists"].dataType, T.StringType):
        lists = lists.withColumn("similar_artists", parse_list(F.col("similar_artists")))
    chosen = F.min_by("similar_artists", F.struct("song_id", "similar_artists"))
    return (
        lists.filter(F.size("similar_artists") > 0)
        .groupBy("artist_id")
        .agg(chosen.alias("similar_artists"))
    )


def truth_edges(
    truth: DataFrame, assignments: DataFrame, predictions: list[str]
) -> DataFrame:
    """Each known pair (artist, similar artist) with a flag per prediction column.

    The flag says that both ends are in the same cluster.  The work is one row
    per known pair: no list of cluster members is built.  A similar artist named
    by very many others is a hot key and is spread by ``lookup``.
    """
    size = F.greatest(F.coalesce(F.size("similar_artists"), F.lit(0)), F.lit(1))
    edges = (
        truth.join(assignments.select("artist_id", *predictions), "artist_id")
        .withColumn("listed", size)
        .withColumn("similar_id", F.explode_outer(F.array_distinct("similar_artists")))
        .drop("similar_artists")
    )
    others = assignments.select(
        F.col("artist_id").alias("similar_id"),
        *[F.col(p).alias(f"other_{p}") for p in predictions],
    )
    joined = lookup(edges, others, "similar_id")

    def same(prediction: str) -> Column:
        return F.coalesce(
            (F.col(prediction) == F.col(f"other_{prediction}"))
            & (F.col("artist_id") != F.col("similar_id")),
            F.lit(False),
        )

    return joined.select(
        "artist_id", "similar_id", "listed", *[same(p).alias(f"same_{p}") for p in predictions]
    )


def cluster_peers(
    truth: DataFrame, assignments: DataFrame
) -> DataFrame:
    """The known similar artists that share the artist's cluster, the artist itself left out.

    The full peer list of every artist would be quadratic in the cluster size;
    ``peers_of`` gives it for one artist.
    """
    edges = truth_edges(truth, assignments, ["prediction"])
    return edges.filter("same_prediction").select("artist_id", "similar_id")


def peers_of(assignments: DataFrame, artist_id: str) -> DataFrame:
    """Everyone in the cluster of one artist, without the artist."""
    own = assignments.filter(F.col("artist_id") == artist_id).select("prediction").limit(1)
    return assignments.join(F.broadcast(own), "prediction", "left_semi").filter(
        F.col("artist_id") != artist_id
    )


def peer_index(assignments: DataFrame) -> DataFrame:
    """``prediction``, ``artist_id`` and ``place``, the artist's number in its cluster, by id.

    Settle it to take pages from it: it is stored in the order of cluster and id,
    so a page is read without the others.
    """
    members = assignments.select("prediction", "artist_id").distinct()
    return number_rows(members, [F.asc("artist_id")], ("prediction",), "place")


def peer_pages(index: DataFrame, size: int = 1000) -> DataFrame:
    """The pages of all clusters: ``prediction``, ``page``, its first and last artist and their number.

    The peers of all artists are quadratic in the size of a cluster; these pages
    hold them once for a whole cluster.  Every member is on exactly one page.
    """
    page = F.floor(F.col("place") / size).alias("page")
    return index.groupBy("prediction", page).agg(
        F.min("artist_id").alias("first"),
        F.max("artist_id").alias("last"),
        F.count(F.lit(1)).alias("artists"),
    )


def peers_on_page(index: DataFrame, artist_id: str, page: int, size: int = 1000) -> DataFrame:
    """The peers of one artist that are on one page of its cluster, in order, without the artist."""
    own = index.filter(F.col("artist_id") == artist_id).select("prediction").limit(1)
    there = F.col("place").between(page * size, (page + 1) * size - 1)
    return (
        index.filter(there & (F.col("artist_id") != artist_id))
        .join(F.broadcast(own), "prediction", "left_semi")
        .orderBy("place")
    )


def _scores(
    truth: DataFrame, assignments: DataFrame, predictions: list[str]
) -> DataFrame:
    edges = truth_edges(truth, assignments, predictions)
    return edges.groupBy("artist_id", "listed").agg(
        *[
            (100.0 * F.count_if(f"same_{p}") / F.col("listed")).alias(f"pct_{p}")
            for p in predictions
        ]
    )


def score_overlap(
    truth: DataFrame, assignments: DataFrame
) -> DataFrame:
    """Per artist, the percentage of its known similar artists found in its cluster."""
    return _scores(truth, assignments, ["prediction"]).select(
        "artist_id", F.col("pct_prediction").alias("percent")
    )


def overlap_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("percent").alias("avgPercent"), F.max("percent").alias("maxPercent"))


def _evaluate(
    df: DataFrame, truth: DataFrame, predictions: list[str]
) -> list[tuple[float, float, float]]:
    """Average cluster size, average and maximum overlap for each prediction column."""
    sizes = df.agg(
        *[
            # The set holds cluster numbers, of which there are at most k.
            (F.count(p) / F.size(F.collect_set(p))).alias(p)
            for p in predictions
        ]
    ).first()
    scores = _scores(truth, df.select("artist_id", *predictions), predictions)
    overlap = scores.agg(
        *[F.avg(f"pct_{p}").alias(f"avg_{p}") for p in predictions],
        *[F.max(f"pct_{p}").alias(f"max_{p}") for p in predictions],
    ).first()
    return [(sizes[p], overlap[f"avg_{p}"], overlap[f"max_{p}"]) for p in predictions]


def evaluate_clusters(
    df: DataFrame,
    truth: DataFrame,
    features: str = "scaledFeatures",
) -> DataFrame:
    """One row: average artists per cluster, silhouette, average and maximum overlap."""
    size, average, largest = _evaluate(df, truth, ["prediction"])[0]
    return df.sparkSession.createDataFrame(
        [(size, float(silhouette(df, features)), average, largest)],
        "avgArtistsPerCluster double, silhouette double, avgPercent double, maxPercent double",
    )


def artist_sweep(
    artists: DataFrame,
    truth: DataFrame,
    ks: list[int],
    features: str = "scaledFeatures",
    seed: int = 1,
    parallelism: int = 1,
) -> tuple[DataFrame, dict[int, CentersModel]]:
    """The scores of ``evaluate_clusters`` for several k, and the models.

    All k are scored in one pass over the known pairs, and their silhouettes are
    taken together.  ``artists`` should be
    settled, since it is read more than once.
    """
    assigned, models, silhouettes = fit_many(
        artists.select("artist_id", features), ks, features, seed, parallelism
    )
    scores = _evaluate(assigned, truth, [f"k{k}" for k in ks])
    rows = [
        (k, size, silhouettes[k], average, largest)
        for k, (size, average, largest) in zip(ks, scores)
    ]
    table = artists.sparkSession.createDataFrame(
        rows,
        "k int, avgArtistsPerCluster double, silhouette double, "
        "avgPercent double, maxPercent double",
    )
    return table, models
