"""Cluster scoring on fixed clusters, and fitted clusterings."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from songsift.functions.lists import overlap_pct, parse_list, without
from songsift.operators.clusters import (
    attach_predictions,
    avg_cluster_size,
    best_k,
    cluster_centers,
    cluster_members,
    cluster_names,
    cluster_profile,
    cluster_sizes,
    filter_cluster,
    fit_kmeans,
    playlist,
    silhouette,
    sweep_k,
)
from songsift.operators.counts import count_by, top_k
from songsift.operators.similarity import (
    artist_features,
    artist_sweep,
    cluster_peers,
    evaluate_clusters,
    ground_truth,
    overlap_summary,
    peers_of,
    score_overlap,
)
from songsift.plans.artists import artist_vectors, compare_artist_clusterings
from songsift.plans.playlists import cluster_songs, song_vectors
from songsift.registry import query
from songsift.registry.data import (
    ARTISTS_SQL,
    CATALOGUE_SQL,
    artists,
    catalogue,
    near,
    near_sql,
    over_catalogue,
    table,
    tokens_sql,
    vectors,
)
from songsift.schemas import ARTIST_CLUSTER_FEATURES, SONG_CLUSTER_FEATURES
from songsift.session import settle

_ARTIST_COLUMNS = "artist_id artist_name duration energy loudness tempo year".split()



def _truth_sql(source: str) -> str:
    return (
        f"truth AS (SELECT artist_id, {tokens_sql('named')} AS similar_artists FROM"
        " (SELECT artist_id, min_by(similar_artists, song_id) AS named"
        f" FROM {source} WHERE len({tokens_sql('similar_artists')}) > 0 GROUP BY artist_id))"
    )


TRUTH = _truth_sql("catalogue")
# Some songs with an empty list, some with another one than the artist's other songs.
_UNEVEN = (
    "CASE WHEN time_signature IN (1, 2) THEN '[]' WHEN time_signature = 3"
    " THEN '[''AR9'', ''' || artist_id || ''']' ELSE similar_artists END"
)
FEATURES = (
    "features AS (SELECT artist_id, min(artist_name) AS artist_name, count(*) AS nbSong,"
    " avg(duration) AS avgSongDuration, avg(loudness) AS avgSongLoudness, avg(tempo) AS avgTempo,"
    " min(nullif(year, 0)) AS yearFirstSong, max(nullif(year, 0)) AS yearLastSong,"
    " avg(loudness) AS avgLoudness, avg(energy) AS avgEnergy FROM catalogue GROUP BY artist_id)"
)
EDGES = (
    "edges AS (SELECT DISTINCT artist_id, len(similar_artists) AS listed,"
    " unnest(similar_artists) AS similar_id FROM truth)"
)
SCORES = (
    "scores AS (SELECT edges.artist_id, 100.0 * count(*) FILTER (a.prediction = o.prediction"
    " AND edges.artist_id <> similar_id) / listed AS percent FROM edges"
    " JOIN artists a ON a.artist_id = edges.artist_id"
    " LEFT JOIN artists o ON o.artist_id = similar_id GROUP BY edges.artist_id, listed)"
)
_OVERLAP = (ARTISTS_SQL, TRUTH, EDGES, SCORES)


def silhouette_sql(points: str, dims: int) -> str:
    """The squared-Euclidean silhouette in closed form, from per-cluster sums.

    ``points`` is a query giving ``prediction`` and the list ``x``.
    """
    return f"""
    points AS ({points}),
    cells AS (SELECT prediction, i, sum(x[i]) AS s, sum(x[i] * x[i]) AS q, count(*) AS n
              FROM points, range(1, {dims} + 1) r(i) GROUP BY prediction, i),
    clusters AS (SELECT prediction, max(n) AS n, sum(q) AS q, list(s ORDER BY i) AS s
                 FROM cells GROUP BY prediction),
    numbered AS (SELECT row_number() OVER () AS rid, * FROM points),
    totals AS (SELECT rid, p.prediction AS own, c.prediction AS other, c.n,
                 list_dot_product(x, x) * c.n + c.q - 2 * list_dot_product(x, c.s) AS d
               FROM numbered p, clusters c),
    sides AS (SELECT rid, max(n) FILTER (own = other) AS size,
                max(d) FILTER (own = other) / greatest(max(n) FILTER (own = other) - 1, 1) AS a,
                min(d / n) FILTER (own <> other) AS b
              FROM totals GROUP BY rid),
    silhouettes AS (SELECT avg(CASE WHEN size = 1 THEN 0 WHEN a < b THEN 1 - a / b
                      WHEN a > b THEN b / a - 1 ELSE 0 END) AS silhouette FROM sides)"""


_EMBEDDED = (
    "SELECT label AS prediction, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x"
    " FROM embeddings"
)


def _truth(spark, sf_dir):
    songs = catalogue(spark, sf_dir, "artist_id", "song_id", "similar_artists")
    return settle(ground_truth(songs), "truth")


def _one_value(spark, value, name):
    return spark.createDataFrame([(float(value),)], f"{name} double").withColumn(
        name, near(name)
    )


@query(
    over_catalogue(
        "SELECT artist_id, artist_name, nbSong, "
        + ", ".join(f"{near_sql(c)} AS {c}" for c in ARTIST_CLUSTER_FEATURES)
        + ", yearFirstSong, yearLastSong FROM features",
        FEATURES,
    ),
    "artist_features",
)
def artist_frame(spark, sf_dir):
    frame = artist_features(catalogue(spark, sf_dir, *_ARTIST_COLUMNS))
    return frame.withColumns({c: near(c) for c in ARTIST_CLUSTER_FEATURES})


@query(
    over_catalogue(
        "SELECT artist_id, array_to_string(similar_artists, '|') AS similar_artists FROM truth",
        TRUTH,
    ),
    "ground_truth",
)
def known_similar_artists(spark, sf_dir):
    return _truth(spark, sf_dir).withColumn("similar_artists", F.array_join("similar_artists", "|"))


@query(
    over_catalogue(
        "SELECT artist_id, array_to_string(similar_artists, '|') AS similar_artists FROM truth",
        f"uneven AS (SELECT artist_id, song_id, {_UNEVEN} AS similar_artists FROM catalogue)",
        _truth_sql("uneven"),
    )
)
def ground_truth_typed(spark, sf_dir):
    """From arrays, with empty and several lists for an artist."""
    songs = catalogue(spark, sf_dir, "artist_id", "song_id", "similar_artists", "time_signature")
    typed = songs.withColumn("similar_artists", parse_list(F.expr(_UNEVEN)))
    return ground_truth(typed).withColumn("similar_artists", F.array_join("similar_artists", "|"))


@query(
    f'WITH {ARTISTS_SQL} SELECT prediction, count(*) AS "count" FROM artists GROUP BY prediction',
    "cluster_sizes",
)
def sizes_of_clusters(spark, sf_dir):
    return cluster_sizes(artists(spark, sf_dir))


@query(
    f"WITH {ARTISTS_SQL} SELECT {near_sql('avg(n)')} AS \"avgPerCluster\" FROM"
    " (SELECT count(*) AS n FROM artists GROUP BY prediction)",
    "avg_cluster_size",
)
def mean_cluster_size(spark, sf_dir):
    return avg_cluster_size(artists(spark, sf_dir)).withColumn(
        "avgPerCluster", near("avgPerCluster")
    )


@query(
    over_catalogue(
        f'SELECT prediction, count(*) AS "count", {near_sql("avg(avgTempo)")} AS "avg_avgTempo",'
        f' {near_sql("avg(avgEnergy)")} AS "avg_avgEnergy" FROM features JOIN artists'
        " USING (artist_id) GROUP BY prediction",
        ARTISTS_SQL,
        FEATURES,
    ),
    "cluster_profile",
)
def profile_of_clusters(spark, sf_dir):
    frame = artist_features(catalogue(spark, sf_dir, *_ARTIST_COLUMNS)).drop("artist_name")
    profile = cluster_profile(
        frame.join(artists(spark, sf_dir), "artist_id"), ["avgTempo", "avgEnergy"]
    )
    return profile.withColumns({c: near(c) for c in ("avg_avgTempo", "avg_avgEnergy")})


@query(
    f"WITH {ARTISTS_SQL}, lists AS (SELECT prediction, CAST(ceil(count(*) / 50.0) AS BIGINT) AS n"
    " FROM artists GROUP BY prediction) SELECT prediction, list,"
    " string_agg(artist_id, '|' ORDER BY artist_id) AS members FROM (SELECT prediction, artist_id,"
    " CAST(CAST('0x' || substr(md5(artist_id), 1, 8) AS BIGINT) % 2147483648 % n AS INTEGER)"
    " AS list"
    " FROM artists JOIN lists USING (prediction)) GROUP BY prediction, list",
    "cluster_members",
)
def members_of_clusters(spark, sf_dir):
    lists = cluster_members(artists(spark, sf_dir), "artist_id", per_list=50)
    return lists.withColumn("members", F.array_join("members", "|"))


@query(
    f"WITH {ARTISTS_SQL}, named AS (SELECT DISTINCT prediction, artist_name FROM artists), lists AS"
    " (SELECT prediction, CAST(ceil(count(*) / 10000.0) AS BIGINT) AS n FROM named GROUP BY 1)"
    " SELECT prediction, list, string_agg(artist_name, '|' ORDER BY artist_name) AS names"
    " FROM (SELECT prediction, artist_name, CAST(CAST('0x' || substr(md5(artist_name), 1, 8)"
    " AS BIGINT) % 2147483648 % n AS INTEGER) AS list FROM named JOIN lists USING (prediction))"
    " GROUP BY prediction, list",
    "cluster_names",
)
def names_of_clusters(spark, sf_dir):
    return cluster_names(artists(spark, sf_dir)).withColumn("names", F.array_join("names", "|"))


@query(
    over_catalogue(
        "SELECT edges.artist_id, similar_id FROM edges JOIN artists a USING (artist_id)"
        " JOIN artists o ON o.artist_id = similar_id"
        " WHERE a.prediction = o.prediction AND edges.artist_id <> similar_id",
        ARTISTS_SQL,
        TRUTH,
        EDGES,
    ),
    "cluster_peers",
)
def known_peers(spark, sf_dir):
    return cluster_peers(_truth(spark, sf_dir), artists(spark, sf_dir))


@query(
    over_catalogue(
        "SELECT artists.* FROM artists, busiest WHERE artists.artist_id <> busiest.artist_id AND"
        " prediction = (SELECT prediction FROM artists JOIN busiest USING (artist_id))",
        ARTISTS_SQL,
        "busiest AS (SELECT artist_id FROM catalogue GROUP BY artist_id"
        " ORDER BY count(*) DESC, artist_id LIMIT 1)",
    )
)
def peers_of_busiest_artist(spark, sf_dir):
    songs = count_by(catalogue(spark, sf_dir, "artist_id"), "artist_id")
    busiest = top_k(songs, 1, "count", "artist_id").first()["artist_id"]
    return peers_of(artists(spark, sf_dir), busiest)


@query(
    f"WITH {ARTISTS_SQL} SELECT artist_id, artist_name, prediction FROM artists"
    " WHERE prediction = 0",
    "filter_cluster",
)
def rows_of_cluster(spark, sf_dir):
    return filter_cluster(artists(spark, sf_dir), 0)


@query(over_catalogue(f"SELECT artist_id, {near_sql('percent')} AS percent FROM scores", *_OVERLAP))
def overlap_score(spark, sf_dir):
    scores = score_overlap(_truth(spark, sf_dir), artists(spark, sf_dir))
    return scores.withColumn("percent", near("percent"))


@query(
    over_catalogue(
        f'SELECT {near_sql("avg(percent)")} AS "avgPercent",'
        f' {near_sql("max(percent)")} AS "maxPercent"'
        " FROM scores",
        *_OVERLAP,
    ),
    "overlap_summary",
)
def overlap_mean_max(spark, sf_dir):
    summary = overlap_summary(score_overlap(_truth(spark, sf_dir), artists(spark, sf_dir)))
    return summary.withColumns({c: near(c) for c in ("avgPercent", "maxPercent")})


@query(
    over_catalogue(
        "SELECT song_id, artist_id, array_to_string(list_filter(named,"
        " lambda s: s <> artist_id), '|') AS others, "
        + near_sql(
            "100.0 * len(list_distinct(list_filter(named, lambda s: list_contains(terms, s))))"
            " / greatest(len(named), 1)"
        )
        + " AS percent"
        f" FROM (SELECT song_id, artist_id, {tokens_sql('similar_artists')} AS named,"
        " ['AR0', artist_id, 'AR7'] AS terms FROM catalogue)"
    )
)
def list_overlap(spark, sf_dir):
    songs = catalogue(spark, sf_dir, "song_id", "artist_id", "similar_artists")
    similar = parse_list(F.col("similar_artists"))
    wanted = F.array(F.lit("AR0"), F.col("artist_id"), F.lit("AR7"))
    return songs.select(
        "song_id",
        "artist_id",
        F.array_join(without(similar, F.col("artist_id")), "|").alias("others"),
        near(overlap_pct(similar, wanted)).alias("percent"),
    )


@query(
    "WITH "
    + silhouette_sql(_EMBEDDED, 64)
    + f" SELECT {near_sql('silhouette')} AS silhouette FROM silhouettes"
)
def silhouette_fixed(spark, sf_dir):
    return _one_value(spark, silhouette(vectors(spark, sf_dir)), "silhouette")


_STANDARD = ", ".join(
    f"({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0)"
    for c in ARTIST_CLUSTER_FEATURES
)


@query(
    f"WITH {CATALOGUE_SQL}, {ARTISTS_SQL}, {TRUTH}, {EDGES}, {SCORES}, {FEATURES}, "
    + silhouette_sql(
        f"SELECT prediction, [{_STANDARD}] AS x FROM features JOIN artists USING (artist_id)", 5
    )
    + f' SELECT (SELECT {near_sql("avg(n)")} FROM (SELECT count(*) AS n FROM artists JOIN features'
    ' USING (artist_id) GROUP BY prediction)) AS "avgArtistsPerCluster",'
    f" (SELECT {near_sql('silhouette')} FROM silhouettes) AS silhouette,"
    f' {near_sql("avg(percent)")} AS "avgPercent", {near_sql("max(percent)")} AS "maxPercent"'
    " FROM scores"
)
def cluster_eval_fixed(spark, sf_dir):
    scaled = artist_vectors(catalogue(spark, sf_dir, *_ARTIST_COLUMNS)).drop("artist_name")
    assigned = scaled.join(artists(spark, sf_dir), "artist_id")
    result = evaluate_clusters(assigned, _truth(spark, sf_dir))
    return result.withColumns({c: near(c) for c in result.columns})


@query(
    over_catalogue(
        "SELECT artist_name, title, round(duration, 6) AS duration, tempo FROM catalogue"
        " JOIN (SELECT artist_id, prediction FROM artists) USING (artist_id) WHERE prediction = 0"
        " ORDER BY song_id, artist_name, title, duration LIMIT 20",
        ARTISTS_SQL,
    )
)
def playlist_fixed(spark, sf_dir):
    columns = ["artist_name", "title", "duration", "tempo"]
    songs = catalogue(spark, sf_dir, "song_id", "artist_id", *columns).join(
        artists(spark, sf_dir).drop("artist_name"), "artist_id"
    )
    songs = playlist(songs, 0, 20, columns, "song_id", "artist_name", "title", "duration")
    return songs.withColumn("duration", F.round("duration", 6))


@query(
    "SELECT CAST(label AS INTEGER) AS k, CAST(count(*) % 3 AS DOUBLE) AS silhouette"
    " FROM embeddings GROUP BY label ORDER BY silhouette DESC, k LIMIT 1"
)
def best_k_fixed(spark, sf_dir):
    counts = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").count()
    return best_k(
        counts.select(
            F.col("label").cast("int").alias("k"),
            (F.col("count") % 3).cast("double").alias("silhouette"),
        )
    )


def _embedding_model(spark, sf_dir, k=10):
    points = settle(vectors(spark, sf_dir).drop("prediction"), "embeddings", spread=True)
    return points, fit_kmeans(points, k)


@query("SELECT CAST(10 AS BIGINT) AS clusters, count(*) AS points FROM embeddings")
def kmeans_embeddings(spark, sf_dir):
    """All clusters have points, and every point has a cluster."""
    points, model = _embedding_model(spark, sf_dir)
    sizes = cluster_sizes(attach_predictions(points, model)).filter(
        F.col("prediction").between(0, 9) & (F.col("count") > 0)
    )
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), F.sum("count").alias("points"))


@query(
    "SELECT CAST(c AS INTEGER) AS cluster, 'x' || i AS feature, true AS inside"
    " FROM range(10) t(c), range(64) u(i) WHERE (SELECT count(*) FROM embeddings) > 0"
)
def kmeans_centers(spark, sf_dir):
    """A centre is a mean, so it lies between the least and the largest value of each feature."""
    points, model = _embedding_model(spark, sf_dir)
    names = [f"x{i}" for i in range(64)]
    values = points.select(F.posexplode(vector_to_array("scaledFeatures")).alias("i", "v"))
    ranges = values.groupBy(F.concat(F.lit("x"), F.col("i")).alias("feature")).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    inside = F.col("value").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9)
    centers = cluster_centers(points, model, names).join(ranges, "feature")
    return centers.select("cluster", "feature", inside.alias("inside"))


@query(
    "SELECT count(*) AS points, CAST(0 AS BIGINT) AS misplaced, CAST(10 AS BIGINT) AS clusters"
    " FROM embeddings"
)
def kmeans_nearest_center(spark, sf_dir):
    """Every point must lie in the cluster of its nearest centre, and all clusters be used."""
    points, model = _embedding_model(spark, sf_dir)
    centers = F.array(
        *[F.array(*[F.lit(float(v)) for v in center]) for center in model.clusterCenters()]
    )

    def distance(center):
        squares = F.zip_with("x", center, lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0.0), lambda total, square: total + square)

    distances = F.transform(centers, distance)
    own = F.get("distances", F.col("prediction"))
    return (
        attach_predictions(points, model)
        .select("prediction", vector_to_array("scaledFeatures").alias("x"))
        .select("prediction", distances.alias("distances"))
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.count_if(own > F.array_min("distances") + 1e-9).alias("misplaced"),
            F.size(F.collect_set("prediction")).cast("bigint").alias("clusters"),
        )
    )


@query(
    "SELECT CAST(k AS INTEGER) AS k, true AS in_range, true AS agrees FROM range(2, 13) t(k)"
    " WHERE (SELECT count(*) FROM lineitem) > 0"
)
def k_sweep(spark, sf_dir):
    """The silhouettes lie in [-1, 1]; the best one is that of the library's own evaluator."""
    points = song_vectors(catalogue(spark, sf_dir, *SONG_CLUSTER_FEATURES))
    sweep, assigned = cluster_songs(points, parallelism=4)
    largest = best_k(sweep).first()["silhouette"]
    agrees = abs(silhouette(assigned) - largest) < 1e-9
    in_range = F.col("silhouette").between(-1, 1)
    return sweep.select("k", in_range.alias("in_range"), F.lit(agrees).alias("agrees"))


@query("SELECT CAST(20 AS BIGINT) AS songs, CAST(20 AS BIGINT) AS known FROM lineitem LIMIT 1")
def playlist_kmeans(spark, sf_dir):
    """Twenty songs of one cluster, all of them in the catalogue."""
    columns = ["artist_name", "title", "duration", "tempo"]
    keep = ("song_id", "artist_name", "title")
    songs = catalogue(spark, sf_dir, *keep, *SONG_CLUSTER_FEATURES)
    _, clustered = cluster_songs(song_vectors(songs, keep=keep), parallelism=4)
    listed = playlist(clustered, 0, 20, columns, "song_id", "artist_name", "title", "duration")
    listed = settle(listed, "playlist")
    known = listed.join(songs, columns, "left_semi")
    return listed.agg(F.count(F.lit(1)).alias("songs")).withColumn("known", F.lit(known.count()).cast("bigint"))


def _song_profile(spark, sf_dir):
    points = song_vectors(catalogue(spark, sf_dir, *SONG_CLUSTER_FEATURES))
    songs = attach_predictions(points, fit_kmeans(points, 4))
    return cluster_profile(songs, SONG_CLUSTER_FEATURES)


@query(
    "SELECT CAST(c AS INTEGER) AS prediction, true AS inside FROM range(4) t(c)"
    " WHERE (SELECT count(*) FROM lineitem) > 0"
)
def kmeans_song_profile(spark, sf_dir):
    """Every cluster's means lie between the least and the largest values of all songs."""
    ends = catalogue(spark, sf_dir, *SONG_CLUSTER_FEATURES).agg(
        *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in SONG_CLUSTER_FEATURES]
    )
    ends = ends.first()
    inside = [F.col(f"avg_{c}").between(ends[c]["lo"], ends[c]["hi"]) for c in SONG_CLUSTER_FEATURES]
    return _song_profile(spark, sf_dir).select("prediction", reduce(and_, inside).alias("inside"))


@query(
    over_catalogue(
        'SELECT count(*) AS songs, CAST(4 AS BIGINT) AS clusters, '
        + ", ".join(f'{near_sql(f"""avg("{c}")""")} AS "{c}"' for c in SONG_CLUSTER_FEATURES)
        + " FROM catalogue"
    )
)
def kmeans_profile_total(spark, sf_dir):
    """The cluster means, weighted by size, give the means of all songs."""
    total = F.sum("count")
    return _song_profile(spark, sf_dir).agg(
        total.alias("songs"),
        F.count(F.lit(1)).alias("clusters"),
        *[
            near(F.sum(F.col("count") * F.col(f"avg_{c}")) / total).alias(c)
            for c in SONG_CLUSTER_FEATURES
        ],
    )


@query(
    "SELECT CAST(k AS INTEGER) AS k, true AS silhouette_in_range, true AS overlap_in_range,"
    " true AS size_fits FROM (SELECT unnest([5, 10, 20, 50, 100]) AS k)"
    " WHERE (SELECT count(*) FROM lineitem) > 0",
    "artist_sweep",
)
def artist_cluster_sweep(spark, sf_dir):
    """What must hold for each k, whatever the fit."""
    songs = catalogue(spark, sf_dir, *_ARTIST_COLUMNS, "song_id", "similar_artists")
    found = settle(artist_features(songs), "features")
    sweep = compare_artist_clusterings(songs, parallelism=4, artists=found)
    total = found.count()
    size, average, largest = (
        F.col(c) for c in ("avgArtistsPerCluster", "avgPercent", "maxPercent")
    )
    return sweep.select(
        "k",
        F.col("silhouette").between(-1, 1).alias("silhouette_in_range"),
        (average.between(0, largest) & largest.between(0, 100)).alias("overlap_in_range"),
        # A fit may leave some of the k clusters empty, never make more.
        size.between(total / F.col("k") - 1e-9, total).alias("size_fits"),
    )


# Five groups of points, far apart, and five of artists.
_GROUPS, _GAP = 5, 40.0
_PLANTED_SQL = (
    f"planted AS (SELECT CAST(vec_id % {_GROUPS} AS INTEGER) AS prediction, list_transform(embedding, lambda v, i:"
    f" CAST(v AS DOUBLE) + CASE WHEN i - 1 = vec_id % {_GROUPS} THEN {_GAP} ELSE 0 END) AS x FROM embeddings)"
)


def _planted(spark, sf_dir):
    """Embeddings moved apart by group."""
    moved = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda v, i: v + F.when(i == F.col("vec_id") % _GROUPS, F.lit(_GAP)).otherwise(0.0),
    )
    points = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % _GROUPS).cast("int").alias("planted"), array_to_vector(moved).alias("scaledFeatures")
    )
    return settle(points, "planted", spread=True)


@query(
    f"WITH {_PLANTED_SQL} SELECT prediction AS planted, 'x' || (i - 1) AS feature,"
    f" {near_sql('avg(x[i])')} AS value, count(*) AS points FROM planted, range(1, 65) t(i) GROUP BY prediction, i"
)
def planted_centers(spark, sf_dir):
    """k-means must find planted groups: a row for each pair of cluster and group, with the cluster's centre."""
    points = _planted(spark, sf_dir)
    model = fit_kmeans(points, _GROUPS)
    pairs = attach_predictions(points, model).groupBy("prediction", "planted").agg(F.count(F.lit(1)).alias("points"))
    centers = cluster_centers(points, model, [f"x{i}" for i in range(64)])
    return centers.join(pairs, F.col("cluster") == F.col("prediction")).select(
        "planted", "feature", near("value").alias("value"), "points"
    )


@query(
    f"WITH {_PLANTED_SQL}, "
    + silhouette_sql("SELECT * FROM planted", 64)
    + f" SELECT CAST({_GROUPS} AS INTEGER) AS k, {near_sql('silhouette')} AS silhouette FROM silhouettes"
)
def planted_sweep(spark, sf_dir):
    """The best of 2 to 12 clusters are the planted ones, with their silhouette."""
    sweep, _ = sweep_k(_planted(spark, sf_dir), list(range(2, 13)), parallelism=4)
    return best_k(sweep).withColumn("silhouette", near("silhouette"))


_GROUPED = (
    "grouped AS (SELECT artist_id, CAST(c_custkey % 5 AS INTEGER) AS prediction,"
    " list_transform(range(5), lambda g: CASE WHEN g = c_custkey % 5 THEN 40.0 ELSE 0.0 END"
    " + ((c_custkey * (g + 3)) % 97) / 97.0) AS x FROM artists JOIN customer ON 'AR' || c_custkey = artist_id)"
)


@query(
    f"WITH {CATALOGUE_SQL}, {TRUTH}, {EDGES}, artists AS (SELECT 'AR' || c_custkey AS artist_id,"
    " CAST(c_custkey % 5 AS INTEGER) AS prediction FROM customer),"
    f" {SCORES}, {_GROUPED}, "
    + silhouette_sql("SELECT prediction, x FROM grouped", 5)
    + ' SELECT CAST(5 AS INTEGER) AS k, (SELECT avg(n) FROM (SELECT count(*) AS n FROM artists GROUP BY prediction))'
    f' AS "avgArtistsPerCluster", (SELECT {near_sql("silhouette")} FROM silhouettes) AS silhouette,'
    f' {near_sql("avg(percent)")} AS "avgPercent", {near_sql("max(percent)")} AS "maxPercent" FROM scores'
)
def planted_artist_sweep(spark, sf_dir):
    """Artists in planted groups, swept over several k: the scores at the planted one."""
    group = F.col("c_custkey") % 5
    x = [
        F.when(group == g, 40.0).otherwise(0.0) + (F.col("c_custkey") * (g + 3)) % 97 / 97.0 for g in range(5)
    ]
    artists_ = table(spark, sf_dir, "customer").select(
        F.expr("'AR' || c_custkey").alias("artist_id"), array_to_vector(F.array(*x)).alias("scaledFeatures")
    )
    truth = settle(_truth(spark, sf_dir), "truth")
    scores, _ = artist_sweep(settle(artists_, "artists", spread=True), truth, [5, 10, 20], parallelism=3)
    scores = scores.filter("k = 5")
    return scores.withColumns({c: near(c) for c in ("silhouette", "avgPercent", "maxPercent")})
