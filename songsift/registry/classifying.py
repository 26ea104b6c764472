"""Genre classifiers on the catalogue, with the settings they have by default.

The queries return what must hold for any fit, since the fits themselves depend
on the partitioning of the rows.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from songsift.operators.classify import (
    accuracy,
    accuracy_table,
    best_of_grid,
    best_params,
    compare_models,
    cross_validate,
    fit_decision_tree,
    fit_mlp,
    fit_random_forest,
    fold_metrics,
    grid_search,
    predict,
    random_forest,
)
from songsift.operators.features import assemble, hash_split, index_label, index_vector
from songsift.plans.genres import compare_classifiers, training_split
from songsift.registry import query
from songsift.registry.data import VOCABULARY, catalogue, near, near_sql, over_catalogue, table
from songsift.registry.preparing import _NEEDED, FRAME, IN_TRAIN
from songsift.schemas import CLASSIFIER_FEATURES
from songsift.session import settle

def _split(spark, sf_dir):
    return training_split(catalogue(spark, sf_dir, *_NEEDED), VOCABULARY)


def _facts(spark, name, predictions, label="filtered_genre_index"):
    """The number of scored rows, and whether the accuracy is one."""
    share = accuracy(predictions, label)
    return spark.createDataFrame(
        [(name, predictions.count(), 0 <= share <= 1)], "model string, rows bigint, in_range boolean"
    )


def _facts_sql(name):
    return over_catalogue(
        f"SELECT '{name}' AS model, count(*) AS \"rows\", true AS in_range FROM indexed"
        f" WHERE NOT ({IN_TRAIN})",
        *FRAME,
    )


@query(
    over_catalogue(
        "SELECT round(avg(CAST(time_signature % 5 = filtered_genre_index AS DOUBLE)), 6)"
        " AS accuracy FROM indexed",
        *FRAME,
    )
)
def accuracy_fixed(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    rows = train.unionByName(test).withColumn(
        "prediction", (F.col("time_signature") % 5).cast("double")
    )
    share = accuracy(rows)
    table = accuracy_table(rows).withColumn("accuracy", F.round("accuracy", 6))
    return table.filter(F.abs(F.col("accuracy") - F.lit(share)) < 1e-5)


@query(_facts_sql("mlp"))
def mlp_accuracy(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _facts(spark, "mlp", fit_mlp(train).transform(test))


@query(_facts_sql("decision_tree"))
def tree_accuracy(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _facts(spark, "decision_tree", fit_decision_tree(train).transform(test))


@query(_facts_sql("random_forest"))
def forest_accuracy(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _facts(spark, "random_forest", fit_random_forest(train).transform(test))


@query(
    over_catalogue(
        "SELECT model, CAST(1 AS DOUBLE) AS accuracy, (SELECT count(*) FROM indexed WHERE NOT"
        f" ({IN_TRAIN})) AS \"rows\""
        " FROM (SELECT unnest(['decision_tree', 'random_forest']) AS model)",
        *FRAME,
    )
)
def trees_on_known_label(spark, sf_dir):
    """A label that follows from a feature: both kinds of trees must find it."""
    train, test = (
        side.withColumn("filtered_genre_index", (F.col("time_signature") % 3).cast("int"))
        for side in _split(spark, sf_dir)
    )
    models = {
        "decision_tree": fit_decision_tree(train),
        "random_forest": fit_random_forest(train, trees=20),
    }
    return compare_models(models, test)


_APART = "(tempo_sc < 0.45 OR tempo_sc > 0.55)"


@query(
    over_catalogue(
        'SELECT model, count(*) AS "rows", CAST(1 AS DOUBLE) AS accuracy FROM indexed,'
        " (SELECT unnest(['mlp', 'decision_tree', 'random_forest']) AS model)"
        f" WHERE NOT ({IN_TRAIN}) AND {_APART} GROUP BY model",
        *FRAME,
    )
)
def models_on_separable_label(spark, sf_dir):
    """Slow and fast songs with a gap between them: all three classifiers must tell them apart."""
    train, test = (
        side.filter(_APART).withColumn("filtered_genre_index", (F.col("tempo_sc") > 0.5).cast("int"))
        for side in _split(spark, sf_dir)
    )
    return compare_classifiers(train, test, trees=20)[0]


# A label that takes seven levels of splits, at values that only 48 bins tell apart.
_DEEP = (
    "CASE WHEN p < 12 THEN 0 WHEN s < 13 THEN 1 WHEN o < 14 THEN 2 WHEN p < 25 THEN 3 WHEN s < 26 THEN 4"
    " WHEN o < 24 THEN 0 WHEN p < 35 THEN 1 ELSE 2 END"
)


@query(
    'SELECT 10 AS max_depth, 48 AS max_bins, count(*) AS "rows", CAST(1 AS DOUBLE) AS accuracy FROM lineitem'
)
def grid_on_deep_label(spark, sf_dir):
    """The grid must find the least depth and the bins that a known label needs."""
    digits = "cast(conv(substring(md5(concat_ws('|', l_orderkey, l_linenumber)), {}, 4), 16, 10) as int) % 48 as {}"
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        digits.format(1, "p"), digits.format(5, "s"), digits.format(9, "o"), "l_orderkey as song"
    )
    rows = settle(rows.withColumn("label", F.expr(_DEEP)), "deep", spread=True)
    grid = grid_search(
        rows, ["p", "s", "o"], "label", trees=(2, 4), folds=2, parallelism=4, min_instances=1
    )
    # A few songs next to a split value may be missed where songs are few.
    return best_of_grid(grid).select("max_depth", "max_bins", "rows", F.round("accuracy", 2).alias("accuracy"))


@query(
    over_catalogue(
        'SELECT feature, n AS "values" FROM (UNPIVOT (SELECT'
        " count(DISTINCT loudness_sc) AS loudness_sc, count(DISTINCT tempo_sc) AS tempo_sc,"
        " count(DISTINCT duration_sc) AS duration_sc, count(DISTINCT time_signature) AS"
        f" time_signature FROM indexed WHERE {IN_TRAIN}) ON loudness_sc, tempo_sc, duration_sc,"
        " time_signature INTO NAME feature VALUE n) WHERE n <= 20",
        *FRAME,
    )
)
def vector_categories(spark, sf_dir):
    """The features of few different values, which the trees take as categories."""
    train, _ = _split(spark, sf_dir)
    model = index_vector().fit(assemble(train, CLASSIFIER_FEATURES))
    rows = [(CLASSIFIER_FEATURES[i], len(found)) for i, found in model.categoryMaps.items()]
    return spark.createDataFrame(rows, "feature string, values bigint")


def _validated(spark, sf_dir):
    """Five folds of the forest with the settings it has, as no grid is active, on a label that follows from a feature."""
    train, _ = _split(spark, sf_dir)
    train = train.withColumn("filtered_genre_index", (F.col("time_signature") % 3).cast("int"))
    return train, cross_validate(train, random_forest(), parallelism=2)


@query(
    "SELECT CAST(0 AS INTEGER) AS candidate, '' AS params, CAST(1 AS DOUBLE) AS accuracy FROM lineitem LIMIT 1"
)
def forest_cv(spark, sf_dir):
    """Every fold must find the label."""
    return fold_metrics(*_validated(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "SELECT unnest(['featureSubsetStrategy', 'impurity', 'maxBins', 'maxDepth',"
    " 'minInstancesPerNode', 'numTrees', 'subsamplingRate']) AS param,"
    " unnest(['all', 'gini', '50', '5', '50', '200', '0.8']) AS value"
    " FROM (SELECT 1 FROM lineitem LIMIT 1)"
)
def forest_best_params(spark, sf_dir):
    """Without a grid the best settings are the given ones."""
    given = ["featureSubsetStrategy", "impurity", "maxBins", "maxDepth", "minInstancesPerNode"]
    return best_params(*_validated(spark, sf_dir)).filter(
        F.col("param").isin(*given, "numTrees", "subsamplingRate")
    )


@query(
    over_catalogue(
        "SELECT model, (SELECT count(*) FROM indexed WHERE NOT"
        f" ({IN_TRAIN})) AS \"rows\", true AS in_range"
        " FROM (SELECT unnest(['mlp', 'decision_tree', 'random_forest']) AS model)",
        *FRAME,
    )
)
def model_comparison(spark, sf_dir):
    table = compare_classifiers(*_split(spark, sf_dir))[0]
    return table.select("model", "rows", F.col("accuracy").between(0, 1).alias("in_range"))


@query(
    over_catalogue(
        "SELECT filtered_genre_index, loudness_sc, tempo_sc, duration_sc, time_signature,"
        f" true AS known FROM indexed WHERE NOT ({IN_TRAIN})",
        *FRAME,
    )
)
def predicted_rows(spark, sf_dir):
    """Every test row with its features, and a label that exists."""
    train, test = _split(spark, sf_dir)
    scored = predict(fit_decision_tree(train), test, "filtered_genre_index")
    values = vector_to_array("features")
    columns = {name: F.get(values, F.lit(i)) for i, name in enumerate(CLASSIFIER_FEATURES)}
    columns["time_signature"] = columns["time_signature"].cast("int")
    known = F.col("prediction").isin(*map(float, range(len(VOCABULARY))))
    return scored.select(
        "filtered_genre_index", *[c.alias(n) for n, c in columns.items()], known.alias("known")
    )


@query(
    over_catalogue(
        f"SELECT filtered_genre_index, count(*) AS \"rows\" FROM indexed WHERE NOT ({IN_TRAIN})"
        " GROUP BY filtered_genre_index",
        *FRAME,
    )
)
def predicted_rows_per_label(spark, sf_dir):
    """Scoring keeps every test row and its label."""
    train, test = _split(spark, sf_dir)
    scored = predict(fit_decision_tree(train, max_depth=5), test, "filtered_genre_index")
    return (
        scored.filter(F.col("prediction").between(0, len(VOCABULARY) - 1))
        .groupBy("filtered_genre_index")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query(
    over_catalogue(
        f"SELECT {near_sql('avg(CAST(filtered_genre_index = majority AS DOUBLE))')} AS accuracy,"
        " count(*) AS \"rows\" FROM indexed, (SELECT filtered_genre_index AS majority FROM indexed"
        f" WHERE {IN_TRAIN} GROUP BY 1 ORDER BY count(*) DESC LIMIT 1) WHERE NOT ({IN_TRAIN})",
        *FRAME,
    )
)
def tree_without_splits(spark, sf_dir):
    """A tree of depth 0 predicts the most frequent training label."""
    train, test = _split(spark, sf_dir)
    scored = fit_decision_tree(train, max_depth=0).transform(test)
    return scored.agg(
        near(F.avg((F.col("prediction") == F.col("filtered_genre_index")).cast("double"))).alias(
            "accuracy"
        ),
        F.count(F.lit(1)).alias("rows"),
    )


_EVENT_TRAIN = "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80"


@query(
    "SELECT 'decision_tree' AS model, count(*) AS \"rows\", true AS in_range FROM events"
    f" WHERE NOT ({_EVENT_TRAIN})"
)
def event_type_tree(spark, sf_dir):
    """The same classifiers on a table that is no catalogue."""
    events = table(spark, sf_dir, "events").select(
        "event_type", "value", F.hour("ts").alias("hour"), "event_id"
    )
    train, test = hash_split(settle(index_label(events, "event_type"), "events"), ["event_id"])
    model = fit_decision_tree(
        train, features=["value", "hour"], label="event_type_index", max_depth=5
    )
    return _facts(spark, "decision_tree", model.transform(test), "event_type_index")
