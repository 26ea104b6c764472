import pytest
from pyspark.sql import functions as F

from songsift.operators.classify import (
    accuracy,
    accuracy_table,
    best_params,
    compare_models,
    cross_validate,
    decision_tree,
    fit_decision_tree,
    fit_mlp,
    fit_random_forest,
    best_of_grid,
    fold_metrics,
    forest_grid,
    grid_search,
    predict,
    random_forest,
)
from songsift.operators.features import hash_split, split_bucket
from songsift.plans.genres import compare_classifiers, training_split
from tests.conftest import rows, song
from songsift.schemas import CATALOGUE


@pytest.fixture(scope="module")
def separable(spark):
    """Five groups of points far apart from each other."""
    return (
        spark.range(1500)
        .select(
            "id",
            (F.col("id") % 5).cast("int").alias("label"),
            F.xxhash64("id", F.lit(1)).alias("a"),
            F.xxhash64("id", F.lit(2)).alias("b"),
        )
        .select(
            "id",
            "label",
            ((F.col("label") % 3) * 0.4 + F.pmod("a", F.lit(100)) / 1000).alias("x"),
            (F.floor(F.col("label") / 3) * 0.4 + F.pmod("b", F.lit(100)) / 1000).alias("y"),
        )
        .repartition(4, "id")
        .cache()
    )


FEATURES = {"features": ["x", "y"], "label": "label"}


def test_models_learn_separable_groups(separable):
    train, test = hash_split(separable, ["id"])
    models = {
        "tree": fit_decision_tree(train, min_instances=5, **FEATURES),
        "forest": fit_random_forest(train, trees=10, min_instances=5, **FEATURES),
        "mlp": fit_mlp(train, max_iter=100, **FEATURES),
    }
    table = {r["model"]: r for r in compare_models(models, test, "label").collect()}
    assert {r["rows"] for r in table.values()} == {test.count()}
    for name, model in models.items():
        scored = model.transform(test)
        assert accuracy(scored, "label") == pytest.approx(table[name]["accuracy"])
        assert accuracy_table(scored, "label").first()[0] == pytest.approx(table[name]["accuracy"])
        assert table[name]["accuracy"] > 0.95, name  # thresholds are binned
    assert models["mlp"].stages[-1].getLayers()[-1] == 5
    scored = predict(models["tree"], test, "label")
    assert scored.columns == ["prediction", "label", "features"] and scored.count() == test.count()


def test_accuracy_on_fixed_predictions(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (1.0, 0), (2.0, 2)], "prediction double, y int")
    assert accuracy(df, "y") == 0.75 and accuracy_table(df, "y").first()[0] == 0.75
    wrong = df.filter("prediction <> y")
    assert accuracy(wrong, "y") == 0.0


def test_cross_validation_reports_every_candidate(separable):
    pipeline = random_forest(trees=3, **FEATURES)
    grid = forest_grid(pipeline.getStages()[-1], depths=(1, 4), bins=(8, 16), trees=())
    model = cross_validate(separable, pipeline, grid, "label", folds=3, parallelism=4)
    table = fold_metrics(separable, model).collect()
    assert len(table) == 4 and all(0 <= r["accuracy"] <= 1 for r in table)
    assert "maxDepth=4" in max(table, key=lambda r: r["accuracy"])["params"]
    params = dict(rows(best_params(separable, model)))
    assert params["maxDepth"] == "4" and params["numTrees"] == "3" and params["impurity"] == "gini"


def test_grid_scores_every_number_of_trees_from_the_same_forest(separable):
    options = dict(depths=(1, 4), bins=(8, 16), folds=3, min_instances=1, parallelism=4)
    table = grid_search(separable, FEATURES["features"], "label", trees=(2, 5), **options)
    assert table.count() == 8 and {r["rows"] for r in table.collect()} == {separable.count()}
    best = best_of_grid(table).first()
    assert best["max_depth"] == 4 and best["accuracy"] > 0.9
    alone = grid_search(separable, FEATURES["features"], "label", trees=(2,), **options)
    of_two = rows(table.filter("trees = 2"))
    assert rows(alone) == of_two
    shares = []
    for fold in range(3):
        in_fold = split_bucket(separable.columns, 3) == fold
        forest = random_forest(trees=2, max_depth=4, max_bins=16, min_instances=1, **FEATURES)
        shares.append(accuracy(forest.fit(separable.filter(~in_fold)).transform(separable.filter(in_fold)), "label"))
    assert [r[-1] for r in of_two if r[:2] == (4, 16)] == [pytest.approx(sum(shares) / 3)]


def test_published_settings_are_the_defaults():
    forest = random_forest().getStages()[-1]
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMaxBins()) == (200, 5, 50)
    assert forest.getSubsamplingRate() == 0.8 and forest.getFeatureSubsetStrategy() == "all"
    tree = decision_tree().getStages()[-1]
    assert (tree.getMaxDepth(), tree.getMaxBins(), tree.getMinInstancesPerNode()) == (20, 32, 50)
    assert len(forest_grid(forest)) == 27


def test_unseen_category_is_kept(spark):
    train = spark.createDataFrame([(float(i % 3), 0.1 * i, i % 2) for i in range(60)], "c double, v double, label int")
    model = fit_decision_tree(train, features=["c", "v"], label="label", min_instances=1)
    unseen = spark.createDataFrame([(9.0, 0.1, 0)], "c double, v double, label int")
    assert model.transform(unseen).count() == 1


def test_genre_plan_end_to_end(spark):
    genres = ["rock", "pop", "electronic", "jazz", "folk"]
    data = [
        song(
            song_id=f"S{i}",
            artist_terms=[genres[i % 5]],
            tempo=60.0 + 30 * (i % 5) + i % 7,
            duration=100.0 + i % 11,
            loudness=-5.0 * (i % 5) - 1,
        )
        for i in range(600)
    ]
    train, test = training_split(spark.createDataFrame(data, CATALOGUE))
    assert train.count() + test.count() == 600
    table, models = compare_classifiers(train, test, trees=5, max_iter=30)
    scores = dict(rows(table, "model", "accuracy"))
    assert set(scores) == {"mlp", "decision_tree", "random_forest"}
    assert scores["decision_tree"] > 0.95 and scores["random_forest"] > 0.95


def test_forest_of_counted_rows_equals_a_forest_of_all_rows(spark):
    """Rows that occur many times are counted: a tree draws as many rows, and the forest learns the same."""
    from songsift.operators.forest import CountedForestModel

    cells = spark.range(60).selectExpr("cast(id % 12 as double) / 12 as a", "cast(id % 5 as double) as c")
    rows_ = cells.crossJoin(spark.range(50)).selectExpr(
        "a", "c", "cast(case when c = 2 then 2 when a < 0.5 then 0 else 1 end as int) as y"
    )
    model = fit_random_forest(rows_, features=["a", "c"], label="y", trees=30)
    forest = model.stages[-1]
    assert isinstance(forest, CountedForestModel) and len(forest.nodes) == 30
    assert accuracy(model.transform(rows_), "y") == 1.0
    again = fit_random_forest(rows_.repartition(7), features=["a", "c"], label="y", trees=30)
    assert all((p == q).all() for s, t in zip(forest.nodes, again.stages[-1].nodes) for p, q in zip(s, t))
    few = fit_random_forest(rows_, features=["a", "c"], label="y", trees=30, min_instances=10_000)
    assert all(len(feature) == 1 for feature, *_ in few.stages[-1].nodes)


def test_cross_validation_counts_equal_rows_once(spark, monkeypatch):
    """The fits get each different row of a fold once, and learn and score as from all rows."""
    from songsift.operators.forest import CountedForestClassifier, CountedForestModel

    seen = []
    fit = CountedForestClassifier._fit
    monkeypatch.setattr(
        CountedForestClassifier, "_fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows)
    )
    cells = spark.range(60).selectExpr("cast(id % 12 as double) / 12 as a", "cast(id % 5 as double) as c")
    train = cells.crossJoin(spark.range(200)).selectExpr(
        "a", "c", "cast(case when c = 2 then 2 when a < 0.5 then 0 else 1 end as int) as y"
    )
    model = cross_validate(train, random_forest(features=["a", "c"], label="y", trees=20), label="y", folds=3)
    assert max(seen) <= 180 and len(seen) == 4
    assert [r["accuracy"] for r in fold_metrics(train, model).collect()] == [1.0]
    assert isinstance(model.bestModel.stages[-1], CountedForestModel)
    assert model.bestModel.stages[-1].nodes[0][3].shape[1] == 3
    # Too few equal rows to grow from counts: the library gets every row as often as it occurs.
    few = cross_validate(train.limit(150), random_forest(features=["a", "c"], label="y", trees=3), label="y", folds=2)
    assert len(few.avgMetrics) == 1 and not isinstance(few.bestModel.stages[-1], CountedForestModel)


def test_grid_counts_equal_rows_once(spark, monkeypatch):
    """Every fit of the grid gets each different row of its folds once; the scores count all rows."""
    from songsift.operators.forest import CountedForestClassifier

    seen = []
    fit = CountedForestClassifier._fit
    monkeypatch.setattr(
        CountedForestClassifier, "_fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows)
    )
    cells = spark.range(60).selectExpr("cast(id % 12 as double) / 12 as a", "cast(id % 5 as double) as c")
    train = cells.crossJoin(spark.range(100).withColumnRenamed("id", "song")).selectExpr(
        "a", "c", "song", "cast(case when c = 2 then 2 when a < 0.5 then 0 else 1 end as int) as y"
    )
    options = dict(depths=(1, 4), bins=(16,), trees=(2, 4), folds=2, min_instances=1, parallelism=2)
    table = grid_search(train, ["a", "c"], "y", **options)
    assert len(seen) == 8 and max(seen) <= 60
    assert {r["rows"] for r in table.collect()} == {6000}
    assert (best_of_grid(table).first()["max_depth"], best_of_grid(table).first()["accuracy"]) == (4, 1.0)
    # Some rows that differ: a label that is wrong for a few of the equal rows costs exactly their share.
    wrong = train.withColumn("y", F.when((F.col("song") < 10) & (F.col("c") == 2), 0).otherwise(F.col("y")))
    found = best_of_grid(grid_search(wrong, ["a", "c"], "y", **options)).first()
    assert found["accuracy"] == pytest.approx(0.98, abs=0.005)


def test_perceptron_of_counted_rows_is_the_networks_own(spark, monkeypatch):
    """Rows that occur many times are counted; the weights found from them make the library's model."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    given = []
    fit = MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(
        MultilayerPerceptronClassifier, "_fit", lambda self, rows: given.append(rows.count()) or fit(self, rows)
    )
    cells = spark.range(60).selectExpr("cast(id % 12 as double) / 12 as a", "cast(id % 5 as double) / 5 as c")
    rows_ = cells.crossJoin(spark.range(20)).selectExpr(
        "a", "c", "cast(case when c > 0.5 then 2 when a < 0.5 then 0 else 1 end as int) as y"
    )
    model = fit_mlp(rows_, features=["a", "c"], label="y", max_iter=100)
    assert given == [1] and model.stages[-1].getLayers() == [2, 10, 10, 3]
    assert accuracy(model.transform(rows_), "y") == 1.0
    fit_mlp(cells.withColumn("y", F.lit(1)), features=["a", "c"], label="y", max_iter=1)
    assert given == [1, 60]


def test_models_are_compared_on_counted_rows_one_at_a_time(spark, monkeypatch):
    """Each model scores each different row once and by itself, and all rows count."""
    from pyspark.ml import PipelineModel

    seen = []
    transform = PipelineModel.transform
    monkeypatch.setattr(
        PipelineModel, "transform", lambda self, rows: seen.append((rows.columns, rows.count())) or transform(self, rows)
    )
    test = spark.range(60).crossJoin(spark.range(5).withColumnRenamed("id", "song")).selectExpr(
        "cast(id % 12 as double) / 12 as a", "song", "cast(id % 12 >= 6 as int) as y"
    )
    models = {name: fit_decision_tree(test, features=["a"], label="y", max_depth=depth) for name, depth in (("leaf", 0), ("tree", 3))}
    wrong = test.withColumn("y", F.when((F.col("song") == 4) & (F.col("y") == 1), 0).otherwise(F.col("y")))
    table = {r["model"]: (r["rows"], r["accuracy"]) for r in compare_models(models, wrong, "y").collect()}
    assert seen == [(["a", "y", "_rows"], 18)] * 2
    assert table["tree"] == (300, pytest.approx(0.9)) and table["leaf"][0] == 300
    assert rows(compare_models(models, wrong.limit(0), "y")) == [("leaf", 0, None), ("tree", 0, None)]
