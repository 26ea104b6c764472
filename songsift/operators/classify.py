"""Genre classifiers: fitting, scoring, cross-validation and comparison."""

from __future__ import annotations

from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from songsift.operators.features import index_vector, split_bucket
from songsift.operators.forest import WORTH_COUNTING, CountedForestClassifier
from songsift.operators.perceptron import CountedPerceptronClassifier
from songsift.schemas import CLASSIFIER_FEATURES
from songsift.session import settle

LABEL = "filtered_genre_index"

# The default settings of the three models, the folds and the grid below.


def mlp(
    classes: int,
    features: list[str] = CLASSIFIER_FEATURES,
    label: str = LABEL,
    hidden: tuple[int, ...] = (10, 10),
    max_iter: int = 50,
    block_size: int = 128,
    step_size: float = 0.3,
    seed: int = 1234,
) -> Pipeline:
    """Multilayer perceptron with one input per feature and one output per class."""
    network = CountedPerceptronClassifier(
        labelCol=label,
        featuresCol="features",
        layers=[len(features), *hidden, classes],
        maxIter=max_iter,
        blockSize=block_size,
        stepSize=step_size,
        seed=seed,
        solver="l-bfgs",
    )
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), network])


def fit_mlp(
    train: DataFrame,
    features: list[str] = CLASSIFIER_FEATURES,
    label: str = LABEL,
    **settings,
) -> PipelineModel:
    """Fit the perceptron; the labels found decide the number of outputs."""
    classes = train.agg(F.max(label)).first()[0] + 1
    return mlp(int(classes), features, label, **settings).fit(train)


def _tree_pipeline(classifier, features: list[str]) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    return Pipeline(stages=[assembler, index_vector(), classifier])


def decision_tree(
    features: list[str] = CLASSIFIER_FEATURES,
    label: str = LABEL,
    max_depth: int = 20,
    max_bins: int = 32,
    min_instances: int = 50,
    seed: int = 1,
) -> Pipeline:
    return _tree_pipeline(
        DecisionTreeClassifier(
            labelCol=label,
            featuresCol="indexedFeatures",
            maxDepth=max_depth,
            maxBins=max_bins,
            impurity="gini",
            minInstancesPerNode=min_instances,
            seed=seed,
        ),
        features,
    )


def fit_decision_tree(train: DataFrame, **settings) -> PipelineModel:
    return decision_tree(**settings).fit(train)


def random_forest(
    features: list[str] = CLASSIFIER_FEATURES,
    label: str = LABEL,
    trees: int = 200,
    max_depth: int = 5,
    max_bins: int = 50,
    min_instances: int = 50,
    subsampling: float = 0.8,
    seed: int = 1,
) -> Pipeline:
    return _tree_pipeline(
        CountedForestClassifier(
            labelCol=label,
            featuresCol="indexedFeatures",
            numTrees=trees,
            maxDepth=max_depth,
            maxBins=max_bins,
            featureSubsetStrategy="all",
            minInstancesPerNode=min_instances,
            subsamplingRate=subsampling,
            seed=seed,
        ),
        features,
    )


def fit_random_forest(train: DataFrame, **settings) -> PipelineModel:
    return random_forest(**settings).fit(train)


def predict(model: Model, test: DataFrame, *keep: str) -> DataFrame:
    """Scored rows: prediction, label and features, with any further columns in ``keep``."""
    return model.transform(test).select("prediction", *keep, "features")


def accuracy(predictions: DataFrame, label: str = LABEL) -> float:
    """Share of rows whose prediction equals the label."""
    return MulticlassClassificationEvaluator(
        labelCol=label, predictionCol="prediction", metricName="accuracy"
    ).evaluate(predictions)


def accuracy_table(predictions: DataFrame, label: str = LABEL) -> DataFrame:
    """The same share as a one-row DataFrame."""
    return predictions.agg(
        F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")
    )


def forest_grid(
    forest: RandomForestClassifier,
    depths: tuple[int, ...] = (5, 10, 15),
    bins: tuple[int, ...] = (16, 32, 48),
    trees: tuple[int, ...] = (50, 100, 200),
) -> list[dict]:
    """The parameter grid of the forest; empty tuples leave a parameter as it is."""
    builder = ParamGridBuilder()
    for param, values in (
        (forest.maxDepth, depths),
        (forest.maxBins, bins),
        (forest.numTrees, trees),
    ):
        if values:
            builder = builder.addGrid(param, list(values))
    return builder.build()


def cross_validate(
    train: DataFrame,
    pipeline: Pipeline,
    grid: list[dict] | None = None,
    label: str = LABEL,
    folds: int = 5,
    seed: int = 1,
    parallelism: int = 1,
) -> CrossValidatorModel:
    """Cross-validate every parameter set by accuracy and refit the best one.

    The folds are drawn per row position, so ``train`` should be a settled
    table: a repeated task then draws the same folds.

    For a forest, equal rows of a fold are counted once, before all fits: every
    fit learns from the counts, and every score is weighted by them.
    """
    evaluator = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")
    validator = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=grid or ParamGridBuilder().build(),
        evaluator=evaluator,
        numFolds=folds,
        seed=seed,
        parallelism=parallelism,
    )
    assembler, classifier = pipeline.getStages()[0], pipeline.getStages()[-1]
    if not (isinstance(classifier, CountedForestClassifier) and isinstance(assembler, VectorAssembler)):
        return validator.fit(train)
    columns = [*dict.fromkeys([*assembler.getInputCols(), label])]
    dealt = train.select(*columns, F.floor(F.rand(seed) * folds).cast("int").alias("_fold"))
    counted = settle(dealt.groupBy(*columns, "_fold").agg(F.count(F.lit(1)).alias("_rows")), "dealt", spread=True)
    evaluator.setWeightCol("_rows")
    validator.setFoldCol("_fold")
    stages = [*pipeline.getStages()[:-1], classifier.copy().setCounts("_rows")]
    return validator.setEstimator(Pipeline(stages=stages)).fit(counted)


def grid_search(
    train: DataFrame,
    features: list[str] = CLASSIFIER_FEATURES,
    label: str = LABEL,
    depths: tuple[int, ...] = (5, 10, 15),
    bins: tuple[int, ...] = (16, 32, 48),
    trees: tuple[int, ...] = (50, 100, 200),
    folds: int = 5,
    seed: int = 1,
    parallelism: int = 1,
    **settings,
) -> DataFrame:
    """The forest's grid, cross-validated: ``max_depth, max_bins, trees, rows, accuracy``.

    A forest's raw prediction is the sum over its trees, so a forest of 100 is
    one of 50 and 50 more.  For each depth, number of bins and fold the
    increments are grown once, and the running sums of their votes score every
    number of trees in one pass: 200 trees in place of 50 + 100 + 200.

    Rows are dealt to folds by a hash of their values, so equal rows share a fold
    and a repeated task deals them alike.  ``train`` should be settled.  Fits of
    different folds run side by side, as many as ``parallelism``.

    Where many rows of a fold have equal features and label, they are counted once,
    before all fits: every fit learns from the counts, every score is weighted by them.
    """
    dealt = train.withColumn("_fold", split_bucket(train.columns, folds))
    columns = [*dict.fromkeys([*features, label])]
    counted = dealt.groupBy(*columns, "_fold").agg(F.count(F.lit(1)).alias("_rows"))
    counted = settle(counted, "dealt", spread=True)
    found = counted.agg(F.count(F.lit(1)).alias("cells"), F.sum("_rows").alias("rows")).first()
    counts, often = None, F.lit(1)
    if found["cells"] and found["rows"] >= WORTH_COUNTING * found["cells"]:
        dealt, counts, often = counted, "_rows", F.col("_rows")
    sizes = sorted(set(trees))
    steps = [b - a for a, b in zip([0, *sizes], sizes)]

    def score(job: tuple[int, int, int]) -> Row:
        depth, width, fold = job
        learn = dealt.filter(F.col("_fold") != fold)
        scored = dealt.filter(F.col("_fold") == fold)
        votes: Column | None = None
        hits = []
        for i, more in enumerate(steps):
            forest = random_forest(
                features, label, more, max_depth=depth, max_bins=width, seed=seed + i, **settings
            )
            forest.getStages()[-1].setRawPredictionCol(f"_votes{i}").setProbabilityCol("").setPredictionCol("")
            forest.getStages()[-1].setCounts(counts)
            kept = scored.columns
            scored = forest.fit(learn).transform(scored).select(*kept, f"_votes{i}")
            own = vector_to_array(f"_votes{i}")
            votes = own if votes is None else F.zip_with(votes, own, lambda a, b: a + b)
            # The first of the classes with most votes, as in the model's own prediction.
            best = F.array_position(votes, F.array_max(votes)) - 1
            hits.append(F.sum(F.when(best == F.col(label), often).otherwise(0)).alias(f"hits{i}"))
        return scored.agg(F.sum(often).alias("rows"), *hits).first()

    jobs = list(product(depths, bins, range(folds)))
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        rows = dict(zip(jobs, pool.map(inheritable_thread_target(train.sparkSession)(score), jobs)))
    table = []
    for depth, width in product(depths, bins):
        own = [rows[depth, width, fold] for fold in range(folds) if rows[depth, width, fold]["rows"]]
        for i, size in enumerate(sizes):
            shares = [r[f"hits{i}"] / r["rows"] for r in own]
            table.append((depth, width, size, sum(r["rows"] for r in own), sum(shares) / len(shares) if own else None))
    return train.sparkSession.createDataFrame(
        table, "max_depth int, max_bins int, trees int, rows bigint, accuracy double"
    )


def best_of_grid(table: DataFrame) -> DataFrame:
    """The row of the grid with the largest accuracy, the simplest forest if several share it."""
    return table.orderBy(F.desc("accuracy"), "max_depth", "max_bins", "trees").limit(1)


def fold_metrics(train: DataFrame, model: CrossValidatorModel) -> DataFrame:
    """One row per parameter set: the set as text and its accuracy over the folds."""
    rows = [
        (
            i,
            ", ".join(sorted(f"{param.name}={value}" for param, value in params.items())),
            float(metric),
        )
        for i, (params, metric) in enumerate(zip(model.getEstimatorParamMaps(), model.avgMetrics))
    ]
    return train.sparkSession.createDataFrame(
        rows, "candidate int, params string, accuracy double"
    )


def best_params(train: DataFrame, model: CrossValidatorModel) -> DataFrame:
    """Parameters of the classifier that won, one row each."""
    winner = model.bestModel.stages[-1].extractParamMap()
    rows = sorted((param.name, str(value)) for param, value in winner.items())
    return train.sparkSession.createDataFrame(rows, "param string, value string")


def compare_models(models: dict[str, Model], test: DataFrame, label: str = LABEL) -> DataFrame:
    """Accuracy of several fitted models on the same test rows.

    Rows with equal features and label are counted once, and each model scores the
    counts by itself, so no plan holds more than one model.
    """
    first = [model.stages[0] if isinstance(model, PipelineModel) else None for model in models.values()]
    columns = test.columns
    if all(isinstance(stage, VectorAssembler) for stage in first):
        columns = [*dict.fromkeys([c for stage in first for c in stage.getInputCols()] + [label])]
    counted = settle(test.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows")), "scored", spread=True)
    table = []
    for name, model in models.items():
        scored = model.transform(counted)
        hit = F.col("prediction") == F.col(label)
        found = scored.agg(
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
            F.sum(F.when(hit, F.col("_rows"))).alias("hits"),
            F.sum(F.when(hit.isNotNull(), F.col("_rows"))).alias("known"),
        ).first()
        share = (found["hits"] or 0) / found["known"] if found["known"] else None
        table.append((name, found["rows"], share))
    return test.sparkSession.createDataFrame(table, "model string, rows bigint, accuracy double")
