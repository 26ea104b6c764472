"""Predicting the genre of a song."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from songsift.operators.classify import (
    compare_models,
    decision_tree,
    fit_mlp,
    random_forest,
)
from songsift.operators.features import prepare_classification, split_at, split_bucket
from songsift.schemas import GENRES
from songsift.session import settle

SPLIT_KEY = ["loudness", "tempo", "duration", "time_signature", "filtered_genre"]


def training_split(
    songs: DataFrame,
    vocabulary: list[str] = GENRES,
    share: float = 0.8,
    durations: tuple[float, float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The prepared songs as training and test rows of one settled table.

    The side is stored with the row, since a fit reads its input many times.
    """
    frame = prepare_classification(songs, vocabulary, durations).withColumn(
        "_bucket", split_bucket(SPLIT_KEY)
    )
    return split_at(settle(frame, "classification", spread=True), "_bucket", share)


def compare_classifiers(
    train: DataFrame, test: DataFrame, trees: int = 200, max_iter: int = 50
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Accuracy of the three classifiers on one and the same split."""
    models = {
        "mlp": fit_mlp(train, max_iter=max_iter),
        "decision_tree": decision_tree().fit(train),
        "random_forest": random_forest(trees=trees).fit(train),
    }
    return compare_models(models, test), models
