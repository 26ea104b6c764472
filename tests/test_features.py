import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from songsift.functions.numeric import round_int, shift_round
from songsift.operators.features import (
    assemble,
    derive_label,
    hash_split,
    index_label,
    keep_labelled,
    minmax_scale,
    one_hot,
    prepare_classification,
    standard_scale,
)
from tests.conftest import rows


def test_rounding_is_half_up(spark):
    df = spark.createDataFrame([(2.5,), (120.5,), (-0.5,), (-2.4,)], "x double")
    assert [r[0] for r in df.select(round_int(F.col("x"))).collect()] == [3, 121, -1, -2]
    assert [r[0] for r in df.select(shift_round(F.col("x"), 100)).collect()] == [103, 221, 100, 98]


def test_standard_scale_matches_pandas(spark):
    frame = pd.DataFrame({"a": [1.0, 2.0, 4.0], "b": [5, 5, 5]})
    scaled = standard_scale(spark.createDataFrame(frame), ["a", "b"])
    got = [r[0] for r in scaled.orderBy("a").select(vector_to_array("scaledFeatures")).collect()]
    want = (frame["a"] - frame["a"].mean()) / frame["a"].std()
    assert [g[0] for g in got] == pytest.approx(list(want))
    assert [g[1] for g in got] == [0.0, 0.0, 0.0]  # a constant column


def test_minmax_scale_of_the_row_with_every_minimum(spark):
    df = spark.createDataFrame([(1, 10, 7), (3, 30, 7), (2, 15, 7)], "a int, b int, c int")
    got = rows(minmax_scale(df, ["a", "b", "c"]))
    assert got == [
        (1, 10, 7, 0.0, 0.0, 0.5),
        (2, 15, 7, 0.5, 0.25, 0.5),
        (3, 30, 7, 1.0, 1.0, 0.5),
    ]


def test_assemble_refuses_missing_values(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception, match="null"):
        assemble(df, ["a", "b"]).collect()


def test_label_follows_the_songs_own_order(songs):
    labels = dict(rows(derive_label(songs, terms="artist_terms"), "song_id", "filtered_genre"))
    assert labels["S01"] == "rock" and labels["S02"] == "pop" and labels["S03"] == "jazz"
    assert labels["S07"] == "rock"  # 'Rock' is another term
    assert not {"S04", "S05", "S06", "S12"} & set(labels)
    assert "artist_terms" not in derive_label(songs).columns


def test_index_is_by_frequency_then_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), ("",)], "g string")
    got = dict(rows(index_label(keep_labelled(df, "g"), "g")))
    assert got == {"c": 0, "a": 1, "b": 2}


def test_one_hot(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "i int")
    dense = lambda drop: [
        r[0] for r in one_hot(df, "i", "v", drop).orderBy("i").select(vector_to_array("v")).collect()
    ]
    assert dense(True) == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]
    assert dense(False)[2] == [0.0, 0.0, 1.0]


def test_prepare_classification(songs):
    got = prepare_classification(songs)
    assert got.columns == [
        "loudness", "tempo", "duration", "time_signature", "filtered_genre",
        "loudness_sc", "tempo_sc", "duration_sc", "filtered_genre_index",
    ]
    assert dict(got.dtypes)["filtered_genre_index"] == "int"
    by_genre = {(r["filtered_genre"], r["duration"]): r for r in got.collect()}
    # S01, S08, S09 and S10 are complete, labelled and have no zero.
    assert set(by_genre) == {("rock", 3), ("folk", 1), ("jazz", 200)} and got.count() == 4
    first = by_genre["rock", 3]
    assert (first["tempo"], first["loudness"]) == (121, 100)
    # The range runs from S08 to S12, which has no label of its own.
    assert first["tempo_sc"] == 0.5 and first["loudness_sc"] == 1.0
    assert by_genre["folk", 1]["loudness_sc"] == 0.0
    assert {r["filtered_genre"]: r["filtered_genre_index"] for r in got.collect()} == {
        "jazz": 0, "folk": 1, "rock": 2,
    }


def test_hash_split_is_stable(spark):
    df = spark.range(5000).withColumn("t", F.concat(F.lit("x"), "id"))
    train, test = hash_split(df, ["id", "t"])
    again, _ = hash_split(df.repartition(13), ["id", "t"])
    assert rows(train) == rows(again)
    assert train.count() + test.count() == 5000 and train.join(test, "id").count() == 0
    assert 0.77 < train.count() / 5000 < 0.83
