import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from songsift.operators.counts import common_tokens, count_by, most_common_tokens, token_state
from songsift.operators.features import index_label
from songsift.operators.quality import describe_columns, missing_profile
from songsift.operators.ranks import number_rows
from songsift.operators.similarity import artist_features, ground_truth, peer_index, peer_pages, peers_on_page
from songsift.operators.states import (
    RANK_ERROR,
    describe_state,
    entity_state,
    merge_entities,
    merge_profiles,
    profile_state,
    store_state,
    stored_states,
)
from songsift.schemas import CATALOGUE
from songsift.session import settle
from songsift.sources.catalogue import open_by_artist, write_by_artist
from songsift.sources.staging import read_staging_lines, write_staging_csv
from tests.conftest import NAN, plan_of, rows, song


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# Numbers in order.


def test_numbers_equal_those_of_a_window(spark, many_partitions):
    # Group 0 holds two thirds, and one group has no name.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 0).when(F.col("id") % 300 == 2, F.lit(None)).otherwise(F.col("id") % 7).alias("g"),
        F.xxhash64("id").alias("v"),
    )
    got = number_rows(df, [F.desc("v")], ("g",))
    window = F.row_number().over(W.partitionBy("g").orderBy(F.desc("v"))) - 1
    assert rows(got) == rows(df.withColumn("rank", window.cast("bigint")))
    assert got.select("g").filter("g = 0").rdd.getNumPartitions() > 1
    whole = number_rows(df, [F.asc("v")], output="at")
    assert [r["at"] for r in whole.orderBy("v").collect()] == list(range(3000))
    assert number_rows(df.limit(0), [F.asc("v")]).count() == 0


def test_index_of_very_many_labels_stays_off_the_driver(spark, monkeypatch):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("label "), F.col("id") % 5000)).alias("label"), "id"
    )
    expected = StringIndexer(inputCol="label", outputCol="i", stringOrderType="frequencyDesc").fit(df).transform(df)
    expected = rows(expected.select("label", "id", F.col("i").cast("int")))
    for name in ("collect", "toPandas", "toArrow", "first", "head", "take"):
        monkeypatch.setattr(DataFrame, name, lambda *a, **k: pytest.fail("rows came to the driver"))
    indexed = index_label(df, "label")
    monkeypatch.undo()
    assert indexed.columns == ["label", "id", "label_index"] and rows(indexed) == expected
    assert "SinglePartition" not in plan_of(indexed)


def test_index_without_labels(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "label string, id int")
    assert rows(index_label(df, "label")) == [("a", 2, 0), (None, 1, None)]
    assert index_label(df.limit(0), "label").count() == 0
    assert rows(index_label(df.filter("id = 2"), "label", ["a", "b"])) == [("a", 2, 0)]


# Pages of peers.


def test_every_peer_is_on_one_page(spark, many_partitions):
    df = spark.range(1000).select(
        F.format_string("A%04d", "id").alias("artist_id"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5).cast("int").alias("prediction")
    )
    index = settle(peer_index(df.union(df.limit(10))), "peers")
    pages = peer_pages(index, 64).collect()
    assert sum(r["artists"] for r in pages) == 1000 and max(r["artists"] for r in pages) == 64
    members = {}
    for r in df.collect():
        members.setdefault(r["prediction"], []).append(r["artist_id"])
    for p, ids in members.items():
        ids.sort()
        own = sorted((r["page"], r["first"], r["last"], r["artists"]) for r in pages if r["prediction"] == p)
        cut = [ids[i : i + 64] for i in range(0, len(ids), 64)]
        assert own == [(i, c[0], c[-1], len(c)) for i, c in enumerate(cut)]
    mine = members[0]
    seen = [r["artist_id"] for page in range(len(mine) // 64 + 1) for r in peers_on_page(index, mine[70], page, 64).collect()]
    assert seen == [a for a in mine if a != mine[70]]


def test_a_page_reads_a_range_of_the_stored_index(spark):
    df = spark.createDataFrame([("A", 0), ("B", 0)], "artist_id string, prediction int")
    plan = plan_of(peers_on_page(settle(peer_index(df), "peers"), "A", 0))
    assert "PushedFilters" in plan and "GreaterThanOrEqual(place" not in plan.split("ReadSchema")[-1]


# States of parts.


@pytest.fixture(scope="module")
def values(spark):
    return spark.range(60_000).select(
        F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 70 == 1, F.lit(NAN)).otherwise(1e9 + F.pmod(F.xxhash64("id"), F.lit(9973))).alias("x"),
        (F.col("id") % 3).cast("int").alias("y"),
        F.lit(None).cast("double").alias("z"),
        "id",
    )


def test_merged_states_equal_the_whole(spark, values, tmp_path):
    path, columns = str(tmp_path / "states"), ["x", "y", "z"]
    cuts = [(0, 100), (100, 100), (100, 45_000), (45_000, 60_000)]
    for i, (a, b) in enumerate(cuts):
        part = values.filter((F.col("id") >= a) & (F.col("id") < b))
        store_state(profile_state(values if i == 0 else part, columns), path, f"p{i}")
        if i == 0:  # a part that comes again replaces its own state
            store_state(profile_state(part, columns), path, "p0")
    merged = {r["column"]: r for r in describe_state(merge_profiles(stored_states(spark, path))).collect()}
    missing = dict(rows(missing_profile(values, columns)))
    for r in describe_columns(values, columns).collect():
        got = merged[r["column"]]
        assert got["missing"] == missing[r["column"]] and got["count"] == r["count"]
        for name in ("mean", "std", "min", "max"):
            assert got[name] == (r[name] if r[name] is None else pytest.approx(r[name], rel=1e-12 if name != "std" else 1e-9))
        own = sorted(v[0] for v in values.select(r["column"]).collect() if v[0] is not None and v[0] == v[0])
        for p in (25, 50, 75) if own else ():
            low, high = np.searchsorted(own, got[f"p{p}"], "left"), np.searchsorted(own, got[f"p{p}"], "right")
            assert low / len(own) - RANK_ERROR <= p / 100 <= high / len(own) + RANK_ERROR
    assert merged["z"]["mean"] is merged["z"]["p50"] is None


def test_entities_of_a_million_artists(spark, tmp_path):
    df = spark.range(1_000_000).select((F.col("id") % 3).alias("place"), F.format_string("A%d", "id").alias("artist"), "id")
    path = str(tmp_path / "states")
    store_state(entity_state(df.filter("id < 700000"), "place", "artist"), path, "one")
    store_state(entity_state(df.filter("id >= 300000"), "place", "artist"), path, "two")
    for place, n in rows(merge_entities(stored_states(spark, path), "place")):
        assert abs(n / 333_333 - 1) < 3 * 1.04 / 2**8, place
    few = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), (None, "x"), ("b", "y")], "place string, artist string")
    assert rows(merge_entities(entity_state(few, "place", "artist"), "place")) == [("a", 1), ("b", 1)]


# Common tokens.


def plain_top(df, k):
    counts = count_by(df.select(F.explode("terms").alias("term")).filter("trim(term) != ''"), "term")
    return [tuple(r) for r in counts.orderBy(F.desc("count"), "term").limit(k).collect()]


def test_hot_tokens_are_found_and_counted_exactly(spark):
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
    df = spark.range(100_000).select(F.array(F.floor(1 / (place + 1e-4)).cast("string"), F.concat(F.lit("r"), F.col("id"))).alias("terms"))
    parts = [df.filter("terms[0] < '3'"), df.filter("terms[0] >= '3'")]
    states = token_state(parts[0], "terms").union(token_state(parts[1], "terms"))
    found, certain = common_tokens(states, 10)
    assert certain and found.count() < 100
    top = most_common_tokens(df, "terms", 10, states)
    assert [tuple(r) for r in top.collect()] == plain_top(df, 10)


@pytest.mark.parametrize("tracked", [16, 10_000])
def test_tokens_that_are_all_as_common(spark, tracked):
    df = spark.range(30_000).select(F.array(F.concat(F.lit("t"), F.col("id") % 3001)).alias("terms"))
    top = most_common_tokens(df, "terms", 10, tracked=tracked)
    assert [tuple(r) for r in top.collect()] == plain_top(df, 10)


def test_no_tokens(spark):
    df = spark.createDataFrame([(None,), ([],), ([" "],)], "terms array<string>")
    assert most_common_tokens(df, "terms", 10).count() == 0
    assert rows(most_common_tokens(df.union(spark.createDataFrame([(["a", "a "],)], df.schema)), "terms", 10)) == [("a", 2)]


# Stored layouts and staging.


def test_a_catalogue_by_artist_is_grouped_without_a_shuffle(spark, songs, tmp_path):
    path = str(tmp_path / "by-artist")
    stored = write_by_artist(songs, path, "songs_by_artist", 4)
    again = open_by_artist(spark, path, "songs_by_artist_again", 4)
    for table in (stored, again):
        for work in (artist_features, ground_truth):
            assert "Exchange" not in plan_of(work(table)) and "Exchange" in plan_of(work(songs))
            assert rows(work(table)) == rows(work(songs))
    replaced = write_by_artist(songs.limit(3), path, "songs_by_artist", 4)
    assert replaced.count() == 3


def test_staging_lines_are_sound_or_rejected(spark, tmp_path):
    schema = CATALOGUE
    data = [song(song_id=f"S{i}", title='quo"ted, text\nwith a break', artist_terms=["a, b", 'c"d']) for i in range(5)]
    data.append(song(song_id="S5", similar_artists=None, artist_terms=[], tempo=None, title="\\N"))
    df = spark.createDataFrame(data, schema)
    path = str(tmp_path / "staging")
    write_staging_csv(df.repartition(3), path)
    sound, rejects = read_staging_lines(spark, path, schema)
    assert rows(sound) == rows(df) and rejects.count() == 0
    good = spark.read.text(path).filter("value like 'A1%'").first()["value"]
    fields = len(schema)
    bad = [
        ("too short", f"not {fields} fields"),
        (good + ",more", f"not {fields} fields"),
        (good.replace(",2000,", ",MM,"), "wrong type: year"),
        (good.replace(",120.0,", ",fast,").replace(",2000,", ",MM,"), "wrong type: tempo, year"),
    ]
    spark.createDataFrame([(line,) for line, _ in bad], "value string").write.mode("append").text(path)
    sound, rejects = read_staging_lines(spark, path, schema)
    assert rows(sound) == rows(df)
    assert rows(rejects, "line", "reason") == sorted(bad, key=repr)
    assert all(f.startswith("file:") for (f,) in rows(rejects, "file"))


def test_staging_lines_are_parsed_once(spark, tmp_path):
    """What tells sound lines from others does not parse them again for each column."""
    path = str(tmp_path / "staging")
    write_staging_csv(spark.createDataFrame([song()], CATALOGUE), path)
    for side in read_staging_lines(spark, path, CATALOGUE):
        plan = plan_of(side)
        assert plan.count("from_csv(") == 1 and plan.count("try_cast") <= len(CATALOGUE)
