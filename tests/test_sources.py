import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from songsift.operators.counts import token_count
from songsift.operators.quality import drop_missing
from songsift.registry.ingesting import _records
from songsift.schemas import CATALOGUE, SONG_GROUPS
from songsift.session import ROWS_PER_FILE, scratch_path, settle, shared_folder, temporary
from songsift.sources.catalogue import (
    decode_text_columns,
    read_catalogue,
    select_song_fields,
    write_catalogue,
)
from songsift.sources.files import list_files
from songsift.sources.ragged import assemble_ragged, assign_values, song_spans
from songsift.sources.staging import read_staging_csv, write_staging_csv
from tests.conftest import plan_of, rows


def test_catalogue_round_trip(spark, songs, tmp_path):
    path = str(tmp_path / "catalogue")
    write_catalogue(songs, path, partition_by=("year",))
    back = read_catalogue(spark, path).select(*songs.columns)
    assert rows(back) == rows(songs)
    assert [f.dataType for f in back.schema] == [f.dataType for f in CATALOGUE]


def test_list_text_becomes_arrays(spark, tmp_path):
    path = str(tmp_path / "text")
    spark.createDataFrame(
        [("S", "['a', 'b']", "[1. 2.]", 1999, "x")],
        "song_id string, artist_terms string, beats_start string, year bigint, other string",
    ).write.parquet(path)
    assert rows(read_catalogue(spark, path)) == [("S", ["a", "b"], [1.0, 2.0], 1999, "x")]
    assert read_catalogue(spark, path, typed=False).schema["artist_terms"].dataType.simpleString() == "string"


def test_list_files(spark, tmp_path):
    for name in ("a/b/one.h5", "a/two.h5", "a/no.txt", "a/h5"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    found = list_files(spark, str(tmp_path))
    assert sorted(os.path.basename(r["path"]) for r in found.collect()) == ["one.h5", "two.h5"]
    assert {r["length"] for r in found.collect()} == {3}


def test_staging_csv_is_lossless(spark, tmp_path):
    texts = ['say "hi"', "a, b", "back\\slash", "two\nlines", "", None, "NA", "\\N", "\\\\N", " pad ", "é"]
    df = spark.createDataFrame(
        [(i, t, None if t is None else [t, "x"], [0.5, 1e-300] if i % 2 else [], 1.5 if i else None)
         for i, t in enumerate(texts)],
        "i int, t string, l array<string>, n array<double>, x double",
    )
    path = str(tmp_path / "csv")
    write_staging_csv(df, path)
    assert rows(read_staging_csv(spark, path, df.schema)) == rows(df)


def test_packed_staging_csv_is_small_and_lossless(spark, tmp_path):
    df = spark.range(30_000).select(
        (F.col("id") % 3).cast("int").alias("p"),
        F.concat(F.lit("a title, \"quoted\" "), F.col("id").cast("string")).alias("t"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("x"), F.lit("y\n"))).alias("l"),
    )
    write_staging_csv(df, str(tmp_path / "plain"))
    write_staging_csv(df, str(tmp_path / "packed"), partition_by=("p",), packed=True)
    back = read_staging_csv(spark, str(tmp_path / "packed"), df.schema)
    assert back.schema.simpleString() == df.schema.simpleString() and rows(back) == rows(df)
    sizes = [sum(f.stat().st_size for f in (tmp_path / d).rglob("*.csv*")) for d in ("plain", "packed")]
    assert sizes[1] < sizes[0] / 2
    assert "p=1" in "".join(back.filter("p = 1").inputFiles())


def test_decode_text_columns(spark):
    df = spark.createDataFrame(
        [(bytearray("é".encode()), [bytearray(b"a"), None], 1, None)],
        "a binary, b array<binary>, c int, d binary",
    )
    assert rows(decode_text_columns(df)) == [("é", ["a", None], 1, None)]


def test_select_song_fields(songs):
    nested = songs.select(
        *[F.struct(*names, F.lit(1).alias("unused")).alias(group) for group, names in SONG_GROUPS.items()]
    )
    picked = select_song_fields(nested)
    assert len(picked.columns) == 25 and "unused" not in picked.columns
    assert set(picked.columns) == {f.name for f in CATALOGUE} - {"artist_genre"}


def ragged(spark, lengths_by_file, lead=0):
    offsets, values, want = [], [], {}
    for file, lengths in lengths_by_file.items():
        pos = lead
        for i, n in enumerate(lengths):
            offsets.append((file, i, pos))
            want[file, i] = [f"{file}{p}" for p in range(pos, pos + n)]
            pos += n
        values += [(file, p, f"{file}{p}") for p in range(pos)]
    return (
        spark.createDataFrame(offsets, "file string, songidx bigint, idx bigint"),
        spark.createDataFrame(values or [("z", 0, "z")], "file string, pos bigint, v string"),
        want,
    )


@pytest.mark.parametrize("span", [1, 3, 65_536])
def test_ragged_arrays(spark, span):
    rng = np.random.default_rng(1)
    offsets, values, want = ragged(
        spark, {"f": [2, 0, 0, 5, 1], "g": [0], "h": rng.integers(0, 9, 60).tolist(), "i": [0, 3, 0]}
    )
    got = assemble_ragged(offsets, values.repartition(4), span=span)
    assert {(r["file"], r["songidx"]): r["values"] for r in got.collect()} == want
    assert {r["part"] for r in got.collect()} == {0}
    flat = assign_values(offsets, values, span)
    assert flat.count() == sum(map(len, want.values()))


def test_values_before_the_first_song_are_nobodys(spark):
    offsets, values, want = ragged(spark, {"f": [2, 1]}, lead=3)
    got = assemble_ragged(offsets, values, span=2)
    assert {(r["file"], r["songidx"]): r["values"] for r in got.collect()} == want


def test_long_songs_continue_in_parts(spark):
    offsets, values, want = ragged(spark, {"f": [25, 3]})
    got = assemble_ragged(offsets, values, part_size=10, span=4)
    parts = {(r["songidx"], r["part"]): r["values"] for r in got.collect()}
    assert [len(parts[0, p]) for p in range(3)] == [10, 10, 5] and len(parts) == 4
    assert sum((parts[0, p] for p in range(3)), []) == want["f", 0]


def test_ragged_rows_of_arrays(spark):
    offsets = spark.createDataFrame([("f", 0, 0), ("f", 1, 2)], "file string, songidx bigint, idx bigint")
    values = spark.createDataFrame(
        [("f", 0, [1.0, 2.0]), ("f", 1, [3.0, 4.0]), ("f", 2, [5.0, 6.0])],
        "file string, pos bigint, v array<double>",
    )
    assert rows(assemble_ragged(offsets, values), "songidx", "values") == [
        (0, [[1.0, 2.0], [3.0, 4.0]]),
        (1, [[5.0, 6.0]]),
    ]


def test_gap_in_song_numbers_is_an_error(spark):
    offsets = spark.createDataFrame([("f", 0, 0), ("f", 2, 1)], "file string, songidx bigint, idx bigint")
    values = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b")], "file string, pos bigint, v string")
    with pytest.raises(PySparkException, match="without gaps"):
        song_spans(offsets, values).collect()


def test_settle_writes_to_the_shared_folder(spark):
    folder = shared_folder(spark)
    assert scratch_path(spark, "x").startswith(folder)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    df = spark.range(100).selectExpr("id", "id % 3 as k").coalesce(1)
    assert rows(settle(df, "t")) == rows(df)
    many = spark.range(3 * ROWS_PER_FILE).coalesce(1)
    wide = settle(many, "t", spread=True)
    assert wide.count() == many.count()
    assert len(wide.inputFiles()) == 3  # by the rows, not by the cores
    assert all(folder.rstrip("/") in file for file in wide.inputFiles())


def test_temporary_tables_go(spark):
    with temporary(spark):
        kept = [settle(spark.range(5), "a"), settle(spark.range(5), "b", spread=True)]
        paths = [f.rsplit("/", 1)[0].removeprefix("file:") for k in kept for f in k.inputFiles()]
        assert all(os.path.isdir(p) for p in paths)
        assert kept[0].count() == 5
    assert not any(os.path.exists(p) for p in paths)
    assert os.path.isdir(shared_folder(spark).removeprefix("file:"))


def test_the_session_keeps_its_settings(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_one_large_staging_file_is_read_by_several_tasks(spark, tmp_path):
    text = "line one\nline two\r\n\\N \"quoted\", and \\s \\n more"
    df = spark.range(20_000).select("id", F.lit(text).alias("text"), F.array(F.lit("a\nb")).alias("many"))
    path = str(tmp_path / "csv")
    write_staging_csv(df.coalesce(1), path)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        back = read_staging_csv(spark, path, df.schema)
        assert back.rdd.getNumPartitions() > 4
        assert back.count() == back.select("id").distinct().count() == 20_000
        assert back.filter((F.col("text") == text) & (F.col("many")[0] == "a\nb")).count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_stored_lists_are_parsed_late(spark, songs, tmp_path):
    stored = songs.withColumn("artist_terms", F.concat(F.lit("['"), F.array_join("artist_terms", "', '"), F.lit("']")))
    stored = stored.withColumn("beats_start", F.lit("[0.1 0.2 ... 9.]"))
    write_catalogue(stored, str(tmp_path / "c"))
    late = read_catalogue(spark, str(tmp_path / "c"), lists=False)
    plan = plan_of(token_count(late, "artist_terms"))
    assert plan.index("from_json") < plan.rindex("HashAggregate")
    assert "try_cast" not in plan_of(drop_missing(late.select("loudness", "beats_start")))
    early = read_catalogue(spark, str(tmp_path / "c"))
    assert rows(token_count(late, "artist_terms")) == rows(token_count(early, "artist_terms"))


def test_terms_are_parsed_on_the_rows_of_part(spark, sf_dir):
    plan = plan_of(_records(spark, sf_dir))
    assert plan.index("Join") < plan.index("from_json")  # below the join, so not for each song


def test_bytes_that_are_no_text_are_an_error(spark):
    for broken in ([(bytearray(b"a\xff"), [])], [(None, [bytearray(b"a"), bytearray(b"\xc3")])]):
        with pytest.raises(PySparkException):
            decode_text_columns(spark.createDataFrame(broken, "a binary, b array<binary>")).collect()
