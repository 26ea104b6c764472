"""Per-song arrays from flat value tables and start offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def song_spans(offsets: DataFrame, values: DataFrame) -> DataFrame:
    """The half-open range ``[lo, hi)`` of value positions that each song owns.

    ``offsets`` has ``file, songidx, idx`` with ``songidx`` counting the rows of
    a file from 0 without gaps; ``values`` has ``file, pos, v``.  A song ends
    where the next one starts, the last one at the end of its file.  The next
    song is found by an equi-join on ``(file, songidx)``, not by a window over
    the file, so a file that holds most of the songs is still spread out.
    """
    lengths = values.groupBy("file").agg((F.max("pos") + 1).alias("hi"))
    last = (
        offsets.groupBy("file")
        .agg(F.max("songidx").alias("songidx"))
        .join(lengths, "file", "left")
        .select("file", "songidx", F.coalesce("hi", F.lit(0)).alias("hi"))
    )
    ends = offsets.select(
        "file", (F.col("songidx") - 1).alias("songidx"), F.col("idx").alias("hi")
    ).filter("songidx >= 0")
    gap = F.raise_error(F.lit("songidx must count the songs of a file without gaps"))
    return offsets.join(ends.unionByName(last), ["file", "songidx"], "left").select(
        "file",
        "songidx",
        F.col("idx").alias("lo"),
        F.when(F.col("hi").isNull(), gap.cast("bigint")).otherwise(F.col("hi")).alias("hi"),
    )


def assign_values(offsets: DataFrame, values: DataFrame, span: int = 65_536) -> DataFrame:
    """Each value with the song that owns it: ``file, songidx, ordinal, v``.

    Positions are cut into blocks of ``span``.  A song leaves a mark at its
    start and at the start of each further block it reaches, and every value
    takes the last mark before it.  A block holds at most ``span`` values, so no
    task depends on how large a file or a song is.
    """
    return _assign(song_spans(offsets, values), values, span)


def _assign(spans: DataFrame, values: DataFrame, span: int) -> DataFrame:
    first, last = F.expr(f"lo div {span}"), F.expr(f"(hi - 1) div {span}")
    marks = (
        spans.filter("hi > lo")
        .withColumn("block", F.explode(F.sequence(first, last)))
        .select(
            "file",
            "block",
            F.greatest("lo", F.col("block") * span).alias("pos"),
            F.lit(None).cast(values.schema["v"].dataType).alias("v"),
            F.struct("songidx", "lo").alias("song"),
        )
    )
    tagged = values.select(
        "file", F.expr(f"pos div {span}").alias("block"), "pos", "v", F.lit(None).alias("song")
    )
    seen = W.partitionBy("file", "block").orderBy("pos", F.col("song").isNull())
    owner = F.last("song", ignorenulls=True).over(
        seen.rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        marks.unionByName(tagged)
        .withColumn("owner", owner)
        .filter(F.col("song").isNull() & F.col("owner").isNotNull())
        .select(
            "file",
            F.col("owner.songidx").alias("songidx"),
            (F.col("pos") - F.col("owner.lo")).alias("ordinal"),
            "v",
        )
    )


def whole_arrays(parts: DataFrame) -> DataFrame:
    """One array per song, ``file, songidx, values``, from the parts of ``assemble_ragged``."""
    listed = F.array_sort(F.collect_list(F.struct("part", "values")))
    return parts.groupBy("file", "songidx").agg(
        F.flatten(F.transform(listed, lambda part: part["values"])).alias("values")
    )


def assemble_ragged(
    offsets: DataFrame, values: DataFrame, part_size: int = 100_000, span: int = 65_536
) -> DataFrame:
    """Arrays per song: ``file, songidx, part, values``; ``v`` may itself be an array.

    A song with up to ``part_size`` values is one row with part 0, also when it
    has none.  A longer one continues in parts 1, 2, ... so that no row grows
    beyond ``part_size`` values and none is lost.
    """
    spans = song_spans(offsets, values)
    owned = _assign(spans, values, span)
    arrays = (
        owned.groupBy("file", "songidx", F.expr(f"ordinal div {part_size}").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "v"))).alias("pairs"))
        .select("file", "songidx", "part", F.col("pairs.v").alias("values"))
    )
    empty = spans.filter("hi <= lo").select(
        "file",
        "songidx",
        F.lit(0).cast("bigint").alias("part"),
        F.array().cast(arrays.schema["values"].dataType).alias("values"),
    )
    return arrays.unionByName(empty)
