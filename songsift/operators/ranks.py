"""Row numbers in a given order that never bring the rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from songsift.session import settle

#: ``monotonically_increasing_id`` holds the partition above and the place below this bit.
_BITS = 33


def number_rows(
    df: DataFrame, order: list[Column], within: tuple[str, ...] = (), output: str = "rank"
) -> DataFrame:
    """``df`` with ``output``: 0 for the first row in ``order``, for each ``within`` apart.

    Rows are range partitioned and sorted, and each takes its place in its
    partition plus the rows of its group in the partitions before.  Those counts
    are one row for each partition and group, added up by windows that hold one
    group's partitions only.  So a group with most of the rows is spread over
    many tasks.  ``order`` should tell the rows of a group apart, since rows
    that are equal in it share a partition; their numbers are in no definite order.
    """
    keys = [F.col(c) for c in within]
    placed = settle(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_part", F.shiftright("_at", _BITS))
    sizes = placed.groupBy(*within, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    before = F.sum("_n").over(
        W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    )
    starts = settle(
        sizes.select(
            F.col("_part").alias("_of"),
            *[F.col(c).alias(f"_{i}") for i, c in enumerate(within)],
            (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
        ),
        "starts",
    )
    same = F.col("_part") == F.col("_of")
    for i, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"_{i}"))
    return placed.join(starts, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(output))
