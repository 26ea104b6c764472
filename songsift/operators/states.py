"""Profiles and counts that are kept for each part of a growing catalogue and merged.

A state is a small table that a part yields once.  States of parts are stored side
by side, a part that comes again replaces its own, and merging them reads no song.
Numbers of values, means, deviations and extremes are exact; quantiles and
numbers of different entities come from sketches of a bounded size with a known
error.  ``describe_columns`` and ``count_entities_by`` give exact ones from the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from songsift.functions.numeric import is_missing

#: Values that a quantile sketch keeps, and the rank error that goes with it.
KLL_K, RANK_ERROR = 4096, 0.002
#: The logarithm of the buckets of a distinct sketch; the relative error is about 1.04 / sqrt(2 ** it).
HLL_K = 16


def profile_state(df: DataFrame, columns: list[str]) -> DataFrame:
    """The state of each column, in one pass.

    ``rows``, ``missing`` (null or NaN), ``n`` other values with their ``mean``,
    sum of squared deviations ``m2``, ``min``, ``max`` and quantile ``sketch``.
    """

    def state(c: str):
        value = F.when(~is_missing(df, c), F.col(c).cast("double"))
        return F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(is_missing(df, c)).alias("missing"),
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            (F.var_pop(value) * F.count(value)).alias("m2"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.kll_sketch_agg_double(value, F.lit(KLL_K)).alias("sketch"),
        )

    return df.agg(F.array(*map(state, columns)).alias("states")).select(F.inline("states"))


def merge_profiles(states: DataFrame) -> DataFrame:
    """One state for each column from the states of all parts.

    Deviations are added around the common mean, so no large squares cancel out.
    """
    own = W.partitionBy("column")
    mean = F.sum(F.col("n") * F.col("mean")).over(own) / F.nullif(F.sum("n").over(own), F.lit(0))
    return (
        states.withColumn("_mean", mean)
        .groupBy("column")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("missing").alias("missing"),
            F.sum("n").alias("n"),
            F.max("_mean").alias("mean"),
            F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2).alias("m2"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.kll_merge_agg_double("sketch").alias("sketch"),
        )
    )


def describe_state(
    state: DataFrame, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """The table of ``describe_columns`` from states, with ``missing``; quantiles within the sketch's error."""
    return state.select(
        "column",
        "missing",
        F.col("n").alias("count"),
        "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"),
        "min",
        *[
            F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(
                f"p{round(100 * p)}"
            )
            for p in probabilities
        ],
        "max",
    )


def entity_state(df: DataFrame, column: str, entity: str) -> DataFrame:
    """For each value of ``column`` a sketch of its different entities; nulls left out."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.hll_sketch_agg(entity, HLL_K).alias("sketch"))
    )


def merge_entities(states: DataFrame, column: str) -> DataFrame:
    """``column`` and ``count``, the different entities over all parts."""
    return states.groupBy(column).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("count")
    )


def store_state(state: DataFrame, path: str, part: str) -> None:
    """Keep the state of a part; one that is there for the same part is replaced."""
    (
        state.withColumn("part", F.lit(part))
        .coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("part")
        .parquet(path)
    )


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    """The states of all parts."""
    return spark.read.parquet(path).drop("part")
