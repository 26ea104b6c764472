"""Counts and means per group and per token, and top-k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songsift.functions.lists import clean_tokens, parse_list
from songsift.functions.numeric import is_missing, is_valid_nonzero


#: The error of a sketch of ``n`` tokens is at most this share of all tokens, divided by ``n``.
_SLACK = 3.5


def order_desc(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Largest first; ``ties`` make the order of equal values definite."""
    return df.orderBy(F.desc(column), *ties)


def top_k(df: DataFrame, k: int, column: str, *ties: str) -> DataFrame:
    return order_desc(df, column, *ties).limit(k)


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, nulls left out."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    )


def count_entities_by(df: DataFrame, column: str, entity: str, approx: bool = False) -> DataFrame:
    """Different entities (such as artists) per value, rather than rows."""
    counter = F.approx_count_distinct if approx else F.count_distinct
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(counter(entity).alias("count"))


def mean_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of ``value`` per ``key``, for keys that are present and not zero."""
    return df.filter(is_valid_nonzero(df, key)).groupBy(key).agg(F.avg(value).alias("mean"))


def list_totals(df: DataFrame, column: str, metrics: list[str]) -> DataFrame:
    """Songs, and the sum and number of each metric, per different list.

    Songs of one artist share the same list, so this table is far smaller than
    the catalogue.  Everything that is asked per token can be had from it, and
    each list is parsed once.
    """
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(
            F.count(F.lit(1)).alias("songs"),
            *[F.sum(F.when(~is_missing(df, m), F.col(m))).alias(f"sum_{m}") for m in metrics],
            *[F.count(F.when(~is_missing(df, m), F.col(m))).alias(f"n_{m}") for m in metrics],
        )
    )


def _tokens(lists: DataFrame, column: str) -> Column:
    is_text = isinstance(lists.schema[column].dataType, T.StringType)
    return parse_list(F.col(column)) if is_text else F.col(column)


def token_count(df: DataFrame, column: str) -> DataFrame:
    """Occurrences of every token of a list column, case kept."""
    return count_tokens(list_totals(df, column, []), column)


def count_tokens(lists: DataFrame, column: str, only: DataFrame | None = None) -> DataFrame:
    """``token_count`` from the totals per list; of the tokens in ``only`` if it is given, a short list."""
    tokens = (
        lists.select(F.explode(_tokens(lists, column)).alias("term"), "songs")
        .select(F.trim("term").alias("term"), "songs")
        .filter("term != ''")
    )
    if only is not None:
        tokens = tokens.join(F.broadcast(only), "term", "left_semi")
    return (
        tokens.groupBy("term")
        .agg(F.sum("songs").alias("count"))
    )


def token_state(df: DataFrame, column: str, tracked: int = 10_000) -> DataFrame:
    """A mergeable sketch of the most common tokens, with the number of all tokens.

    The sketch holds ``tracked`` tokens, whatever the input.
    """
    found = df.filter(F.col(column).isNotNull()).select(
        F.explode(_tokens(df, column)).alias("term")
    )
    terms = found.select(F.trim("term").alias("term")).filter("term != ''")
    state = terms.groupBy(F.lit(0).alias("_all")).agg(
        F.expr(f"approx_top_k_accumulate(term, {tracked})").alias("sketch"),
        F.count(F.lit(1)).alias("tokens"),
    )
    return state.drop("_all")


def common_tokens(states: DataFrame, k: int, tracked: int = 10_000) -> tuple[DataFrame, bool]:
    """From the states of all parts the tokens that can be among the ``k`` most common, and
    whether that is certain.

    A sketch's count is too high by at most ``_SLACK / tracked`` of all tokens,
    and a token it does not hold is no more common than twice that.  So the k-th
    largest count, less the error, is a bound: tokens that cannot reach it
    are out, and if it lies above what a token outside may have, none is missing.
    """
    # By a constant, since a sketch of no state cannot be made.
    merged = states.groupBy(F.lit(0).alias("_all")).agg(
        F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"),
        F.sum("tokens").alias("tokens"),
    )
    # One row for each token that the sketch holds.
    held = merged.select(
        F.inline(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("term", "count"), "tokens"
    )
    rows = held.orderBy(F.desc("count"), "term").collect()
    if len(rows) < k:
        return states.sparkSession.createDataFrame([], "term string"), False
    error = math.ceil(_SLACK / tracked * rows[0]["tokens"])
    bound = rows[k - 1]["count"] - error
    terms = [(r["term"],) for r in rows if r["count"] >= bound]
    return states.sparkSession.createDataFrame(terms, "term string"), bound > 2 * error


def most_common_tokens(
    df: DataFrame, column: str, k: int, states: DataFrame | None = None, tracked: int = 10_000
) -> DataFrame:
    """The ``k`` most common tokens with their exact counts, equal counts by token.

    A first pass (or the stored ``states`` of all parts) leaves few tokens, which
    a second one counts exactly, so only these are shuffled.  Where the sketch
    cannot tell, as with tokens that are all about as common, all are counted.
    """
    states = token_state(df, column, tracked) if states is None else states
    terms, certain = common_tokens(states, k, tracked)
    lists = list_totals(df, column, [])
    if not certain:
        return top_k(count_tokens(lists, column), k, "count", "term")
    return top_k(count_tokens(lists, column, terms), k, "count", "term")


def avg_metrics_by_token(
    df: DataFrame, column: str, metrics: list[str], terms: DataFrame
) -> DataFrame:
    """Mean of each metric over the songs whose list holds a term, without case.

    ``terms`` is a short list such as the top ten; a term that no song has gets
    0.0.  A song counts once per term, and a missing metric is left out.
    """
    return average_tokens(list_totals(df, column, metrics), column, metrics, terms)


def average_tokens(
    lists: DataFrame, column: str, metrics: list[str], terms: DataFrame
) -> DataFrame:
    """``avg_metrics_by_token`` from the totals per list."""
    names = [f"avg_{m}" for m in metrics]
    exploded = lists.withColumn(
        "term", F.explode(F.array_distinct(clean_tokens(_tokens(lists, column))))
    ).drop(column)
    wanted = terms.select(F.lower(F.trim("term")).alias("term")).filter("term != ''").distinct()
    means = (
        exploded.join(wanted, "term", "left_semi")
        .groupBy("term")
        .agg(
            F.sum("songs").alias("songs"),
            *[
                (F.sum(f"sum_{m}") / F.nullif(F.sum(f"n_{m}"), F.lit(0))).alias(name)
                for m, name in zip(metrics, names)
            ],
        )
    )
    return wanted.join(means, "term", "left").select(
        "term",
        F.coalesce("songs", F.lit(0)).alias("songs"),
        *[F.coalesce(name, F.lit(0.0)).alias(name) for name in names],
    )
