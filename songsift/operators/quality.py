"""Filters and profiles for missing, zero and extreme values."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from songsift.functions.numeric import is_missing


def drop_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows where any of the columns is null or NaN."""
    missing = [is_missing(df, c) for c in (columns or df.columns)]
    return df.filter(~reduce(or_, missing))


def drop_zero(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows where a column holds 0, the mark for an unknown value."""
    return df.filter(reduce(and_, [F.col(c) != 0 for c in columns]))


def drop_na(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Number of null or NaN values per column, counted in a single pass."""
    columns = columns or df.columns
    counts = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "missing")


def _measure(wide: DataFrame, probabilities: list[float], accuracy: int) -> dict[str, Row]:
    """Count, mean, deviation, minimum and maximum of every column, in one pass.

    Also ``ends``, approximate percentiles a little below and above each probability.
    """
    margin = 2 / accuracy
    shares = [s for p in probabilities for s in (max(0.0, p - margin), min(1.0, p + margin))]
    measures = (
        ("count", F.count),
        ("mean", F.avg),
        ("std", F.stddev_samp),
        ("min", F.min),
        ("max", F.max),
    )
    row = wide.agg(
        *[
            F.struct(
                *[f(F.when(~is_missing(wide, c), F.col(c))).alias(name) for name, f in measures],
                F.percentile_approx(
                    F.when(~is_missing(wide, c), F.col(c)), F.array(*map(F.lit, shares or [0.5])), accuracy
                ).alias("ends"),
            ).alias(c)
            for c in wide.columns
        ]
    ).first()
    return {c: row[c] for c in wide.columns}


def _as_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, with null for NaN."""
    values = {c: F.col(c).cast("double") for c in columns}
    return df.select(*[F.when(~F.isnan(v), v).alias(c) for c, v in values.items()])


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    rows_per_task: int = 5_000_000,
    accuracy: int = 10_000,
) -> dict[tuple[str, float], float]:
    """Linear-interpolated quantiles, exact at any size, keyed by (column, probability).

    Approximate percentiles a little below and above each wanted rank bracket
    it, whatever the values are, infinities included; they come with the count,
    in one pass.  Another counts the rows below and inside each bracket.  A
    bracket that misses its rank keeps all values, and one with more than
    ``rows_per_task`` rows is narrowed in the same way.  Then the values left are
    counted and the ranks are read off a running total: three passes, unless a
    bracket has to be narrowed.  The driver sees single values only, never the rows.
    """
    wide = _as_doubles(df, columns)
    measured = _measure(wide, probabilities, accuracy)
    return _quantiles(wide, measured, probabilities, rows_per_task, accuracy)


def _quantiles(
    wide: DataFrame,
    measured: dict[str, Row],
    probabilities: list[float],
    rows_per_task: int = 5_000_000,
    accuracy: int = 10_000,
) -> dict[tuple[str, float], float]:
    brackets = {}  # (column, rank) -> (lowest, highest, rows below, rows inside)
    positions, ends = {}, {}
    for c, m in measured.items():
        for i, p in enumerate(probabilities if m["count"] else []):
            position = p * (m["count"] - 1)
            positions[c, p] = position
            for rank in (math.floor(position), math.ceil(position)):
                brackets[c, rank] = (m["min"], m["max"], 0, m["count"])
                ends[c, rank] = (m["ends"][2 * i], m["ends"][2 * i + 1])

    open_ = {key: b for key, b in brackets.items() if b[0] < b[1]}
    if open_:
        brackets |= _counted(wide, open_, ends)
    stuck = set()
    while True:
        wanted = {
            key: b
            for key, b in brackets.items()
            if b[0] < b[1] and b[3] > rows_per_task and key not in stuck
        }
        if not wanted:
            break
        for key, narrowed in _narrow(wide, wanted, accuracy).items():
            if narrowed == brackets[key]:
                stuck.add(key)
            brackets[key] = narrowed

    ranked = _values_at(wide, brackets)
    result = {}
    for (c, p), position in positions.items():
        low, high = ranked[c, math.floor(position)], ranked[c, math.ceil(position)]
        result[c, p] = _between(low, high, position - math.floor(position))
    return result


def _in_brackets(wide: DataFrame, brackets: dict) -> tuple[list, DataFrame]:
    """Rows of ``slot, value``: the values in each different (column, lowest, highest)."""
    ranges = sorted({(c, b[0], b[1]) for (c, _), b in brackets.items()})
    slots = [
        F.when(F.col(c).between(lo, hi), F.col(c)).alias(str(slot))
        for slot, (c, lo, hi) in enumerate(ranges)
    ]
    narrow = wide.select(*slots)
    return ranges, narrow.unpivot([], narrow.columns, "slot", "value").filter("value IS NOT NULL")


def _between(low: float, high: float, share: float) -> float:
    """The value ``share`` of the way from ``low`` to ``high``; an infinite end wins."""
    if low == high or not share:
        return low
    if math.isinf(low) or math.isinf(high):
        return low * (1 - share) + high * share
    return low + (high - low) * share


def _narrow(wide: DataFrame, brackets: dict, accuracy: int) -> dict:
    """Each bracket with ends close to its rank; as it was if these miss the rank."""
    margin = 2 / accuracy
    # One sketch for all ranks within the same values of a column.
    wanted: dict[tuple, list[float]] = {}
    for (c, rank), (lo, hi, below, inside) in brackets.items():
        share = (rank - below) / max(1, inside - 1)
        wanted.setdefault((c, lo, hi), []).extend([max(0.0, share - margin), min(1.0, share + margin)])
    sketches = [
        F.percentile_approx(F.when(F.col(c).between(lo, hi), F.col(c)), F.array(*map(F.lit, shares)), accuracy)
        for (c, lo, hi), shares in wanted.items()
    ]
    row = wide.agg(*[e.alias(str(i)) for i, e in enumerate(sketches)]).first()
    ends = {key: iter(zip(row[i][::2], row[i][1::2])) for i, key in enumerate(wanted)}
    found = {key: next(ends[key[0], *b[:2]]) for key, b in brackets.items()}
    return _counted(wide, brackets, found)


def _counted(wide: DataFrame, brackets: dict, found: dict) -> dict:
    """Each bracket with the ``found`` ends and its rows, or as it was if these miss the rank."""
    # Floor and ceiling of a rank mostly have the same ends.
    ranges = list(dict.fromkeys((c, *found[c, rank]) for c, rank in brackets))
    row = wide.agg(
        *[
            F.struct(
                F.count_if(F.col(c) < lo).alias("below"),
                F.count_if(F.col(c).between(lo, hi)).alias("inside"),
            ).alias(str(i))
            for i, (c, lo, hi) in enumerate(ranges)
        ]
    ).first()
    counts = dict(zip(ranges, row))
    narrowed = {}
    for (c, rank), bracket in brackets.items():
        below, inside = counts[c, *found[c, rank]]
        holds = below <= rank < below + inside
        narrowed[c, rank] = (*found[c, rank], below, inside) if holds else bracket
    return narrowed


def _values_at(wide: DataFrame, brackets: dict) -> dict:
    if not brackets:
        return {}
    ranges, tagged = _in_brackets(wide, brackets)
    wanted = {}
    for (c, rank), (lo, hi, below, _) in brackets.items():
        slot = str(ranges.index((c, lo, hi)))
        wanted.setdefault(slot, []).append((rank - below, c, rank))
    running = W.partitionBy("slot").orderBy("value")
    totals = (
        tagged.groupBy("slot", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(running))
    )
    hits = reduce(
        or_,
        [
            (F.col("slot") == slot)
            & (F.col("upto") > offset)
            & (F.col("upto") - F.col("n") <= offset)
            for slot, entries in wanted.items()
            for offset, _, _ in entries
        ],
    )
    rows = totals.filter(hits).collect()  # at most one row per wanted rank
    return {
        (c, rank): row["value"]
        for row in rows
        for offset, c, rank in wanted[row["slot"]]
        if row["upto"] - row["n"] <= offset < row["upto"]
    }


def describe_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum; one row per column."""
    wide = _as_doubles(df, columns)
    shares = [0.25, 0.5, 0.75]
    measured = _measure(wide, shares, 10_000)
    quartiles = _quantiles(wide, measured, shares)
    return df.sparkSession.createDataFrame(
        [
            (
                c,
                *[measured[c][name] for name in ("count", "mean", "std", "min")],
                *[quartiles.get((c, p)) for p in (0.25, 0.5, 0.75)],
                measured[c]["max"],
            )
            for c in columns
        ],
        "column string, count bigint, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double",
    )


def clip_outliers(
    df: DataFrame,
    column: str,
    lo: float | None = None,
    hi: float | None = None,
    tail: float | None = None,
) -> DataFrame:
    """Keep rows whose value lies in ``[lo, hi]``.

    With ``tail`` the bounds are the exact quantiles ``tail`` and ``1 - tail``.
    The bounds are plain numbers, so the filter reaches the scan.
    """
    if tail is not None:
        found = exact_quantiles(df, [column], [tail, 1 - tail])
        if not found:
            return df.filter(F.lit(False))
        lo, hi = found[column, tail], found[column, 1 - tail]
    if lo is None or hi is None:
        raise ValueError("give lo and hi, or tail")
    return df.filter(F.col(column).between(lo, hi))
