"""Equi-joins that stay balanced when a few keys hold much of the data."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songsift.session import settle

#: Rows of the looked-up side that are broadcast at once; by estimate 150 MB for short texts.
ROWS_AT_ONCE = 500_000


def lookup(facts: DataFrame, dim: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join the large ``facts`` to ``dim``, whatever share of ``facts`` a key has.

    Adaptive execution cuts the rows of an overfull partition by the tasks that
    wrote them, so any number of hot keys is split, rows that are equal in all
    columns too, and a repeated task sends its rows the same way.  It does so
    only where both sides come straight from a shuffle.  A ``dim`` that is the
    result of an aggregate on the key does not, so ``dim`` is written to the
    shared folder first.  Its written size also lets Spark broadcast it if small.
    """
    return facts.join(settle(dim, "lookup"), on, how)


def lookup_by_parts(
    facts: DataFrame, dim: DataFrame, on: list[str], part: str, at_once: int = ROWS_AT_ONCE
) -> Iterator[DataFrame]:
    """Left join of ``facts`` to ``dim``, a few parts at a time, without a shuffle of ``facts``.

    ``part`` is a number of both sides that follows from the keys, and ``facts``
    are stored in folders by it.  The frames together are the join; each reads
    the folders of as many parts as have ``at_once`` rows of ``dim``, which are
    broadcast.  So neither the rows of a key nor the number of keys matter, and
    wide facts go through no shuffle and no sort.  A part that alone has more
    is left to Spark's join.  Each key is once in ``dim``, which should be
    settled; missing keys equal each other.
    """
    runs, rows = [[]], [0]
    for number, n in dim.groupBy(part).count().orderBy(part).collect():
        if runs[-1] and rows[-1] + n > at_once:
            runs.append([])
            rows.append(0)
        runs[-1].append(number)
        rows[-1] += n
    found = [name for name in dim.columns if name not in (*on, part)]
    for run, n in zip(runs, rows):
        some = facts.filter(F.col(part).isin(run))
        known = dim.filter(F.col(part).isin(run)).withColumnsRenamed({name: f"_{name}" for name in on}).drop(part)
        if n <= at_once:
            known = F.broadcast(known)
        same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in on])
        yield some.join(known, same, "left").select(*[c for c in facts.columns if c != part], *found)
