"""The registered queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: QueryFn
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register the function under ``name``, or its own name, with its SQL if there is one."""

    def register(run: QueryFn) -> QueryFn:
        key = name or run.__name__
        if key in ENTRIES:
            raise ValueError(f"{key} is registered twice")
        ENTRIES[key] = Entry(run, sql)
        return run

    return register


def load() -> dict[str, Entry]:
    from songsift.registry import (  # noqa: F401
        classifying,
        cleaning,
        clustering,
        counting,
        growing,
        ingesting,
        preparing,
    )

    return ENTRIES
