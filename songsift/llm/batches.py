"""Texts through Arrow in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = "_text"
PIECE = 4 << 20


def pieces(batches: Iterable[pa.RecordBatch], column: str = TEXT, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices whose ``column`` holds about ``size`` bytes each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        begin = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)) // size
        cuts = np.flatnonzero(np.diff(begin)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = TEXT) -> list[bytes]:
    """The texts as UTF-8, a null one as empty."""
    return [t or b"" for t in batch.column(column).to_pylist()]


def slices(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes, cut at blanks only."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def per_text(
    df: DataFrame,
    work: Callable[[], Callable[[list[bytes]], list]],
    fields: str,
    keep: list[str],
    text: str = "text",
    size: int = PIECE,
) -> DataFrame:
    """``keep`` and ``fields``, computed from each row's text.

    ``work`` is called once in each task and gives the function from a list of
    texts to one array or list per field.  Other columns of ``df`` are dropped,
    whatever their names.
    """
    types = dict(df.dtypes)
    kept = ", ".join(f"`{c}` {types[c]}" for c in keep)
    names = T.StructType.fromDDL(fields).names
    clash = set(names) & set(keep)
    if clash:
        raise ValueError(f"rename {sorted(clash)} before keeping them")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for piece in pieces(batches, size=size):
            found = [x if isinstance(x, pa.Array) else pa.array(x) for x in function(texts_of(piece))]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *found], [*keep, *names])

    slim = df.select(*keep, F.col(text).cast("binary").alias(TEXT))
    return slim.mapInArrow(run, f"{kept}, {fields}" if kept else fields)


def first_of_each(df: DataFrame, group: str, order: list[str | Column], n: int) -> DataFrame:
    """About ``n`` rows of each ``group``, those that come first by a hash of ``order``.

    Each group is dealt over parts by the hash, and each part gives its first few
    rows.  So few are wanted of a part that Spark keeps no more than these of any
    task before the shuffle, and a group with most of the rows sends no more than
    the others.
    """
    parts = -(-n // 500)
    first = Window.partitionBy(group, "_part").orderBy("_hash", *order)
    ranked = (
        df.withColumn("_hash", F.xxhash64(*order))
        .withColumn("_part", F.pmod(F.hash("_hash"), F.lit(parts)))
        .withColumn("_rank", F.row_number().over(first))
    )
    return ranked.filter(F.col("_rank") <= -(-n // parts)).drop("_part", "_rank")
