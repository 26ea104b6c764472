"""Removal of long repeated byte strings, by suffix arrays over difference covers.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else, in the same text or another.  Strings are judged on the input and never
cross texts.

Suffixes that share ``length`` bytes must meet before they can be sorted
together, and most share them with none.  So each possible start is filed under
its anchor: the ``gram`` bytes of its string whose hash is smallest.  Equal
strings have equal anchors at equal places.  Starts with the same anchor are
neighbours, so a text becomes a few runs of starts, about three for each
``length`` bytes, and runs whose anchor occurs once are done.  The others:

1. A run with all the bytes its strings cover is a context.  Of equal contexts
   one is kept and counted; all strings of a context that occurs twice repeat.
2. Different contexts with the same anchor are sorted: the tasks order their
   suffixes by difference cover, with triples of sampled positions, recursion on
   their names and a merge of the rest, and compare the first ``length`` bytes
   of neighbours.
3. An anchor with more than ``group`` different contexts is first split by the
   bytes that half of its strings have in common, again and again, until the
   parts are small or hold a single string each.  No anchor is too frequent.

A null or empty text has no bytes and keeps the hash of nothing; a text shorter
than ``length`` loses nothing.  Equal texts, null ids included, are joined by
their content, so repeated rows repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songsift.llm.batches import TEXT, pieces, texts_of
from songsift.llm.difference_cover import suffix_array
from songsift.session import settle

# Fixed value of the query.
LENGTH = 400
GRAM = 128
#: Different contexts of an anchor that are sorted in one go.
GROUP = 600
#: Bytes that are sorted in one go, and texts whose anchors are sought in one go.
SORTED, SCANNED = 1 << 19, 1 << 20
_PLACE_BITS = np.uint64(31)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        every = np.full(max(n, 2 * SCANNED) + 1, base, np.uint64)
        every[0] = 1
        found = _powers[base] = np.cumprod(every, dtype=np.uint64)
    return found[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place, by prefix sums of a polynomial."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers_of(_BASE, n), out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * _powers_of(_BASE_INVERSE, n - gram + 1)
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    return hashes


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs_of(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor's hash, first start, end, anchor's place) of each run of starts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.maximum(sizes - length + 1, 0)
    if not starts.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = gram_hashes(data, gram)
    # The smallest hash with its place, the leftmost of equal ones.
    packed = (hashes >> _PLACE_BITS) << _PLACE_BITS | np.arange(len(hashes), dtype=np.uint64)
    anchor = _sliding_min(packed, length - gram + 1) & np.uint64((1 << 31) - 1)
    owner = np.repeat(np.arange(len(texts)), starts)
    place = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
    anchor = anchor[begin[owner] + place].astype(np.int64)
    new = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(owner) != 0)))
    first, who = place[new], owner[new]
    end = np.append(place[new[1:] - 1], place[-1]) + 1
    return who, hashes[anchor[new]].view(np.int64), first, end, anchor[new] - begin[who]


def sliced_runs(texts: list[bytes], length: int, gram: int, size: int = SCANNED) -> list[tuple[np.ndarray, ...]]:
    """The runs of all texts; the starts of a long text are taken ``size`` at a time.

    The anchor of a string depends on nothing but the string, so cuts change no anchor.
    """
    slices = [
        (i, at, text[at : at + size + length - 1])
        for i, text in enumerate(texts)
        for at in range(0, max(0, len(text) - length + 1), size)
    ]
    out, at = [], 0
    while at < len(slices):
        last, total = at, 0
        while last < len(slices) and (last == at or total + len(slices[last][2]) <= 2 * size):
            total, last = total + len(slices[last][2]), last + 1
        some = slices[at:last]
        who, anchor, first, end, place = runs_of([s[2] for s in some], length, gram)
        owner, offset = (np.array([s[k] for s in some], np.int64)[who] for k in (0, 1))
        out.append((owner, anchor, first + offset, end + offset, place + offset))
        at = last
    return out


def text_key(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def _key_of(column: Column) -> Column:
    """The same in Spark."""
    return F.unhex(F.substring(F.sha2(column, 256), 1, 32))


def anchored_runs(df: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """``of`` (the text's key), ``anchor``, ``first`` and ``end`` of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, size=SCANNED):
            texts = texts_of(piece)
            keys = pa.array([text_key(t) if len(t) >= length else b"" for t in texts])
            for who, *columns in sliced_runs(texts, length, gram):
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(who)), *map(pa.array, columns)], ["of", "anchor", "first", "end", "place"]
                )

    schema = "of binary, anchor bigint, first bigint, end bigint, place bigint"
    return df.select(F.col(text).cast("binary").alias(TEXT)).mapInArrow(run, schema)


def contexts(work: DataFrame, length: int) -> DataFrame:
    """The runs of the texts in ``work``, each with the digest ``context`` of its bytes and the anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            for of, text, copies, runs in zip(*(piece.column(c).to_pylist() for c in ("of", TEXT, "copies", "runs"))):
                for r in runs:
                    a, e, place = r["first"], r["end"], r["place"]
                    digest = hashlib.blake2b(text[a : e + length - 1], digest_size=16)
                    digest.update(b"%d" % (place - a))
                    rows.append((of, r["anchor"], digest.digest(), a, e, place - a, copies))
            if rows:
                names = ["of", "anchor", "context", "first", "end", "place", "copies"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    schema = (
        "of binary, anchor bigint, context binary, first bigint, end bigint, place bigint, copies bigint"
    )
    return work.select("of", TEXT, "copies", "runs").mapInArrow(run, schema)


def context_texts(work: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The bytes of the ``chosen`` contexts, which has (of, anchor, context, first, end, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            for text, own in zip(*(piece.column(c).to_pylist() for c in (TEXT, "own"))):
                for r in own:
                    data = text[r["first"] : r["end"] + length - 1]
                    rows.append((r["anchor"], r["context"], data, 0, r["end"] - r["first"], r["place"]))
            if rows:
                names = ["anchor", "context", "data", "low", "high", "place"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    lists = chosen.groupBy("of").agg(F.collect_list(F.struct("anchor", "context", "first", "end", "place")).alias("own"))
    schema = "anchor bigint, context binary, data binary, low bigint, high bigint, place bigint"
    return work.select("of", TEXT).join(lists, "of").select(TEXT, "own").mapInArrow(run, schema)


def split_anchor(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Each row's starts in two, filed under the bytes that all strings of a half must have in common.

    A row of ``part`` p has starts from p * ``width`` to (p + 1) * ``width`` - 1
    bytes before the anchor.  ``width`` is a power of two.
    """
    half = width // 2
    columns = ["anchor", "context", "data", "low", "high", "place", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, context, data, low, high, place, part in zip(*(batch.column(c).to_pylist() for c in columns)):
                for child in (2 * part, 2 * part + 1):
                    near, far = child * half, (child + 1) * half
                    a, e = max(low, place - far + 1), min(high, place - near + 1)
                    if a < e:
                        common = data[place - near : max(0, place - far + 1 + length)]
                        core = hashlib.blake2b(common, digest_size=8)
                        core.update(b"%d %d" % (anchor, child))
                        number = int.from_bytes(core.digest(), "little", signed=True)
                        out.append((number, context, data, a, e, place, child))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], columns)

    return rows.select(*columns).mapInArrow(run, rows.select(*columns).schema)


def repeated_starts(texts: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> list[np.ndarray]:
    """Of each text the starts from ``low`` to ``high`` whose string of ``length`` bytes starts elsewhere too."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    counts = high - low
    eligible = np.zeros(len(data), bool)
    eligible[np.repeat(begin + low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))] = True
    order = suffix_array(data.astype(np.int64) + 1)
    order = order[eligible[order]]
    # Strings of equal length that follow each other are equal if all their words are.
    words = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    pairs = np.arange(len(order) - 1)
    for at in [*range(0, length - 7, 8), max(0, length - 8)]:
        a, b = order[pairs] + at, order[pairs + 1] + at
        width = min(8, length)
        pairs = pairs[(words[a, :width] == words[b, :width]).all(axis=1)]
    found = np.zeros(len(data), bool)
    found[order[pairs]] = True
    found[order[pairs + 1]] = True
    return [np.flatnonzero(found[b : b + n]) for b, n in zip(begin, sizes)]


def spans_of(places: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive places."""
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.append(0, cuts + 1)].tolist(), (places[np.append(cuts, len(places) - 1)] + 1).tolist()))


def _sorter(length: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("anchor", kind="stable")
        sizes = rows["data"].map(len).to_numpy()
        groups = np.flatnonzero(np.append(True, np.diff(rows["anchor"].to_numpy()) != 0))
        ends, out, at = np.append(groups[1:], len(rows)), [], 0
        totals = np.add.reduceat(sizes, groups)
        while at < len(groups):
            last = at + max(1, int(np.searchsorted(np.cumsum(totals[at:]), SORTED, side="right")))
            some = rows.iloc[groups[at] : ends[last - 1]]
            starts = repeated_starts(
                some["data"].tolist(), some["low"].to_numpy(), some["high"].to_numpy(), length
            )
            out += [(c, a, e) for c, places in zip(some["context"], starts) for a, e in spans_of(places)]
            at = last
        return pd.DataFrame(out, columns=["context", "low", "high"])

    return run


def sorted_repeats(rows: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    """``context``, ``low``, ``high``: runs of starts in the contexts whose strings repeat."""
    spark = rows.sparkSession
    schema = "context binary, low bigint, high bigint"
    found = []
    width = 1 << (length - gram).bit_length()
    rows = rows.withColumn("part", F.lit(0).cast("bigint"))
    while True:
        counts = settle(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchors")
        if width == 1:
            # What is filed together now is one and the same string.
            found.append(rows.join(counts.drop("n"), "anchor").select("context", "low", "high"))
            break
        small = rows.join(counts.filter(F.col("n") <= group).drop("n"), "anchor")
        n = counts.filter(F.col("n") <= group).agg(F.sum("n")).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (4 * group)))
        small = small.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
        found.append(small.groupBy("bucket").applyInPandas(_sorter(length), schema))
        large = counts.filter(F.col("n") > group).drop("n")
        if large.isEmpty():
            break
        rows = settle(split_anchor(rows.join(large, "anchor"), width, length), "split")
        width //= 2
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def removals(work: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """``of``, ``n_removed``, ``n_spans``, ``kept`` of each text with repeated ``starts`` (of, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            out = []
            for of, text, spans in zip(*(piece.column(c).to_pylist() for c in ("of", TEXT, "spans"))):
                parts, at, removed, n = [], 0, 0, 0
                for low, high in sorted((s["low"], s["high"] + length - 1) for s in spans):
                    if low > at or not n:
                        parts.append(text[at:low])
                        n += 1
                        removed += high - low
                        at = high
                    elif high > at:
                        removed += high - at
                        at = high
                out.append((of, removed, n, b"".join([*parts, text[at:]])))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["of", "n_removed", "n_spans", "kept"])

    lists = starts.groupBy("of").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    schema = "of binary, n_removed bigint, n_spans bigint, kept binary"
    return work.select("of", TEXT).join(lists, "of").select("of", TEXT, "spans").mapInArrow(run, schema)


def remove_repeats(
    df: DataFrame,
    keep: list[str],
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    group: int = GROUP,
    digests: bool = False,
) -> DataFrame:
    """Each row with ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes kept.

    ``kept`` is what is left of the text, or with ``digests`` its SHA-256 as
    ``kept_sha256``.
    """
    if not 0 < gram < length:
        raise ValueError("an anchor must be shorter than the strings")
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    runs = settle(anchored_runs(df, text, length, gram), "runs")
    often = settle(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "often")
    wanted = (
        runs.join(often, "anchor")
        .groupBy("of")
        .agg(F.collect_set(F.struct("anchor", "first", "end", "place")).alias("runs"))
    )
    # Copies of a text meet before the shuffle, so no key holds more than one from each task.
    distinct = (
        df.select(_key_of(data).alias("of"), F.col(text).cast("binary").alias(TEXT))
        .filter(F.octet_length(TEXT) >= length)
        .groupBy("of")
        .agg(F.first(TEXT).alias(TEXT), F.count(F.lit(1)).alias("copies"))
    )
    work = settle(distinct.join(wanted, "of"), "work")
    own = settle(contexts(work, length), "contexts")
    known = settle(
        own.groupBy("anchor", "context").agg(
            F.sum("copies").alias("n"),
            F.min(F.struct("of", "first", "end", "place")).alias("at"),
            F.max(F.col("end") - F.col("first")).alias("size"),
        ),
        "known",
    )
    unlike = settle(
        known.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "unlike"
    )
    chosen = known.join(unlike, "anchor").select("anchor", "context", "at.*")
    some = settle(context_texts(work, chosen, length), "texts")
    apart = known.filter("n < 2").select("context")
    by_sort = sorted_repeats(some, length, gram, group).join(apart, "context", "left_semi")
    whole = known.filter("n > 1").select("context", F.lit(0).cast("bigint").alias("low"), F.col("size").alias("high"))
    repeats = settle(whole.union(by_sort), "repeats")
    starts = own.join(repeats, "context").select(
        "of", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high")
    )
    found = removals(work, starts, length)
    rest = F.sha2(data, 256) if digests else data
    name = "kept_sha256" if digests else "kept"
    found = found.select(
        "of", "n_removed", "n_spans", (F.sha2("kept", 256) if digests else F.col("kept")).alias("_left")
    )
    rows = df.select(
        *keep, _key_of(data).alias("of"), F.octet_length(data).cast("bigint").alias("n_bytes"), rest.alias("_all")
    )
    return rows.join(found, "of", "left").select(
        *keep,
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"),
        F.coalesce("_left", "_all").alias(name),
    )
