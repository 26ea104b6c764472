"""Ranked lexical search over impact vectors in buckets of similar length, after LEMP.

A text is a vector with one weight for each term of the items, ``w`` times the
term's impact, and an item is a vector of ones.  The vectors are range
partitioned by falling length, and every batch of a partition is a bucket.  An
item meets a bucket in three steps:

1. Cauchy-Schwarz: the item's length times the greatest of the bucket is an
   upper bound.  Below the item's threshold, its k-th best score so far, the
   bucket is passed over.
2. Coordinates: the item's terms are added up from the largest list maximum
   down, until no text without any of them can reach the threshold.  A text
   stays if its sum and a bound for the other coordinates reach it, the smaller
   one of their list maxima and of Cauchy-Schwarz on what is left of its vector.
3. The survivors are scored exactly in integers.

The partition of the longest vectors goes first and gives the others their first
thresholds.  Bounds allow for rounding and keep ties, so nothing is lost whatever
the thresholds are.

Counts and document frequencies are those of all texts.  A null or empty text has
no terms and is never found; an item without terms finds nothing.  Repeated texts
are found each, repeated items answered each.  A null id comes after all others
of equal score.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from songsift.llm.batches import per_text, slices
from songsift.session import settle

_TERM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Items that are searched at once; their terms are all that tasks and driver hold.
ITEMS = 20_000
_FOUND = "item bigint, item_id bigint, doc_id bigint, score bigint"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms, a part of the text at a time."""
    return (part.split() for part in slices(text.translate(_TERM)))


class Items:
    """Some items and their distinct terms, numbered."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [item for item, _ in rows]
        self.number: dict[bytes, int] = {}
        self.terms = []
        for _, text in rows:
            own = {t for part in terms_of((text or "").encode()) for t in part}
            self.terms.append(np.array(sorted(self.number.setdefault(t, len(self.number)) for t in own), np.int64))


def _counter(number: dict[bytes, int]):
    def count(texts: list[bytes]) -> list:
        sizes, terms, often = [], [], []
        for text in texts:
            counts, n = Counter(), 0
            for part in terms_of(text):
                counts.update(part)
                n += len(part)
            known = sorted((number[t], c) for t, c in counts.items() if t in number)
            sizes.append(n)
            terms.append([t for t, _ in known])
            often.append([c for _, c in known])
        return [pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))]

    return lambda: count


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and how many each row has."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]], np.diff(at)


def _weigh(w: np.ndarray, texts: int, terms: int):
    """``weights``, ``w`` times the impact of each term, and their ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, counts = _lists(batch.column("terms"))
            tf, _ = _lists(batch.column("often"))
            # Products of the counts of a whole corpus need Python's integers.
            m = np.array([10 + 90 * n * texts // terms for n in batch.column("n").to_pylist()], np.int64)
            weights = w[term] * (10**9 * tf // (1000 * tf + 8 * np.repeat(m, counts)))
            owner = np.repeat(np.arange(batch.num_rows), counts)
            length = np.sqrt(np.bincount(owner, weights.astype(float) ** 2, batch.num_rows))
            lists = pa.ListArray.from_arrays(batch.column("terms").offsets, pa.array(weights)) if len(weights) else None
            if lists is not None:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(length), batch.column("terms"), lists],
                    ["doc_id", "length", "terms", "weights"],
                )

    return run


class Bucket:
    """Some vectors, by text and by term."""

    def __init__(self, batch: pa.RecordBatch, terms: int):
        self.term, self.counts = _lists(batch.column("terms"))
        self.weight, _ = _lists(batch.column("weights"))
        self.start = np.cumsum(self.counts) - self.counts
        self.length = batch.column("length").to_numpy()
        self.ids = np.array(batch.column("doc_id").fill_null(0))
        self.no_id = np.array(batch.column("doc_id").is_null())
        order = np.argsort(self.term, kind="stable")
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)[order]
        self.by_term = self.weight[order].astype(float)
        self.at = np.searchsorted(self.term[order], np.arange(terms + 1))
        self.most = np.zeros(terms)
        full = np.flatnonzero(np.diff(self.at))
        if len(full):
            self.most[full] = np.maximum.reduceat(self.by_term, self.at[full])

    def survivors(self, terms: np.ndarray, threshold: int) -> np.ndarray:
        """The vectors whose bounds reach ``threshold``."""
        reach, longest = threshold * (1 - 1e-9), self.length.max(initial=0)
        if longest * math.sqrt(len(terms)) < reach:
            return np.zeros(0, np.int64)
        terms = terms[self.most[terms] > 0]
        terms = terms[np.argsort(-self.most[terms], kind="stable")]
        rest = np.append(np.cumsum(self.most[terms][::-1])[::-1], 0)
        if not len(terms) or rest[0] < reach:
            return np.zeros(0, np.int64)
        seen, square = np.zeros(len(self.length)), np.zeros(len(self.length))
        done = len(terms)
        for i, term in enumerate(terms):
            if min(longest * math.sqrt(len(terms) - i), rest[i]) < reach:
                done = i
                break
            some = slice(self.at[term], self.at[term + 1])
            seen[self.owner[some]] += self.by_term[some]
            square[self.owner[some]] += self.by_term[some] ** 2
        left = np.sqrt(np.maximum(self.length**2 - square, 0) * (len(terms) - done))
        bound = seen + np.minimum(left, rest[done])
        return np.flatnonzero((bound * (1 + 1e-9) >= max(reach, 1)))

    def scores(self, some: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The exact sums over the ``wanted`` terms."""
        counts = self.counts[some]
        owner = np.repeat(np.arange(len(some)), counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + self.start[some][owner]
        add = np.where(wanted[self.term[place]], self.weight[place], 0)
        out = np.zeros(len(some), np.int64)
        np.add.at(out, owner, add)
        return out


def _search(items: Items, thresholds: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = thresholds.copy()
        found: dict[int, tuple[np.ndarray, ...]] = {}
        wanted = np.zeros(len(items.number), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = Bucket(batch, len(items.number))
            for item, terms in enumerate(items.terms):
                some = bucket.survivors(terms, int(best[item]))
                if not len(some):
                    continue
                wanted[terms] = True
                score = bucket.scores(some, wanted)
                wanted[terms] = False
                good = score >= max(1, best[item])
                rows = (score[good], bucket.no_id[some][good], bucket.ids[some][good])
                if item in found:
                    rows = tuple(np.concatenate(x) for x in zip(found[item], rows))
                first = np.lexsort((rows[2], rows[1], -rows[0]))[:k]
                found[item] = tuple(x[first] for x in rows)
                if len(first) == k:
                    best[item] = max(best[item], found[item][0][-1])
        for item, (score, no_id, ids) in found.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([item] * len(score), pa.int64()),
                    pa.array([items.ids[item]] * len(score), pa.int64()),
                    pa.array(ids, pa.int64(), mask=no_id),
                    pa.array(score),
                ],
                ["item", "item_id", "doc_id", "score"],
            )

    return run


def term_weights(rows: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """``w`` of each term, the number of texts with a term, and of terms in all texts."""
    total = rows.filter("n > 0").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("terms")).first()
    often = np.zeros(terms, np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        often[r["term"]] = r["count"]
    n = total["texts"]
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(f) + 1))) for f in often], np.int64), n, total["terms"]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_items(docs: DataFrame, items: Items, k: int, doc_id: str, text: str) -> DataFrame:
    """``item``, ``item_id``, ``rank``, ``doc_id`` and ``score`` for some items."""
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    fields = "n bigint, terms array<int>, often array<bigint>"
    rows = settle(per_text(named, _counter(items.number), fields, ["doc_id"]), "terms")
    w, texts, terms = term_weights(rows, len(items.number))
    vectors = rows.filter("size(terms) > 0").mapInArrow(
        _weigh(w, texts, terms or 1), "doc_id bigint, length double, terms array<int>, weights array<bigint>"
    )
    # Vectors of equal length, copies for instance, are dealt by a number.
    vectors = settle(vectors.filter("length > 0").withColumn("row", F.monotonically_increasing_id()), "vectors")
    order = [F.desc("length"), F.asc("row")]
    sorted_ = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    buckets = settle(sorted_.withColumn("part", F.spark_partition_id()), "buckets")
    columns = ["doc_id", "length", "terms", "weights"]
    longest = buckets.filter("part = 0").select(*columns)
    none = np.zeros(len(items.terms), np.int64)
    first = settle(_ranked(longest.mapInArrow(_search(items, none, k), _FOUND), k).drop("rank"), "found")
    for r in first.groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).collect():
        none[r["item"]] = r["least"] if r["n"] == k else 0
    others = buckets.filter("part > 0").select(*columns).mapInArrow(_search(items, none, k), _FOUND)
    return _ranked(first.union(others), k).select("item", "item_id", "rank", "doc_id", "score")


def best_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    at_once: int = ITEMS,
) -> DataFrame:
    """The ``k`` best texts of each item: ``item_id``, ``rank``, ``doc_id`` and ``score``.

    Items are searched ``at_once``, in blocks by their hash.  Their number changes
    no score, since all counts are those of the texts.
    """
    slim = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("text"))
    blocks = -(-slim.count() // at_once) or 1
    part = slim.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = part.filter(F.col("part") == block).select("id", "text").collect()
        some = search_items(docs, Items([(r["id"], r["text"]) for r in rows]), k, doc_id, text)
        some = settle(some, "found") if blocks > 1 else some
        found = some if found is None else found.union(some)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
