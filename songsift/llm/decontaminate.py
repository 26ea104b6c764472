"""Benchmark decontamination: BM25 over test items, searched by every training passage.

The index holds the test items: for each term a list of (item, impact) by item,
cut into blocks of neighbouring items with the largest impact of each block.
An impact is the BM25 weight of a term in an item, divided by the weight of all
its terms, so a score is the share of an item that a passage covers, from 0 to 1.

Each text is cut into overlapping passages, each twice as long as the longest
item, so that any copy of an item lies whole in one of them.  Two steps find all
items at or above the threshold: the block maxima of a passage's different terms
are added up for all passages of a batch at once, which leaves the blocks that
can still hold a result; block-max WAND then moves through the lists of each
passage that has such a block.

A retrieved item counts if the passage also holds enough of the word sequences
of its question and of its answer.  The last sentence is the answer, of an item
of one sentence the last third of its words.

Document frequencies, the mean length and the length of a passage are those of
all items, taken by Spark first.  The items are then indexed in shards of about
``shard`` items, each held by every task; the training texts are read once
for each shard.  The shards change no result.

Words are runs of Unicode letters and digits, so any punctuation or blank
separates them.  Scripts that write no blanks between words, such as Chinese or
Thai, give pairs of neighbouring characters instead.

A null or empty text or item has no terms and matches nothing.  Repeated rows
match alike; ties keep the earliest passage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songsift.llm.batches import per_text
from songsift.session import settle

K1, B = 1.2, 0.75
_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORDS = re.compile(r"[^\W_]+")
# The blocks of scripts without blanks between words.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_RUNS = re.compile(f"([{_UNSPACED}]+)|[^{_UNSPACED}]+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
_LEAKS = "array<struct<item_id: bigint, score: double, question: double, answer: double, first_word: bigint>>"


@dataclass(frozen=True)
class Thresholds:
    """Shares of an item's weight, and of its question's and answer's word sequences."""

    score: float = 0.6
    question: float = 0.5
    answer: float = 0.5
    words: int = 3


def terms_of(text: bytes) -> list[bytes]:
    if text.isascii():
        return text.lower().translate(_WORD).split()
    plain = text.decode("utf-8", "replace").lower()
    words = _WORDS.findall(plain)
    if _HAS_UNSPACED.search(plain):
        words = [part for word in words for part in _parts(word)]
    return "\n".join(words).encode().split(b"\n") if words else []


def _parts(word: str) -> Iterator[str]:
    """A word as it is, but runs without blanks as pairs of neighbouring characters."""
    for run in _RUNS.finditer(word):
        part = run[0]
        if run[1] and len(part) > 1:
            yield from (part[i : i + 2] for i in range(len(part) - 1))
        else:
            yield part


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    sentences = [terms_of(s.encode()) for s in _SENTENCE_END.split(text)]
    sentences = [s for s in sentences if s]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def sequences(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass(frozen=True)
class Statistics:
    """Of all items with a term: their number, mean and largest length, and the items that hold each term."""

    items: int
    mean: float
    longest: int
    often: dict[bytes, int]


def statistics_of(words: list[list[bytes]]) -> Statistics:
    often = Counter(w for own in words for w in set(own))
    return Statistics(
        len(words), sum(map(len, words)) / max(1, len(words)), max(map(len, words), default=0), often
    )


class Index:
    """Impact lists of a shard of items, with block maxima."""

    def __init__(self, items: list[tuple[int, str]], blocks: int = 32, every: Statistics | None = None):
        """``every`` tells of all items; without it these are all."""
        cut = [(item, *question_and_answer(text or "")) for item, text in items]
        cut = [x for x in cut if x[1] or x[2]]
        self.items = [x[0] for x in cut]
        self.parts = [(q, a) for _, q, a in cut]
        words = [q + a for q, a in self.parts]
        every = every or statistics_of(words)
        self.longest, mean = every.longest, every.mean
        lists: dict[bytes, list[tuple[int, float]]] = {}
        for i, own in enumerate(words):
            norm = K1 * (1 - B + B * len(own) / mean)
            for word in set(own):
                n = own.count(word)
                lists.setdefault(word, []).append((i, n * (K1 + 1) / (n + norm)))
        self.number = {word: t for t, word in enumerate(lists)}
        self.item_of = [[i for i, _ in found] for found in lists.values()]
        total = np.zeros(max(1, len(words)))
        raw = []
        for word, found in lists.items():
            idf = np.log(1 + (every.items - every.often[word] + 0.5) / (every.often[word] + 0.5))
            raw.append([(i, idf * w) for i, w in found])
            for i, w in raw[-1]:
                total[i] += w
        self.impact = [[w / total[i] for i, w in found] for found in raw]
        self.block_size = max(1, -(-len(words) // blocks))
        self.block_max = np.zeros((len(lists) + 1, -(-len(words) // self.block_size) or 1), np.float32)
        for t, (at, impact) in enumerate(zip(self.item_of, self.impact)):
            np.maximum.at(self.block_max[t], np.array(at) // self.block_size, np.array(impact, np.float32))

    def search(self, terms: list[int], threshold: float, alive: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: all items that score at least ``threshold`` for these different terms.

        ``alive`` marks the blocks whose maxima can reach the threshold.
        """
        size, found = self.block_size, []
        lists = [(self.item_of[t], self.impact[t], float(self.block_max[t].max())) for t in terms]
        at = [0] * len(lists)
        end = len(self.items)
        while True:
            order = sorted(
                (i for i in range(len(lists)) if at[i] < len(lists[i][0])), key=lambda i: lists[i][0][at[i]]
            )
            bound, pivot = 0.0, None
            for i in order:
                bound += lists[i][2]
                if bound >= threshold:
                    pivot = lists[i][0][at[i]]
                    break
            if pivot is None:
                return found
            block = pivot // size
            if not alive[block]:
                ahead = np.flatnonzero(alive[block:])
                if not len(ahead):
                    return found
                target = min(end, int(block + ahead[0]) * size)
            elif lists[order[0]][0][at[order[0]]] < pivot:
                target = pivot
            else:
                score = 0.0
                for i in order:
                    items, impacts, _ = lists[i]
                    if items[at[i]] != pivot:
                        break
                    score += impacts[at[i]]
                if score >= threshold:
                    found.append((pivot, score))
                target = pivot + 1
            for i in order:
                if lists[i][0][at[i]] >= target:
                    break
                at[i] = bisect_left(lists[i][0], target, at[i])


def live_blocks(
    index: Index, term: np.ndarray, cell: np.ndarray, first_own: np.ndarray, first_both: np.ndarray, cells: int
) -> np.ndarray:
    """Sums of block maxima over the different terms of each passage, which is a cell and the next.

    ``first_own`` marks the first place of a term in its cell, ``first_both`` the
    first in its cell and the one before.
    """
    own, next_ = (np.zeros((cells + 1, index.block_max.shape[1]), np.float32) for _ in range(2))
    for out, some in ((own, first_own), (next_, first_both)):
        which = cell[some]
        if len(which):
            starts = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            out[which[starts]] = np.add.reduceat(index.block_max[term[some]], starts, axis=0)
    return own[:-1] + next_[1:]


def _finder(index: Index, limits: Thresholds) -> Callable[[], Callable[[list[bytes]], list]]:
    stride = max(1, index.longest)
    #: Sums in single precision may fall a little short of the exact ones.
    slack = 1e-3

    def overlap(part: list[bytes], seen: set[tuple[bytes, ...]]) -> float:
        own = sequences(part, limits.words)
        if not own:
            return 1.0
        return len(own & seen) / len(own)

    def leaks(texts: list[bytes]) -> list:
        words = [terms_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        get = index.number.get
        term = np.fromiter((get(w, -1) for own in words for w in own), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        start = np.cumsum(sizes) - sizes
        # One empty cell behind each text keeps its last passage to itself.
        cells_of = -(-sizes // stride) + 1
        first_cell = np.cumsum(cells_of) - cells_of
        place = np.arange(len(term)) - np.repeat(start, sizes)
        known = np.flatnonzero(term >= 0)
        term, owner, place = term[known], owner[known], place[known]
        cell = first_cell[owner] + place // stride
        # The cell in which the same term of the same text was last seen.
        order = np.argsort((owner * len(index.number) + term) * (int(cells_of.sum()) + 1) + cell, kind="stable")
        before = np.full(len(term), -2, np.int64)
        same = (np.diff(term[order]) == 0) & (np.diff(owner[order]) == 0)
        before[order[1:][same]] = cell[order[:-1][same]]
        cells = int(cells_of.sum())
        bounds = live_blocks(index, term, cell, before < cell, before < cell - 1, cells)
        alive = bounds >= limits.score - slack
        alive[first_cell + cells_of - 1] = False
        out: list[dict[int, tuple]] = [{} for _ in texts]
        cell_owner = np.repeat(np.arange(len(texts)), cells_of)
        for c in np.flatnonzero(alive.any(axis=1)).tolist():
            text = int(cell_owner[c])
            a, b = np.searchsorted(cell, [c, c + 2])
            found = index.search(np.unique(term[a:b]).tolist(), limits.score, alive[c])
            if not found:
                continue
            at = (c - int(first_cell[text])) * stride
            own = words[text][at : at + 2 * stride]
            seen: dict[int, set] = {}
            for item, score in found:
                parts = []
                for part in index.parts[item]:
                    n = min(limits.words, len(part))
                    if n not in seen:
                        seen[n] = sequences(own, n) if len(own) >= n else set()
                    parts.append(overlap(part, seen[n]))
                best = out[text].get(item)
                if parts[0] >= limits.question and parts[1] >= limits.answer and (best is None or score > best[0]):
                    out[text][item] = (score, *parts, at)
        rows = [
            [
                {"item_id": index.items[i], "score": s, "question": q, "answer": a, "first_word": at}
                for i, (s, q, a, at) in sorted(found.items())
            ]
            for found in out
        ]
        kind = pa.list_(
            pa.struct(
                [("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64())]
                + [("answer", pa.float64()), ("first_word", pa.int64())]
            )
        )
        return [pa.array(rows, kind)]

    return lambda: leaks


def _item_terms() -> Callable[[list[bytes]], list]:
    def work(texts: list[bytes]) -> list:
        cut = [question_and_answer(t.decode("utf-8", "replace")) for t in texts]
        words = [q + a for q, a in cut]
        return [pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))]

    return work


def item_shards(items: DataFrame, item_id: str, text: str, shard: int) -> Iterator[Index]:
    """An index for each shard of items, whose items and terms are on the driver one shard at a time."""
    slim = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    rows = per_text(slim, _item_terms, "n bigint, terms array<binary>", ["id", "text"])
    rows = settle(rows.filter("n > 0"), "items")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    shards = -(-total["n"] // shard) or 1
    part = rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    often = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("often"))
    often = settle(often, "often") if shards > 1 else often
    for k in range(shards):
        own = part.filter(F.col("part") == k)
        terms = often.join(own.select(F.explode("terms").alias("term")).distinct(), "term") if shards > 1 else often
        known = {bytes(r["term"]): r["often"] for r in terms.collect()}
        every = Statistics(total["n"], total["mean"] or 0.0, total["longest"] or 0, known)
        yield Index([(r["id"], r["text"]) for r in own.orderBy("id", "text").collect()], every=every)


def find_leaks(
    df: DataFrame,
    items: DataFrame,
    keep: list[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    limits: Thresholds = Thresholds(),
    shard: int = 20_000,
) -> DataFrame:
    """Each row with ``leaks``, the items that its text holds, best passage of each."""
    carried = [*keep, *({text} - set(keep))]
    found = df.select(*carried).withColumn("leaks", F.array().cast(_LEAKS))
    for index in item_shards(items, item_id, item_text, shard):
        more = per_text(found, _finder(index, limits), f"_more {_LEAKS}", [*carried, "leaks"], text, 2 << 20)
        found = more.select(*carried, F.concat("leaks", "_more").alias("leaks"))
    return found.select(*keep, "leaks")


def leak_rows(found: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each leak."""
    return found.select(*keep, F.inline("leaks"))
