"""Phrases whose words keep company: n-grams counted exactly after mergeable Misra-Gries summaries.

Texts are read three times, a bounded chunk of words at a time.

1. Each chunk's words and pairs of words go out as summaries, one for each hash
   partition: a list of keys with their counts.  A partition merges its
   summaries with room for more counters than its mass divided by the threshold,
   so that what it takes away from any count stays below the threshold and every
   frequent n-gram survives.  Keys have 32 bits within a partition; n-grams that
   share one only add up, which loses none.  The survivors set bits of a filter
   of a fixed size.
2. The same for longer n-grams, of which only those go out whose pairs all survived.
3. What both filters let through is counted by its words.  Only that decides.

The number of partitions follows the size of the texts.  A hot n-gram is one
entry of each chunk's summary.  A text of any length is cut into chunks that
repeat the last words, so nothing is lost at a cut.

The candidates are phrases counted often enough.  Each cut of a phrase compares
its count with those of both parts; the lowest score counts.  A candidate goes if
a longer one that holds it is as frequent.

A null text is empty, a null language ``und``.  Repeated rows count each; the id
is not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from songsift.llm.batches import TEXT, pieces, slices
from songsift.llm.word_bpe import _pack, _unpack
from songsift.operators.joins import lookup
from songsift.session import settle

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
#: Separators become one of them, tabs blanks.
_PLAIN = bytes(46 if c in SEPARATORS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of a chunk, and bytes of text for which there is a hash partition.
CHUNK, PART = 2_000_000, 32 << 20
#: Different phrases that a task adds up before it gives them out.
HELD = 300_000
#: Counters of a summary, as a multiple of its mass divided by the threshold.
ROOM = 4
#: Bits of a filter, whatever the input.
BITS = 1 << 26


@dataclass(frozen=True)
class Rules:
    """``threshold`` occurrences, ``longest`` words, and the share of a longer phrase's count that drops one."""

    threshold: int = 100
    longest: int = 5
    percent: int = 100
    top: int = 2000


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Numbered words in a row; number 0 ends a piece.  The first ``carried`` were in the chunk before."""

    words: list[bytes]
    ids: np.ndarray
    lang: np.ndarray
    langs: list[str]
    carried: int

    @cached_property
    def room(self) -> np.ndarray:
        """How many words from each place on belong to the same piece."""
        at = np.arange(len(self.ids))
        ends = np.where(self.ids == 0, at, len(at))
        return np.minimum.accumulate(ends[::-1])[::-1] - at

    def counted(self, length: int) -> np.ndarray:
        """The places at which an n-gram of ``length`` starts that this chunk counts."""
        whole = self.room >= length
        whole[: max(0, self.carried - length + 1)] = False
        return whole

    def keys(self, longest: int, parts: int) -> Iterator[np.ndarray]:
        """For each length the partition and key of the n-gram at each place."""
        words = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)[self.ids]
        seed = np.array([xxhash.xxh64_intdigest(n.encode(), 1) for n in self.langs], np.uint64)[self.lang]
        own = mix(words ^ seed)
        for length in range(1, longest + 1):
            if length > 1:
                own = mix(own[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[length - 1 :])
            low = own & np.uint64(0xFFFFFFFF)
            yield ((own >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | low


def chunks(batches: Iterator[pa.RecordBatch], longest: int, size: int = CHUNK) -> Iterator[Chunk]:
    """The words of all texts, ``size`` at a time."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    langs: dict[str, int] = {}
    ids: list[np.ndarray] = []
    lang: list[np.ndarray] = []
    carried = n = 0

    def add(some: list[bytes], of: int) -> None:
        nonlocal n
        ids.append(np.fromiter(map(number.__getitem__, some), np.int32, len(some)))
        lang.append(np.full(len(some), of, np.int32))
        n += len(some)

    def close() -> Chunk:
        return Chunk(list(number), np.concatenate(ids), np.concatenate(lang), list(langs), carried)

    def clear() -> None:
        nonlocal carried, n
        number.clear()
        number[b"."]
        langs.clear()
        ids.clear()
        lang.clear()
        carried = n = 0

    clear()
    for piece in pieces(batches):
        for name, text in zip(piece.column("lang").to_pylist(), piece.column(TEXT).to_pylist()):
            plain, words = (text or b"").translate(_PLAIN).replace(b".", b" . "), [b"."]
            add([b"."], langs.setdefault(name, len(langs)))
            for part in slices(plain):
                new = part.split()
                words = words[-longest + 1 :] + new
                add(new, langs[name])
                if n >= size:
                    yield close()
                    clear()
                    last = words[-longest + 1 :]
                    add(last, langs.setdefault(name, len(langs)))
                    carried = len(last)
    if n > carried:
        yield close()


class Filter:
    """Bits set at two places for each key; one that is not set was not given."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = mix(keys)
        return (mixed & np.uint64(BITS - 1)).astype(np.int64), (mixed >> np.uint64(32) & np.uint64(BITS - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        first, second = (self.bits[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1) for p in self.places(keys))
        return (first & second).astype(bool)


def _open(path_bytes) -> Filter:
    return Filter(np.frombuffer(path_bytes.value, "<u8"))


def chunk_keys(chunk: Chunk, lengths: range, pairs: Filter | None, parts: int) -> np.ndarray:
    """The keys of all n-grams of ``lengths``, of which all pairs pass ``pairs``."""
    out = []
    for length, keys in enumerate(chunk.keys(lengths[-1], parts), 1):
        if pairs is not None and length == 2:
            every = pairs.has(keys)
            passed = every
        elif pairs is not None and length > 2:
            passed = passed[:-1] & every[length - 2 :]
        if length in lengths:
            some = chunk.counted(length)[: len(keys)]
            out.append(keys[some & passed] if pairs is not None else keys[some])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _summarise(rules: Rules, lengths: range, pairs, parts: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = None if pairs is None else _open(pairs)
        for chunk in chunks(batches, rules.longest, size):
            keys, counts = np.unique(chunk_keys(chunk, lengths, passed, parts), return_counts=True)
            part = (keys >> np.uint64(32)).astype(np.int64)
            low = keys.astype("<u4")
            cut = np.flatnonzero(np.diff(part)) + 1
            rows = [
                (int(part[a]), int(counts[a:b].sum()), low[a:b].tobytes(), _pack(counts[a:b]))
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(part)])
                if b > a
            ]
            for few in (rows[i : i + 64] for i in range(0, len(rows), 64)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*few), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                    ["part", "mass", "keys", "counts"],
                )

    return run


class Summary:
    """Misra-Gries counters: each count falls short of the true one by ``short`` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.short = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > self.capacity:
            self.merge()

    def merge(self) -> None:
        """All counters together; if there are too many, the next largest is taken from each."""
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts
        if len(self.keys) > self.capacity:
            less = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            self.short += less
            left = self.counts > less
            self.keys, self.counts = self.keys[left], self.counts[left] - less

    def frequent(self, threshold: int) -> np.ndarray:
        """All keys that can have ``threshold`` occurrences."""
        self.merge()
        return self.keys[self.counts + self.short >= threshold]


def _merge(threshold: int):
    """The bits of the survivors of a partition, which has ``total`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, part = None, 0
        for batch in batches:
            for row in batch.select(["part", "total", "keys", "counts"]).to_pylist():
                part = row["part"]
                summary = summary or Summary(ROOM * (row["total"] // threshold) + 1)
                summary.add(np.frombuffer(row["keys"], "<u4"), _unpack(row["counts"]))
        keys = summary.frequent(threshold).astype(np.uint64) | np.uint64(part << 32)
        place = np.unique(np.concatenate(Filter.places(keys)))
        word, bit = place >> 6, np.uint64(1) << (place & 63).astype(np.uint64)
        first = np.flatnonzero(np.append(True, np.diff(word) != 0)) if len(word) else np.zeros(0, np.int64)
        bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        yield pa.RecordBatch.from_arrays(
            [pa.array(word[first]), pa.array(bits.view(np.int64))], ["word", "bits"]
        )

    return run


def frequent_filter(texts: DataFrame, rules: Rules, lengths: range, pairs, parts: int, size: int = CHUNK):
    """A filter, sent to all executors, that lets every frequent n-gram of ``lengths`` through."""
    made = texts.mapInArrow(
        _summarise(rules, lengths, pairs, parts, size), "part bigint, mass bigint, keys binary, counts binary"
    )
    total = F.sum("mass").over(Window.partitionBy("part")).alias("total")
    rows = made.repartition(2 * parts, "part").select("part", total, "keys", "counts")
    merged = rows.groupBy("part").applyInArrow(_merge(rules.threshold), "word bigint, bits bigint")
    words = merged.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, "<u8")
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return texts.sparkSession.sparkContext.broadcast(bits.tobytes())


def _count(rules: Rules, short, long, parts: int, size: int):
    """Counts by the words themselves of all n-grams that pass, and of all words under an empty phrase.

    They go out as lists, one for each hash partition and language.
    """

    def rows(chunk: Chunk, pairs: Filter, more: Filter) -> Iterator[tuple[str, str, int]]:
        words = [w.decode("utf-8", "replace") for w in chunk.words]
        before = chunk.counted(1)
        of = np.bincount(chunk.lang[before], minlength=len(chunk.langs))
        yield from ((chunk.langs[i], "", int(n)) for i, n in enumerate(of) if n)
        #: Numbers of n-grams that are the same words in the same language.
        name = chunk.lang.astype(np.int64)
        alive = np.ones(len(chunk.ids), bool)
        for length, keys in enumerate(chunk.keys(rules.longest, parts), 1):
            passed = (pairs if length < 3 else more).has(keys) & (chunk.room[: len(keys)] >= length)
            # Each part of a frequent phrase is frequent.
            alive = passed & alive[: len(keys)] & (alive[1 : len(keys) + 1] if length > 1 else True)
            at = np.flatnonzero(alive)
            if not len(at):
                return
            _, first, number = np.unique(
                name[at] * len(words) + chunk.ids[at + length - 1], return_index=True, return_inverse=True
            )
            name = np.zeros(len(keys), np.int64)
            name[at] = number
            new = at + length - 1 >= chunk.carried
            counts = np.bincount(number[new], minlength=len(first))
            for start, n in zip(at[first].tolist(), counts.tolist()):
                if n:
                    phrase = " ".join([words[w] for w in chunk.ids[start : start + length].tolist()])
                    yield chunk.langs[chunk.lang[start]], phrase, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, more = _open(short), _open(long)
        held: defaultdict[str, defaultdict[str, int]] = defaultdict(lambda: defaultdict(int))

        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                lists: defaultdict[int, list[str]] = defaultdict(list)
                for phrase in own:
                    lists[xxhash.xxh32_intdigest(phrase) % parts].append(phrase)
                for part, phrases in lists.items():
                    counts = [own[p] for p in phrases]
                    columns = [[part], [lang], [phrases], [counts]]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["part", "lang", "phrases", "counts"])
            held.clear()

        for chunk in chunks(batches, rules.longest, size):
            for lang, phrase, n in rows(chunk, pairs, more):
                held[lang][phrase] += n
            if sum(map(len, held.values())) >= HELD:
                yield from out()
        yield from out()

    return run


def _frequent(threshold: int):
    """Adds up the lists of a partition and leaves the frequent phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: defaultdict[str, defaultdict[str, int]] = defaultdict(lambda: defaultdict(int))
        for batch in batches:
            for i in range(batch.num_rows):
                own = totals[batch.column("lang")[i].as_py()]
                for phrase, n in zip(*(batch.column(c)[i].as_py() for c in ("phrases", "counts"))):
                    own[phrase] += n
        for lang, own in totals.items():
            kept = [(lang, p, n) for p, n in own.items() if n >= threshold or not p]
            if kept:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, map(list, zip(*kept)))), ["lang", "phrase", "n"])

    return run


def frequent_phrases(
    df: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", size: int = CHUNK, part: int = PART
) -> DataFrame:
    """``lang``, ``phrase`` and its occurrences ``n`` for all phrases of one word and more that are
    frequent, and under an empty phrase the number of all words of each language."""
    texts = df.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias(TEXT))
    total = texts.agg(F.sum(F.octet_length(TEXT)).alias("n")).first()["n"] or 0
    parts = -(-total // part) or 1
    short = frequent_filter(texts, rules, range(1, 3), None, parts, size)
    long = frequent_filter(texts, rules, range(3, rules.longest + 1), short, parts, size) if rules.longest > 2 else short
    counts = texts.mapInArrow(
        _count(rules, short, long, parts, size), "part bigint, lang string, phrases array<string>, counts array<bigint>"
    )
    by_part = counts.repartition(2 * parts, "part").groupBy("part")
    return by_part.applyInArrow(_frequent(rules.threshold), "lang string, phrase string, n bigint")


def score_cuts(counts: DataFrame) -> DataFrame:
    """For each phrase the lowest score of its cuts, with the counts ``a``, ``l``, ``r`` and ``n``."""
    words = F.split("phrase", " ")
    cuts = (
        counts.filter("phrase like '% %'")
        .select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))
        .withColumn("cut", F.explode(F.expr("sequence(1, size(words) - 1)")))
        .select(
            *("lang", "phrase", "a", "cut"),
            F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("left"),
            F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("right"),
        )
    )
    for side, name in (("left", "l"), ("right", "r")):
        part = counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
        cuts = lookup(cuts, part, ["lang", side], "inner")
    cuts = lookup(cuts, counts.filter("phrase = ''").select("lang", "n"), "lang", "inner")
    # Products of three counts may pass 64 bits.
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r", "n")}
    cuts = cuts.withColumns({f"_{c}": x for c, x in wide.items()})
    score = F.expr("(1000 * _a * _n) div (_l * _r)").cast("bigint")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")


def inside_longer(counts: DataFrame, percent: int) -> DataFrame:
    """``lang`` and ``phrase`` of all phrases of two words and more that a longer one makes superfluous."""
    spans = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), k -> "
        "transform(sequence(0, size(words) - k), i -> array_join(slice(words, i + 1, k), ' '))))"
    )
    longer = counts.select("lang", "n", F.split("phrase", " ").alias("words")).filter("size(words) > 2")
    held = longer.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "n")
    held = held.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return held.join(counts, ["lang", "phrase"]).filter(100 * F.col("longer") >= percent * F.col("n")).select("lang", "phrase")


def collocations(
    df: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", size: int = CHUNK, part: int = PART
) -> DataFrame:
    """Each language's first phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``."""
    counts = settle(frequent_phrases(df, rules, text, lang, size, part), "phrases")
    kept = score_cuts(counts).join(inside_longer(counts, rules.percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rules.top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
