"""Quality rules on repetition, from a suffix array of each text's words.

A batch of texts is sorted at once: suffixes are ranked by one word, then by
two, four, eight words and so on, and only those that are still tied are sorted
again.  A rank holds its text, so suffixes of different texts never tie.  The
longest common prefixes of neighbours follow in the order of the text.  The
intervals of that array are the maximal repeated passages; a suffix lies in the
interval of the larger of its two common prefixes, and the union of these spans
is the part of the text that is repeated.

Rules: words, repeated eight-word windows, the share of words in repeated
passages, the longest one.

A null or empty text has no words and is not kept.  Texts are judged one by
one, so equal rows give equal results.  Memory is in proportion to a text's
words, whatever repeats in it: about 50 bytes for each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from songsift.llm.batches import per_text, slices

# Fixed values of the base rules.
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
_TO_BLANK = bytes(32 if chr(c) in _BLANK else c for c in range(256))
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8)).astype(np.int64)
_IS_WORD_POINT = np.array([c & 0xC0 != 0x80 and chr(c) not in _BLANK for c in range(256)], np.int64)


@dataclass(frozen=True)
class Limits:
    """``passage``: words a repeated passage has at least; ``covered``: the share
    of words in such passages; ``longest``: words of the longest one.

    Passages are shorter than the windows of the base rule, and more of a text
    may lie in them: a text of short phrases that come again and again is
    rejected by its cover although no window of it occurs twice.
    """

    passage: int = 5
    covered: float = 0.5
    longest: int = 200


def rank_suffixes(words: np.ndarray, text: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and which suffixes in it share ``least`` words, a power of two, with the one before.

    ``words``, ``text`` and ``end`` give each position's word, text and the
    position behind its text.  Only the last ranks are kept.
    """
    n = len(words)
    order = np.argsort(text.astype(np.int64) * (int(words.max()) + 1) + words).astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = (np.diff(words[order]) != 0) | (np.diff(text[order]) != 0)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    near, length = None, 1
    while True:
        if length == least:
            near = ~new
        tied = ~new
        tied[:-1] |= ~new[1:]
        if not tied.any():
            # Without ties no suffix shares as many words with another.
            return order, np.zeros(n, bool) if near is None else near
        tied = np.flatnonzero(tied).astype(np.int32)
        which = order[tied]
        behind = which + np.int32(length)
        inside = behind < end[which]
        after = np.where(inside, rank[np.where(inside, behind, 0)] + np.int32(1), np.int32(0))
        group = rank[which]
        again = np.argsort(group.astype(np.int64) * (n + 1) + after)
        which, after, group = which[again], after[again], group[again]
        order[tied] = which
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (np.diff(group) != 0) | (np.diff(after) != 0)
        new[tied] = fresh
        rank[which] = np.maximum.accumulate(np.where(fresh, tied, np.int32(0)))
        length *= 2


def common_prefixes(
    words: np.ndarray, order: np.ndarray, near: np.ndarray, end: np.ndarray, least: int
) -> np.ndarray:
    """The words that each suffix in order shares with the one before, 0 if fewer than ``least``.

    By Kasai's method, in the order of the text: a suffix shares at most one word
    less than the suffix before it in the text.  It goes through the suffixes of
    which ``near`` tells that they share ``least`` words, so its steps are those
    that repeat.
    """
    shared = np.zeros(len(order), np.int32)
    pairs = np.flatnonzero(near)
    if not len(pairs):
        return shared
    here = order[pairs]
    by_text = np.argsort(here)
    here, pairs = here[by_text], pairs[by_text]
    before = order[pairs - 1]
    room = np.minimum(end[here] - here, end[before] - before)
    at, lengths = memoryview(words), memoryview(np.zeros(len(pairs), np.int32))
    h, last = least, -2
    for k, (x, y, most) in enumerate(zip(memoryview(here), memoryview(before), memoryview(room))):
        h = max(h - 1, least) if x == last + 1 else least
        while h < most and at[x + h] == at[y + h]:
            h += 1
        lengths[k], last = h, x
    shared[pairs] = np.asarray(lengths)
    return shared


def covered_words(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``n`` words is in one of the spans, which stay inside their texts."""
    ends = np.zeros(n, np.int32)
    ends[start] = start + length
    return np.maximum.accumulate(ends) > np.arange(n, dtype=np.int32)


def word_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, and how many each text has."""
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    out, sizes = [np.zeros(0, np.int32)], []
    for text in texts:
        n = 0
        for part in slices(text.translate(_TO_BLANK)):
            words = part.split()
            out.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
            n += len(words)
        sizes.append(n)
    return np.concatenate(out), np.array(sizes, np.int64)


def repetition(texts: list[bytes], passage: int = Limits.passage) -> tuple[np.ndarray, ...]:
    """Per text: words, words in windows found twice, words in repeated passages, the longest of these."""
    words, sizes = word_numbers(texts)
    n, zero = len(words), np.zeros(len(texts), np.int64)
    if not n:
        return zero, zero, zero, zero
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    end = np.repeat(np.cumsum(sizes).astype(np.int32), sizes)
    least = 1 << (min(passage, WINDOW).bit_length() - 1)
    order, near = rank_suffixes(words, text, end, least)
    shared = common_prefixes(words, order, near, end, least)
    longest = np.zeros(n, np.int32)
    longest[order] = np.maximum(shared, np.append(shared[1:], 0))
    repeated = np.flatnonzero(longest >= WINDOW)
    windows = covered_words(repeated, np.full(len(repeated), WINDOW), n)
    repeated = np.flatnonzero(longest >= passage)
    passages = covered_words(repeated, longest[repeated], n)
    most = zero.copy()
    np.maximum.at(most, text[repeated], longest[repeated])
    return sizes, np.bincount(text, windows, len(texts)), np.bincount(text, passages, len(texts)), most


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _rules(limits: Limits) -> Callable[[], Callable[[list[bytes]], list]]:
    def check(texts: list[bytes]) -> list:
        joined = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([0, *map(len, texts)])
        total = lambda table: np.diff(np.append(0, np.cumsum(table[joined]))[ends])
        chars, symbols = total(_IS_WORD_POINT), total(_IS_SYMBOL)
        n_words, repeat, covered, longest = (x.astype(np.int64) for x in repetition(texts, limits.passage))
        failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEATED_PERCENT * n_words)
        kept = ~failed & (covered <= limits.covered * n_words) & (longest <= limits.longest)
        lines = np.array([repeated_lines(t) for t in texts], np.int64)
        return [n_words, chars, symbols, lines, repeat, covered, longest, failed, kept]

    return lambda: check


def check_quality(df: DataFrame, keep: list[str], text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The counts of each text and whether it passes the base rules and all rules."""
    fields = (
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "n_covered_words bigint, longest_repeat bigint, base_failed boolean, kept boolean"
    )
    return per_text(df, _rules(limits), fields, keep, text, size=2 << 20)
