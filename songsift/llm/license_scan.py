"""Licences: identifier tags and notice phrases by Aho-Corasick, expressions by shunting-yard.

Notices are looked for in the words of a text: it is cut into words first, so
that line breaks, comment marks and punctuation inside a notice do not matter.
Identifier tags are looked for in the text itself, and the expression behind a
tag is read as far as it goes.

The words ``and``, ``or`` and ``with`` bind as usual: ``with`` before ``and``
before ``or``.  An expression evaluates to its licences and to the freedom it
leaves: of licences joined by ``and`` the strictest counts, of those joined by
``or`` the most liberal, and an exception added by ``with`` relaxes a strict
licence by one step.

A null or empty text has no words and no labels, and null as first and last
word.  Equal rows give equal results; the length of a text has no limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame

from songsift.llm.batches import per_text

# The base phrases with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices of other public licences.
MORE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx-license-identifier:"
#: How free a licence of a family leaves its user; families not listed are 0.
FREEDOM = {
    "mit": 3, "apache": 3, "bsd": 3, "isc": 3, "zlib": 3, "unlicense": 3, "cc0": 3,
    "mpl": 2, "lgpl": 2, "epl": 2, "cddl": 2,
    "gpl": 1, "agpl": 1,
}
_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9.+-]+)")
# A-Z to lower case, digits and bytes of other scripts stay, all else is a gap.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def read_expression(text: bytes, at: int) -> list[str]:
    """The tokens of the expression at ``at``, as far as they can belong to one."""
    tokens: list[str] = []
    depth, want = 0, True
    while match := _TOKEN.match(text, at):
        token = match[1].decode().lower()
        if token == "(":
            if not want:
                break
            depth += 1
        elif token == ")":
            if want or not depth:
                break
            depth -= 1
        elif token in _BINDS:
            if want:
                break
            want = True
        elif want:
            want = False
        else:
            break
        tokens.append(token)
        at = match.end()
    while tokens and (tokens[-1] in _BINDS or tokens[-1] == "("):
        depth -= tokens.pop() == "("
    return tokens + [")"] * depth


def freedom(name: str) -> int:
    return FREEDOM.get(re.split(r"[-.+0-9]", name)[0], 0)


def evaluate(tokens: list[str]) -> tuple[set[str], int]:
    """The licences of an expression and the freedom it leaves (0 to 3)."""
    values: list[tuple[set[str], int]] = []
    waiting: list[str] = []

    def apply() -> None:
        kind = waiting.pop()
        (b, free_b), (a, free_a) = values.pop(), values.pop()
        if kind == "with":
            values.append((a, min(3, free_a + 1) if free_a else 0))
        else:
            values.append((a | b, (min if kind == "and" else max)(free_a, free_b)))

    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                apply()
            waiting.pop()
        elif token in _BINDS:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                apply()
            waiting.append(token)
        else:
            values.append(({token}, freedom(token)))
    while waiting:
        apply()
    return values[0] if values else (set(), 0)


def _notices() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrase, label in {**MORE_PHRASES, **BASE_PHRASES}.items():
        automaton.add_word(f" {phrase} ", (label, len(phrase) + 2, phrase in BASE_PHRASES))
    automaton.make_automaton()
    return automaton


def scan_text(text: bytes, automaton: ahocorasick.Automaton) -> tuple:
    words = text.translate(_WORDS).split()
    plain = b" ".join([b"", *words, b""])
    places, base, labels, score = [], set(), set(), 0.0
    for end, (label, size, is_base) in automaton.iter(plain.decode("latin-1")):
        labels.add(label)
        score = max(score, 0.9 if is_base else 0.6)
        if is_base:
            base.add(label)
            places.append(end + 1 - size)
    at = (lower := text.lower()).find(TAG.encode())
    while at >= 0:
        at += len(TAG)
        names, free = evaluate(read_expression(text, at))
        if names:
            labels |= names
            score = max(score, 0.7 + 0.1 * free)
        at = lower.find(TAG.encode(), at)
    first = plain.count(b" ", 0, min(places)) if places else None
    last = plain.count(b" ", 0, max(places)) if places else None
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def _scanner() -> Callable[[list[bytes]], list]:
    import pyarrow as pa

    automaton = _notices()
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def scan(texts: list[bytes]) -> list:
        columns = zip(*(scan_text(t, automaton) for t in texts))
        return [pa.array(list(c), kind) for c, kind in zip(columns, types)]

    return scan


def scan_licenses(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Words, places of base notices, their first and last word, labels and a score.

    The score is 0 without a label, 0.6 for a notice, 0.9 for a base notice, and
    0.7 to 1.0 for an identifier tag, the more the freer; the largest counts.
    """
    fields = (
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double"
    )
    return per_text(df, _scanner, fields, keep, text)
