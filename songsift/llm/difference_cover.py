"""Suffix arrays by difference cover, in numpy.

The suffixes at positions 1 and 2 modulo 3 are the sample.  They are sorted by
their first three symbols and named by rank; if names repeat, the sequence of
names is sorted in the same way, which orders the sample.  The other suffixes
are then sorted by their first symbol and the rank of the sample suffix behind
it, and merged with the sample by symbols and ranks.
"""

from __future__ import annotations

import numpy as np

#: Symbols and ranks must fit 21 bits, three to a sort key.
LONGEST = (1 << 21) - 8


def _ranks_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of ``keys``, and names from 1 by their order."""
    order = np.argsort(keys)
    new = np.ones(len(keys), np.int64)
    new[1:] = np.diff(keys[order]) != 0
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(new)
    return order, names, int(new.sum())


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The positions of ``symbols`` (whole numbers from 1) in the order of their suffixes."""
    n = len(symbols)
    if n > LONGEST or (n and symbols.max() > LONGEST):
        raise ValueError(f"at most {LONGEST} symbols at once")
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.zeros(n + 3, np.int64)
    s[:n] = symbols
    # With n = 1 modulo 3 a sample position behind the end parts the two halves.
    last = n + (n % 3 == 1)
    ones, twos = np.arange(1, last, 3), np.arange(2, last, 3)
    if n % 3 == 1:
        ones = np.append(ones[ones < n], n)
    sample = np.concatenate([ones, twos[twos < n]])
    order, names, different = _ranks_of(s[sample] << 42 | s[sample + 1] << 21 | s[sample + 2])
    if different < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    in_order = sample[order]
    in_order = in_order[in_order < n]

    others = np.arange(0, n, 3)
    others = others[np.argsort(s[others] << 21 | rank[others + 1])]
    by_one = lambda at: s[at] << 21 | rank[at + 1]
    by_two = lambda at: s[at] << 42 | s[at + 1] << 21 | rank[at + 2]
    first, second = in_order[in_order % 3 == 1], in_order[in_order % 3 == 2]
    before = np.searchsorted(by_one(first), by_one(others)) + np.searchsorted(by_two(second), by_two(others))
    out = np.full(n, -1, np.int64)
    out[before + np.arange(len(others))] = others
    out[out < 0] = in_order
    return out
