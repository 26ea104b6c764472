import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from songsift.llm.difference_cover import LONGEST, suffix_array
from songsift.llm.suffix_dedup import remove_repeats, runs_of, sliced_runs


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_arrays(letters):
    random_ = np.random.default_rng(letters)
    for n in [*range(12), *random_.integers(12, 80, 120).tolist()]:
        symbols = random_.integers(1, letters + 1, n)
        assert suffix_array(symbols).tolist() == sorted(range(n), key=lambda i: symbols[i:].tolist())


def test_too_long_for_one_sort():
    with pytest.raises(ValueError):
        suffix_array(np.ones(LONGEST + 1, np.int64))


def plain(texts, length):
    """(bytes, removed, spans, what is left) by counting every string."""
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(b for b, x in zip(t, gone) if not x)))
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abé ") for _ in range(200)) for _ in range(6)]
    out = []
    for _ in range(250):
        text = ""
        for _ in range(rnd.randint(0, 5)):
            if rnd.random() < 0.5:
                at = rnd.randint(0, 150)
                text += rnd.choice(base)[at : at + rnd.randint(5, 120)]
            else:
                text += "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 60)))
        out.append(text)
    return out + out[:10] + ["x" * 300, "xy" * 200, "", None, "ab" * 30, "\x00" * 90, "é" * 20]


def test_equal_strings_have_equal_anchors(texts):
    """Every start lies in one run, and equal strings are filed under equal anchors at equal places."""
    data = [(t or "").encode() for t in texts]
    seen, starts = {}, 0
    for who, anchor, first, end, place in zip(*(x.tolist() for x in runs_of(data, 40, 13))):
        for i in range(first, end):
            filed = (anchor, place - i)
            assert seen.setdefault(data[who][i : i + 40], filed) == filed
            starts += 1
    assert starts == sum(max(0, len(t) - 39) for t in data)
    cut = {}
    for runs in sliced_runs(data, 40, 13, size=50):
        for who, anchor, first, end, place in zip(*(x.tolist() for x in runs)):
            cut |= {(who, i): (anchor, place - i) for i in range(first, end)}
    assert len(cut) == starts
    assert all(seen[data[who][i : i + 40]] == filed for (who, i), filed in cut.items())


@pytest.mark.parametrize("group", [1000, 3])
def test_removal_equals_brute_force(spark, texts, group):
    rows = [(i if i % 40 else None, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, number int")
    found = remove_repeats(df, ["doc_id", "number"], length=40, gram=13, group=group).collect()
    wanted = plain([(t or "").encode() for t in texts], 40)
    assert len(found) == len(texts)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == wanted[r.number]


def test_documents(docs, odd, none):
    for df in (docs, odd.drop("of")):
        rows = df.select("doc_id", "text").collect()
        wanted = Counter(
            (r.doc_id, n, gone, spans, hashlib.sha256(left).hexdigest())
            for r, (n, gone, spans, left) in zip(rows, plain([(r.text or "").encode() for r in rows], 400))
        ) if df is docs else None
        found = remove_repeats(df, ["doc_id"], digests=True).collect()
        if wanted:
            assert Counter(map(tuple, found)) == wanted
        else:
            by_id = {(r.doc_id, r.n_bytes): r.n_removed for r in found}
            assert by_id[6, 216_000] == by_id[7, 216_000] == 216_000
            assert len(found) == df.count() and sum(r.n_removed for r in found) == 432_000
    assert remove_repeats(none.drop("of"), ["doc_id"]).count() == 0
