import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from songsift.llm.collocations import CHUNK, PART, Rules, Summary, chunks, collocations
from songsift.llm.queries import QUERIES

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, rules=Rules()):
    """``rows`` are (text, lang)."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(ASCII_LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, rules.longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= rules.threshold}
        dropped = set()
        for longer, n in candidates.items():
            for k in range(2, len(longer)):
                for i in range(len(longer) - k + 1):
                    if 100 * n >= rules.percent * candidates[longer[i : i + k]]:
                        dropped.add(longer[i : i + k])
        rows = []
        for p, a in candidates.items():
            cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if p not in dropped:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[: rules.top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def found(df, *options, **more):
    return sorted(tuple(r) for r in collocations(df, *options, **more).collect())


def pairs(df):
    return [tuple(r) for r in df.select("text", "lang").collect()]


def test_query_equals_brute_force(spark, sf_dir, docs):
    rows = QUERIES["op12_collocations"](spark, sf_dir)
    assert rows.dtypes[0] == ("lang", "string") and {t for _, t in rows.dtypes[3:]} == {"bigint"}
    expected = brute_force(pairs(docs))
    assert expected and sorted(tuple(r) for r in rows.collect()) == expected


@pytest.mark.parametrize("size, part", [(CHUNK, PART), (50, 1000), (7, PART)])
def test_low_thresholds_chunks_and_partitions_equal_brute_force(spark, size, part):
    random = np.random.default_rng(size)
    words = [f"w{i}" for i in range(40)] + ["New", "York,", "é;x", "a.b", "t\tu"]
    share = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(150):
        some = random.choice(words, int(random.integers(1, 60)), p=share / share.sum()).tolist()
        if i % 3 == 0:
            some[1:1] = "in the long run we all".split()
        rows.append((" ".join(some), [None, "en", "de"][i % 3]))
    rows += [rows[0]] * 30
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    for rules in (Rules(threshold=5), Rules(threshold=20, top=9), Rules(threshold=8, longest=2), Rules(6, 7, 60)):
        assert found(df, rules, size=size, part=part) == brute_force(rows, rules)


def test_phrase_spread_thinly_over_many_chunks_survives(spark):
    rows = [(" ".join(f"x{i}y{j}" for j in range(40)) + " rare find here", "en") for i in range(120)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(60)
    assert found(df, size=20, part=200) == brute_force(rows) != []


def test_odd_rows(odd, none):
    rules = Rules(threshold=2)
    assert found(odd, rules) == brute_force(pairs(odd), rules)
    assert found(none, rules) == []


def test_scores_pass_64_bits(spark):
    from songsift.llm.collocations import score_cuts

    big = 3 * 10**12
    counts = spark.createDataFrame(
        [("en", "", 10**15), ("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 7)],
        "lang string, phrase string, n bigint",
    )
    row = score_cuts(counts).collect()[0]
    assert row["score"] == 1000 * (big - 7) * 10**15 // (big * (big + 1))


def test_summaries_keep_every_frequent_key():
    random = np.random.default_rng(2)
    keys = np.concatenate([np.repeat(np.arange(5), 120), random.integers(10, 10**6, 30_000)]).astype(np.uint32)
    random.shuffle(keys)
    capacity = len(keys) // 100 + 1
    summary = Summary(capacity)
    for part in np.array_split(keys, 50):
        summary.add(*np.unique(part, return_counts=True))
    kept = summary.frequent(100)
    assert summary.short < 100 and len(summary.keys) <= capacity
    assert set(range(5)) <= set(kept.tolist())


def test_chunks_of_a_long_text_repeat_its_last_words():
    import pyarrow as pa

    text = ("one two three. four five six seven eight " * 200_000).encode()
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "_text"])
    whole, seen = list(chunks([batch], 5, 10**9)), list(chunks([batch], 5, 100_000))
    assert len(whole) == 1 and len(seen) > 5 and seen[1].carried == 4
    for k in (1, 3, 5):
        assert sum(int(c.counted(k).sum()) for c in seen) == int(whole[0].counted(k).sum())
