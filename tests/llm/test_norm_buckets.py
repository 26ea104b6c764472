import math
import re
from collections import Counter

import numpy as np
import pytest

from songsift.llm import norm_buckets
from songsift.llm.norm_buckets import best_documents
from songsift.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


def brute_force(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(text))
                if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(docs, items, **options):
    rows = best_documents(docs, items, **options).collect()
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows], key=repr)


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_query_equals_brute_force(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    expected = brute_force(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    rows = QUERIES["op11_norm_buckets"](spark, sf_dir)
    assert rows.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted([tuple(r) for r in rows.collect()], key=repr) == expected


@pytest.mark.parametrize("batch", [7, 10_000])
def test_many_buckets_and_copies_equal_brute_force(spark, batch):
    random = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    rows = [
        (i, " ".join(random.choice(words, int(random.integers(1, 80)), p=share / share.sum()))) for i in range(400)
    ]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]
    items = [(j, " ".join(random.choice(words, 12))) for j in range(25)] + [(99, rows[5][1]), (100, "none of these")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(docs, queries) == brute_force(rows, items)
        assert found(docs, queries, k=3, at_once=7) == brute_force(rows, items, 3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bounds_lose_nothing_and_prune(spark):
    random = np.random.default_rng(1)
    terms_, weights = [], []
    for _ in range(500):
        own = np.sort(random.choice(60, random.integers(1, 20), replace=False))
        terms_.append(own.tolist())
        weights.append((random.random(len(own)) ** 3 * 10**9).astype(int).tolist())
    import pyarrow as pa

    length = [math.sqrt(sum(x * x for x in w)) for w in weights]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(500)), pa.array(length), pa.array(terms_, pa.list_(pa.int32())), pa.array(weights)],
        ["doc_id", "length", "terms", "weights"],
    )
    bucket, kept = norm_buckets.Bucket(batch, 60), 0
    for _ in range(50):
        item = np.sort(random.choice(60, 8, replace=False))
        wanted = np.isin(np.arange(60), item)
        every = bucket.scores(np.arange(500), wanted)
        assert every.tolist() == [sum(x for t, x in zip(*row) if t in item) for row in zip(terms_, weights)]
        threshold = int(np.sort(every)[-10])
        some = bucket.survivors(item, threshold)
        assert set(np.flatnonzero(every >= threshold)) <= set(some)
        kept += len(some)
    assert kept < 50 * 500 / 4


def test_odd_rows(spark, odd, none, docs):
    items = spark.createDataFrame([(1, "quick BROWN fox 日本語"), (2, None), (3, ""), (None, "lorem")], "item_id int, text string")
    assert found(odd, items) == brute_force(pairs(odd, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert found(none, items) == [] and found(odd, items.limit(0)) == []


def test_terms_of_long_texts_are_whole():
    text = ("abc déf-9 " * 300_000).encode()
    parts = list(norm_buckets.terms_of(text))
    assert len(parts) > 2 and Counter(t for p in parts for t in p) == Counter(text.replace(b"-", b" ").split())
