import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from songsift.llm.gru_lm import Corpus, Network, Settings, score_documents
from songsift.llm.queries import QUERIES
from pyspark.sql import functions as F

SMALL = Settings(classes=3, members=4, hidden=5, window=4, documents=20, words=30, updates=5, lanes=4)
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall("[^ \t-\r]+", (text or "").translate(ASCII_LOWER)), " "]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_scores(rows):
    counts = Counter(t for i, text in rows if i is not None and not held(i) for t in tokens(text))
    total = sum(counts.values())
    out = []
    for i, text in rows:
        own = tokens(text)
        score = sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in own)
        out.append((i, held(i), len(own), sum(counts[t] > 0 for t in own), total, score))
    return out


def scored(df, **options):
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    marked = df.withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    return score_documents(marked, fold != 2, ["doc_id", "held_out"], **options)


def same(found, rows):
    key = lambda r: (str(r[0]), r[2], r[5])
    plain = sorted([tuple(r)[:6] for r in found], key=key)
    expected = sorted(base_scores(rows), key=key)
    assert [r[:5] for r in plain] == [r[:5] for r in expected]
    assert np.allclose([r[5] for r in plain], [r[5] for r in expected], rtol=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return QUERIES["op13_gru_lm"](spark, sf_dir).collect()


def test_query_counts_equal_brute_force(rows, docs):
    same(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_query_columns(spark, sf_dir):
    types = QUERIES["op13_gru_lm"](spark, sf_dir).dtypes
    assert types == [("doc_id", "bigint"), ("held_out", "boolean")] + [
        (c, "bigint") for c in ("n_tokens", "n_known", "train_tokens")
    ] + [("base_score", "double"), ("score", "double")]


def test_held_out_texts_are_better_predicted_than_by_counts(rows):
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 10
    tokens_ = sum(r["n_tokens"] for r in out)
    gain = sum(r["score"] - r["base_score"] for r in out) / tokens_
    assert gain > 0.1
    assert sum(r["score"] > r["base_score"] for r in out) > 0.9 * len(out)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    same(scored(odd, settings=SMALL).collect(), rows)
    same(scored(odd, settings=SMALL, block=1).collect(), rows)
    assert scored(none, settings=SMALL).collect() == []
    nothing = score_documents(odd, F.lit(False), ["doc_id"], settings=SMALL).collect()
    assert len(nothing) == len(rows) and all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in nothing)
    with pytest.raises(ValueError):
        score_documents(odd.withColumn("score", F.lit(1)), F.lit(True), ["score"])


def test_blocks_change_no_score_but_rounding(docs):
    some = docs.limit(40).cache()
    a, b = ({r["doc_id"]: r for r in scored(some, settings=SMALL, block=size).collect()} for size in (1 << 24, 1))
    for i, r in a.items():
        assert r["n_known"] == b[i]["n_known"] and abs(r["score"] - b[i]["score"]) < 1e-3 * abs(r["score"])


def network():
    net = Network(np.arange(12, 0, -1, dtype=float), 20, SMALL)
    random = np.random.default_rng(0)
    for w in net.weights.values():
        w += random.normal(0, 0.3, w.shape).astype(np.float32)
    return net


def test_probabilities_sum_to_one():
    net = network()
    state = np.random.default_rng(1).normal(0, 1, (1, 5)).astype(np.float32)
    every = net.output(np.repeat(state, 13, axis=0), np.arange(13))
    assert abs(np.exp(every).sum() - 1) < 1e-5


def test_untrained_network_gives_the_shares_of_the_counts():
    counts = np.array([9.0, 5, 4, 2, 2, 2, 1, 1, 1, 1, 1, 1])
    net = Network(counts, 6, SMALL)
    for i, c in enumerate([*counts, 7]):
        got = net.log_probabilities([np.array([i])])[0]
        assert abs(math.exp(got) - c / (counts.sum() + 7)) < 1e-4


def test_state_is_carried_through_the_whole_text():
    net = network()
    random = np.random.default_rng(5)
    texts = [random.integers(0, 13, n) for n in (1, 50, 7, 50, 0, 23)]
    found = net.log_probabilities(texts, at_once=16)
    for text, got in zip(texts, found):
        h, before, total = np.zeros((1, 5), np.float32), 0, 0.0
        for word in text:
            h = net.step(np.array([before]), h)[0]
            total += float(net.output(h, np.array([word]))[0])
            before = word
        assert abs(total - got) < 1e-3


def test_gradients():
    net = network()
    net.weights = {k: w.astype(np.float64) for k, w in net.weights.items()}
    random = np.random.default_rng(3)
    words = random.integers(0, 13, (4, 3))
    words[3, 1] = -1
    given = np.concatenate([np.zeros((1, 3), np.int64), np.maximum(words[:-1], 0)])
    fresh = np.zeros((4, 3), bool)
    fresh[0, 0] = fresh[2, 2] = True
    h = random.normal(0, 0.5, (3, 5))
    _, grad, _ = net.gradients(words, given, fresh, h)
    for name, w in net.weights.items():
        flat, own = w.reshape(-1), np.asarray(grad[name]).reshape(-1)
        for i in random.choice(len(flat), min(12, len(flat)), replace=False):
            old, losses = flat[i], []
            for d in (1e-4, -1e-4):
                flat[i] = old + d
                losses.append(net.gradients(words, given, fresh, h)[0])
            flat[i] = old
            assert abs((losses[0] - losses[1]) / 2e-4 - own[i]) < 1e-3 * max(1, abs(own[i])), name


def test_training_learns_what_follows():
    net = Network(np.full(12, 10.0), 1, Settings(classes=3, members=4, hidden=8, window=6, lanes=8))
    texts = [np.array([(s + i) % 12 for i in range(30)]) for s in range(12)] * 4
    before = net.log_probabilities(texts).sum()
    net.fit(texts, 300, 0.02)
    assert net.log_probabilities(texts).sum() > before * 0.35


def test_the_denominators_make_whole_distributions():
    corpus = Corpus(tokens=100, distinct=20, texts=10, common=[" ", "a"], counts=[10, 30])
    # The 18 words that are not common hold 60 tokens; each counts once more, and so does an unseen one.
    assert corpus.base == 121 and corpus.further == 60 + 18 + 1


def test_every_training_text_moves_the_network(spark):
    """The network learns from all training texts, not from a part of them."""
    from songsift.llm.gru_lm import TEXT, train

    texts = [(str(i), f"w{i % 7} w{i % 5} w{i % 3} w{i}".encode()) for i in range(60)]
    common = [" ", *[f"w{i}" for i in range(10)]]
    corpus = Corpus(300, 60, 60, common, [60] + [20] * 10)

    def weights(some):
        frame = spark.createDataFrame(some, f"_id string, {TEXT} binary").coalesce(1)
        return np.concatenate([w.ravel() for w in train(frame, corpus, ONE).weights.values()])

    ONE = Settings(classes=3, members=4, hidden=5, window=4, documents=1, words=30, updates=5, lanes=4)
    whole = weights(texts)
    left_out = [np.abs(weights(texts[:i] + texts[i + 1 :]) - whole).max() for i in (3, 17, 29, 48)]
    assert min(left_out) > 0
