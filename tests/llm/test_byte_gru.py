import zlib

import numpy as np
import pytest

from songsift.llm.byte_gru import (
    PAD,
    Network,
    Settings,
    has_letter,
    in_segments,
    predict_language,
    train,
    training_sample,
)
from songsift.llm.queries import op6_byte_gru


def test_gradients_by_differences():
    net = Network(["a", "b", "c"], Settings(hidden=3))
    xs = in_segments([b"hello w\xc3\xa9", b"xyz", b"abcdefghijkl"], 12)[0].T.copy()
    target = np.array([0, 1, 2])
    _, gradients = net.gradients(xs, target)
    random = np.random.default_rng(0)
    for w, d in zip(net.parameters, gradients):
        for _ in range(5):
            at = tuple(random.integers(0, n) for n in w.shape)
            if len(w) == PAD + 1:
                at = (int(random.choice(list(b"helo"))), at[1])
            old = w[at]
            w[at] = old + 1e-2
            high, _ = net.gradients(xs, target)
            w[at] = old - 1e-2
            low, _ = net.gradients(xs, target)
            w[at] = old
            assert (high - low) / 2e-2 == pytest.approx(d[at], abs=2e-4)


def test_segments_hold_every_byte_once():
    rows, owner = in_segments([b"abcde", b"", b"fg"], 3)
    assert owner.tolist() == [0, 0, 2]
    assert rows.tolist() == [[97, 98, 99], [100, 101, PAD], [102, 103, PAD]]


def test_padding_does_not_count():
    net = Network(["a", "b"], Settings())
    short = in_segments([b"word"], 4)[0].T.astype(np.intp)
    padded = in_segments([b"word"], 9)[0].T.astype(np.intp)
    assert net.pooled(short) == pytest.approx(net.pooled(padded), abs=1e-5)
    assert net.pooled(short).sum() == pytest.approx(4, abs=1e-4)


def test_letters():
    assert has_letter(b"1a") and has_letter("é".encode()) and has_letter("語".encode())
    assert not has_letter(b"") and not has_letter("12 😀 ½".encode())


def test_held_out_accuracy(spark, docs):
    sf_dir = docs.inputFiles()[0].rsplit("/", 1)[0]
    rows = op6_byte_gru(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    unseen = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(unseen) >= 0.9 * len(unseen)


def test_odd_rows(odd, none):
    quick = Settings(updates=3)
    network = train(training_sample(odd, "text", "lang", ["doc_id"], quick), quick)
    assert network.languages == ["en", "pt"]
    for r in predict_language(odd, network, ["doc_id", "text"]).collect():
        if r.text and has_letter(r.text.encode()):
            assert r.lang_pred in network.languages and 0.5 <= r.score <= 1
        else:
            assert (r.lang_pred, r.score) == ("und", 0)
    assert train(training_sample(none, "text", "lang", ["doc_id"], quick), quick) is None
    assert {r.lang_pred for r in predict_language(odd, None, ["doc_id"]).collect()} == {"und"}
    assert predict_language(none, network, ["doc_id"]).count() == 0


def test_sample_is_limited_before_the_shuffle(docs):
    plan = training_sample(docs, "text", "lang", ["doc_id"], Settings())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    small = training_sample(docs, "text", "lang", ["doc_id"], Settings(documents=5))
    assert {r["count"] for r in small.groupBy("_label").count().collect()} == {5}


def test_texts_are_cut_into_segments_a_megabyte_at_a_time(monkeypatch):
    """Segments take many times the size of their texts, so a task cuts few texts at once."""
    from songsift.llm import byte_gru

    sizes = {}
    monkeypatch.setattr(byte_gru, "per_text", lambda *args, size=4 << 20: sizes.setdefault("size", size))
    byte_gru.predict_language(None, None, ["doc_id"])
    assert sizes["size"] == 1 << 20
