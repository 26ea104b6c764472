import numpy as np
import pytest

from songsift.llm.toxicity_chain import (
    Rows,
    Settings,
    best_threshold,
    fit_chain,
    fit_logistic,
    labelled_sample,
    logistic,
    one_of_each_group,
    predict_toxicity,
    train_chain,
)


def test_logistic_fit_is_the_minimum():
    random = np.random.default_rng(0)
    words = [np.unique(random.integers(0, 12, 5)) for _ in range(200)]
    y = np.array([float(3 in w or random.random() < 0.1) for w in words])
    rows = Rows(words, 12, random.random((200, 1)))
    w = fit_logistic(rows, y, Settings(steps=200))
    penalty = np.append(np.full(13, Settings().penalty), 0)
    assert np.abs(rows.transposed(logistic(rows.times(w)) - y) + penalty * w).max() < 0.05
    assert w[3] == w[:12].max()


def test_later_models_use_earlier_probabilities():
    """The second category is the first or word 1; the third follows the second alone."""
    random = np.random.default_rng(1)
    words = [np.unique(random.integers(0, 8, 3)) for _ in range(600)]
    first = np.array([0 in w for w in words])
    second = first | np.array([1 in w for w in words])
    models, threshold = fit_chain(words, 8, np.column_stack([first, second, second]), Settings())
    assert [len(m) for m in models] == [9, 10, 11]
    assert models[2][8 + 1] > 1
    assert 0 < threshold < 1


def test_threshold():
    p, y = np.array([0.9, 0.8, 0.4, 0.3, 0.1]), np.array([True, True, False, True, False])
    assert best_threshold(p, y) == pytest.approx(0.2)
    assert best_threshold(p, np.zeros(5, bool)) == 1
    assert best_threshold(np.zeros(0), np.zeros(0, bool)) == 1


def test_held_out_rows(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    chain = train_chain(docs, labels.filter("doc_id % 5 <> 0"))
    found = predict_toxicity(docs, chain, ["doc_id"])
    assert found.columns == ["doc_id", "p_kind1", "p_kind2", "p_toxic", "toxic"]
    held = labels.filter("doc_id % 5 = 0").withColumnRenamed("toxic", "label")
    rows = found.join(held, "doc_id").collect()
    assert sum(r.toxic == bool(r.label) for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r[c] <= 1 for r in rows for c in ("p_kind1", "p_kind2", "p_toxic"))


def made_up(random, n):
    """Toxic texts of two kinds, of words of no known language, among common words."""
    common = [f"w{i}" for i in range(300)]
    kinds = [[f"grr{i}" for i in range(6)], [f"zok{i}" for i in range(6)]]
    rows = []
    for i in range(n):
        words = random.choice(common, 40).tolist()
        kind = i % 4
        if kind < 2:
            words[5:5] = random.choice(kinds[kind], 3).tolist()
        rows.append((i, " ".join(words), int(kind < 2), kind))
    return rows


def test_kinds_are_learned_from_the_labels(spark):
    """The groups of words are those that occur together, and the chain tells the kinds apart in new texts."""
    rows = made_up(np.random.default_rng(6), 900)
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int, kind int")
    chain = train_chain(df.filter("doc_id < 600"), df.filter("doc_id < 600").select("doc_id", "toxic"))
    assert chain.categories == ["kind1", "kind2", "toxic"]
    found = predict_toxicity(df, chain, ["doc_id", "kind"]).filter("doc_id >= 600").collect()
    assert sum(r.toxic == (r.kind < 2) for r in found) >= 0.98 * len(found)
    first = {r.kind for r in found if r.p_kind1 > 0.5}
    second = {r.kind for r in found if r.p_kind2 > 0.5}
    assert first | second == {0, 1} and not first & second


def test_given_kinds(spark):
    rows = made_up(np.random.default_rng(7), 400)
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int, kind int")
    chain = train_chain(df, df.select("doc_id", "toxic"), kinds={"growl": [f"grr{i}" for i in range(6)]})
    found = predict_toxicity(df, chain, ["kind"]).collect()
    assert chain.categories == ["growl", "toxic"]
    assert all((r.p_growl > 0.5) == (r.kind == 0) for r in found)


def test_labels_other_than_0_and_1_are_left_out(spark, docs):
    labels = spark.createDataFrame([(1, 7), (2, 1), (3, -1), (4, 0)], "doc_id bigint, toxic int")
    assert {r._id for r in labelled_sample(labels, "doc_id", "toxic", Settings()).collect()} == {2, 4}


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (5, 0), (6, 0), (77, 1)], "doc_id bigint, toxic int"
    )
    chain = train_chain(odd, labels)
    rows = predict_toxicity(odd, chain, ["doc_id"]).collect()
    assert len(rows) == odd.count() and not any(r.toxic for r in rows if r.doc_id in (2, 3, 5))
    assert predict_toxicity(none, chain, ["doc_id"]).count() == 0
    unlearned = train_chain(odd, labels.limit(0))
    assert not any(r.toxic for r in predict_toxicity(odd, unlearned, ["doc_id"]).collect())
    assert {(r._id, r._label) for r in labelled_sample(labels, "doc_id", "toxic", Settings()).collect()} == {
        (1, 1), (2, 0), (5, 0), (6, 0), (77, 1),
    }


def test_near_copies_count_once(spark):
    rows = [(5, 1, ["a"], [1, 2]), (3, 1, ["b"], [2, 9]), (4, 0, ["c"], [7, 8]), (3, 0, ["b"], [2, 9])]
    found = spark.createDataFrame(rows, "_hash bigint, _label int, _words array<string>, _bands array<bigint>")
    assert {(r._hash, r._label) for r in one_of_each_group(found).collect()} == {(3, 1), (4, 0)}
