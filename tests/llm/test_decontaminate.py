import random

import numpy as np
import pytest

from songsift.llm.decontaminate import Index, Thresholds, find_leaks, leak_rows, question_and_answer, terms_of


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def plain_search(index, terms, threshold):
    score = np.zeros(len(index.items))
    for t in terms:
        for i, w in zip(index.item_of[t], index.impact[t]):
            score[i] += w
    return {i: s for i, s in enumerate(score.tolist()) if s >= threshold}


def test_block_max_wand_finds_all_above_the_threshold():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(words[: rnd.choice([5, 60])]) for _ in range(rnd.randint(1, 12)))) for i in range(90)]
    index = Index(items, blocks=20)
    for _ in range(300):
        terms = sorted(rnd.sample(range(len(index.number)), rnd.randint(0, 30)))
        for threshold in (0.2, 0.5, 0.9):
            sums = index.block_max[terms].sum(axis=0)
            found = dict(index.search(terms, threshold, sums >= threshold - 1e-3))
            assert found == pytest.approx(plain_search(index, terms, threshold))


def plain_leaks(rows, index, limits):
    """Every passage against every item, without index or bounds."""
    stride, out = index.longest, set()
    for doc_id, text in rows:
        words = terms_of((text or "").encode())
        for at in range(0, len(words), stride):
            own = words[at : at + 2 * stride]
            terms = sorted({index.number[w] for w in own if w in index.number})
            for i in plain_search(index, terms, limits.score):
                enough = True
                for part, least in zip(index.parts[i], (limits.question, limits.answer)):
                    n = min(limits.words, len(part))
                    grams = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)} if n else set()
                    seen = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
                    enough &= not grams or len(grams & seen) / len(grams) >= least
                if enough:
                    out.add((doc_id, index.items[i]))
    return out


@pytest.mark.parametrize("limits", [Thresholds(), Thresholds(score=0.25, question=0.0, answer=0.0)])
def test_leaks_equal_brute_force(docs, items, limits):
    index = Index([(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()])
    found = leak_rows(find_leaks(docs, items, ["doc_id"], limits=limits), ["doc_id"]).collect()
    expected = plain_leaks([(r.doc_id, r.text) for r in docs.collect()], index, limits)
    assert {(r.doc_id, r.item_id) for r in found} == expected


def test_copied_items_are_found_and_shards_agree(spark, docs, items):
    some = [r.text for r in items.limit(6).collect()]
    rows = [(i, "Other words go first. " * i + t.upper() + " and last.") for i, t in enumerate(some)]
    df = spark.createDataFrame([*rows, (None, some[0]), (99, None), (98, ""), (97, "clean text")], "doc_id bigint, text string")
    want = {(i, r.item_id) for i, r in enumerate(items.limit(6).collect())} | {(None, items.first().item_id)}
    for shard in (20_000, 7):
        found = leak_rows(find_leaks(df, items, ["doc_id"], shard=shard), ["doc_id"]).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
        assert all(r.score > 0.99 and r.question == r.answer == 1 for r in found)


def test_shards_change_no_result(spark, docs, items):
    """Partial copies around the threshold, with each item's first words or last ones changed."""
    rnd, rows = random.Random(4), []
    for r in items.collect():
        words = r.text.split()
        for share in (0.2, 0.35, 0.5):
            n = int(share * len(words))
            rows += [" ".join(words[n:]) + " new text here", "some lead " + " ".join(rnd.sample(words, n) + words[n:])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    loose = Thresholds(score=0.5, question=0.2, answer=0.2)
    found = []
    for shard in (20_000, 7, 1):
        leaks = leak_rows(find_leaks(df, items.limit(20), ["doc_id"], shard=shard, limits=loose), ["doc_id"]).collect()
        found.append(sorted((r.doc_id, r.item_id, round(r.score, 9), r.question, r.answer, r.first_word) for r in leaks))
    assert found[0] == found[1] == found[2] and 20 < len(found[0]) < len(rows)


def test_items_in_scripts_without_blanks(spark):
    item = "\u6c34\u5728\u591a\u5c11\u5ea6\u6cb8\u817e\uff1f\u5728\u6807\u51c6\u6c14\u538b\u4e0b\u662f\u4e00\u767e\u6444\u6c0f\u5ea6\u3002"
    other = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65\u5427"
    quoted = "What is \u201cwater\u201d made of? It\u2019s hydrogen\u00a0and oxygen."
    items = spark.createDataFrame([(1, item), (2, quoted)], "item_id bigint, text string")
    rows = [(1, other * 5 + item.rstrip("\u3002") + other * 5), (2, other * 9), (3, "so: " + quoted.upper().replace("\u2019", "'") + " ok")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = leak_rows(find_leaks(df, items, ["doc_id"]), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (3, 2)]
    assert terms_of("a\u4e2d\u6587\u5b57b \u201cc\u201d_d".encode()) == ["a".encode(), "\u4e2d\u6587".encode(), "\u6587\u5b57".encode(), b"b", b"c", b"d"]


def test_odd_rows_and_items(spark, odd, none):
    texts = [(1, "The quick brown fox jumps over it."), (2, None), (3, ""), (None, "?!"), (4, "lorem ipsum")]
    items = spark.createDataFrame(texts, "item_id bigint, text string")
    found = leak_rows(find_leaks(odd, items, ["doc_id"]), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (1, 1), (6, 4), (7, 4)]
    assert find_leaks(odd, items.limit(0), ["doc_id"]).filter("size(leaks) > 0").count() == 0
    assert find_leaks(none, items, ["doc_id"]).count() == 0


def test_question_and_answer():
    assert question_and_answer("What is it? A cat. Yes!") == ([b"what", b"is", b"it", b"a", b"cat"], [b"yes"])
    assert question_and_answer("one two three") == ([b"one", b"two"], [b"three"])
    assert question_and_answer("") == ([], [])
