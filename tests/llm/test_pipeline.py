import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from songsift.llm.secret_scan import find_spans, keyword_automaton


@pytest.fixture(scope="module")
def steps(spark, docs, tmp_path_factory):
    """The rows before each stage, and the result."""
    sf_dir = docs.inputFiles()[0].rsplit("/", 1)[0]
    out, rows = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
        out.append(rows)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(docs, steps):
    for rows in steps[1:-1]:
        assert rows.dtypes == docs.dtypes
    assert steps[-1].columns == [*docs.columns, "ids", "decoded"]


def simhash(text):
    """Three-word shingles and the majority of each bit, word by word."""
    words = text.encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_of_each(rows):
    """The ids that stay if all pairs of texts within three bits are linked."""
    prints, label = [(simhash(t), i) for i, t in sorted(rows)], {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, (a, i) in enumerate(prints):
        for b, j in prints[:n]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return sorted(i for i in label if label[i] == i)


def test_clean_documents_stay_and_groups_leave_one(steps):
    assert ids(steps[0]) == ids(steps[1])
    kept = smallest_of_each([(r.doc_id, r.text) for r in steps[1].collect()])
    assert ids(steps[2]) == kept and len(kept) < len(ids(steps[1]))


def test_no_language_at_all_keeps_the_corpus(docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert ids(corpus_pipeline.language(None, bare, "")) == ids(docs)


def test_one_language_keeps_all_with_letters(spark, docs):
    one = docs.withColumn("lang", F.lit("en"))
    odd = spark.createDataFrame([(-1, "12 34", "en", "a", 5), (-2, "x", "en", "a", 1)], docs.schema)
    assert ids(corpus_pipeline.language(None, one.union(odd), "")) == sorted([*ids(docs), -2])


def test_many_languages_keep_clean_texts(spark):
    """The limit falls with the number of languages, so a text is not lost for being less certain."""
    random, rows = np.random.default_rng(8), []
    for n in range(12):
        letters = random.choice(list("abcdefghijklmnopqrstuvwxyz"), 12)
        for i in range(40):
            text = " ".join("".join(random.choice(letters, 4)) for _ in range(8))
            rows.append((100 * n + i, text, f"l{n}", "a", len(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert ids(corpus_pipeline.language(None, df, "")) == sorted(r[0] for r in rows)


def test_documents_with_test_items_go(spark, steps, docs):
    sf_dir = docs.inputFiles()[0].rsplit("/", 1)[0]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in steps[2].collect() if any(i in r.text for i in items)}
    gone = set(ids(steps[2])) - set(ids(steps[3]))
    assert holds and holds <= gone and len(gone) <= len(holds) + 2


def test_secrets_are_gone_and_the_rest_is_not(steps):
    automaton, before = keyword_automaton(), {r.doc_id: r for r in steps[3].collect()}
    changed = 0
    for r in steps[4].collect():
        assert not find_spans(r.text.encode(), automaton)
        assert r.n_chars == len(r.text)
        if find_spans(before[r.doc_id].text.encode(), automaton):
            changed += 1
        else:
            assert r.text == before[r.doc_id].text
    assert changed and len(before) == steps[4].count()


def test_tokens(steps):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_run_gives_the_last_stage(spark, docs, steps):
    sf_dir = docs.inputFiles()[0].rsplit("/", 1)[0]
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(steps[-1])


def test_odd_rows(spark, odd, none, docs):
    sf_dir = docs.inputFiles()[0].rsplit("/", 1)[0]
    for rows in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf_dir)
        assert rows.columns == [*corpus_pipeline.COLUMNS, "ids", "decoded"]
    kept = sorted(r.doc_id for r in corpus_pipeline.near(spark, corpus_pipeline.language(spark, odd, sf_dir), sf_dir)
                  .filter("doc_id is not null").collect())
    assert kept == [1, 6]
