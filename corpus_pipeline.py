"""The corpus pipeline: documents through five stages, each written and read again.

1. ``language``: documents whose language cannot be told go, that is those
   without a letter and those of which the network is hardly surer than it would be
   by chance, with ``MIN_LIFT`` divided by the number of languages as the limit.  If
   no document has a language there is no network, and all documents stay.
2. ``near_duplicates``: of each group of texts that SimHash links one document
   stays, the one with the smallest id.
3. ``benchmark``: documents that hold a test item go.
4. ``secrets``: secrets are replaced by the name of their kind in brackets.
5. ``tokens``: the ids of each text, with what they decode to.

A stage sees all that the one before kept and returns the columns of documents,
the last one ``ids`` and ``decoded`` as well.  A null id counts as the largest.
Empty tables pass through as they are, and further columns of the documents are
left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songsift.llm.byte_gru import UNKNOWN, Settings, predict_language, train, training_sample
from songsift.llm.covering_simhash import one_of_each
from songsift.llm.decontaminate import find_leaks
from songsift.llm.secret_scan import redact_secrets
from songsift.llm.word_bpe import encode_texts
from songsift.session import scratch_path, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The least probability of the best language, as a multiple of the mean over all languages.
MIN_LIFT = 1.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    sample = training_sample(docs.filter(fold != 2), "text", "lang", ["doc_id"], Settings())
    network = train(sample)
    if network is None:
        return docs.select(*COLUMNS)
    # One language alone is always certain.
    limit = min(1.0, MIN_LIFT / len(network.languages))
    found = predict_language(docs, network, COLUMNS)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= limit * (1 - 1e-6))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs.select(*COLUMNS))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, items, COLUMNS).filter(F.size("leaks") == 0).select(*COLUMNS)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = redact_secrets(docs, COLUMNS)
    text = F.when(F.col("n_redacted") > 0, F.col("redacted")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_redacted") > 0, F.char_length("redacted")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_texts(docs, COLUMNS, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near),
    ("benchmark", no_benchmark),
    ("secrets", no_secrets),
    ("tokens", tokens),
]
#: Models, hashes and vocabularies are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  What a stage before it keeps on the way goes when its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path, schema = scratch_path(spark, name), docs.select(*COLUMNS).schema
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
