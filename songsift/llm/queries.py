"""The registered queries of the operators in this subpackage.

Each reads its whole table and returns the operator's full result.  Counts and
rankings have SQL; hashes, vocabularies, models and suffix orders are beyond it, so
the tests hold the other queries against a brute-force version, an exact round
trip or held-out accuracy.
"""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songsift.llm.arc_convert import convert_pages
from songsift.llm.byte_gru import Settings, predict_language, train, training_sample
from songsift.llm.collocations import collocations
from songsift.llm.covering_simhash import near_duplicates
from songsift.llm.decontaminate import find_leaks, leak_rows
from songsift.llm.gru_lm import score_documents
from songsift.llm.license_scan import scan_licenses
from songsift.llm.norm_buckets import best_documents
from songsift.llm.repetition_rules import check_quality
from songsift.llm.secret_scan import scan_secrets
from songsift.llm.suffix_dedup import remove_repeats
from songsift.llm.toxicity_chain import predict_toxicity, train_chain
from songsift.llm.word_bpe import encode_texts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_arc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("payload")


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    chain = train_chain(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predict_toxicity(documents, chain, ["doc_id"])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leak_rows(find_leaks(_documents(spark, sf_dir), items, ["doc_id"]), ["doc_id"])


def op4_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op5_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return encode_texts(_documents(spark, sf_dir), ["doc_id"], path, digests=True)


def op6_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    documents = _documents(spark, sf_dir).withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    learn = documents.filter(fold != 2)
    network = train(training_sample(learn, "text", "lang", ["doc_id"], Settings()))
    return predict_language(documents, network, ["doc_id", "held_out"])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_documents(spark, sf_dir), ["doc_id"])


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir), ["doc_id"])


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_quality(_documents(spark, sf_dir), ["doc_id"])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), ["doc_id"], digests=True)


def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


def op13_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    documents = _documents(spark, sf_dir).withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    return score_documents(documents, fold != 2, ["doc_id", "held_out"])


QUERIES = {"pipeline": corpus_pipeline.run} | {
    f.__name__: f
    for f in (
        op1_arc_convert,
        op2_toxicity_chain,
        op3_decontaminate,
        op4_covering_simhash,
        op5_word_bpe,
        op6_byte_gru,
        op7_secret_scan,
        op8_license_scan,
        op9_repetition_rules,
        op10_suffix_dedup,
        op11_norm_buckets,
        op12_collocations,
        op13_gru_lm,
    )
}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
ORACLE_SQL["op11_norm_buckets"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
sized AS (SELECT row, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS terms FROM sized),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * texts + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY term, texts),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * texts) // total.terms)))) AS BIGINT) AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN sized USING (row), total
  GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE score > 0)
WHERE rank <= 10
"""
ORACLE_SQL["op12_collocations"] = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
starts AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 6) AS lengths(k)),
f AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, words[i:i + k - 1] AS words, count(*) AS f
  FROM starts GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k >= 2),
cuts AS (
  SELECT lang, phrase, words, k, f AS a, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT u.lang, u.phrase, u.a, cut, x.f AS l, y.f AS r, n,
    CAST((1000::HUGEINT * u.a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts u
  JOIN f x ON x.lang = u.lang AND x.words = u.words[1:cut]
  JOIN f y ON y.lang = u.lang AND y.words = u.words[cut + 1:u.k]
  JOIN total ON total.lang = u.lang),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
spans AS (
  SELECT lang, words, k, f, size, unnest(range(1, k - size + 2)) AS i FROM c, range(2, 5) AS sizes(size) WHERE size < k),
held AS (
  SELECT lang, array_to_string(words[i:i + size - 1], ' ') AS phrase, max(f) AS longer FROM spans GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN held USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= 2000
"""
