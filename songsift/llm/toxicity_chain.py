"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another.  The model of a category reads
the words of a text and the probabilities of all earlier categories.  In
training these are out-of-fold predictions: each row's come from models that
have not seen it, so a later model meets earlier probabilities as uncertain as
they will be on new texts.

The categories before the last one, the label, are learned as well: the words that
tell toxic rows best fall into ``Settings.kinds`` groups of words that occur
together, and a toxic row is of each kind of which it has a word.  No word is
given in advance; a caller may give kinds by their words.

Training uses a bounded sample of labelled rows, ``Settings.rows`` of each value
of the last category, and the ``Settings.words`` words that tell the categories
apart most clearly.  The threshold is the one with the best F1 on the
out-of-fold probabilities of the last category.

A null or empty text has no words and gets the probabilities of a text without
evidence.  Rows with a null id or label are not learned from; of several labels
for an id the larger counts.  Equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from songsift.llm.batches import first_of_each, per_text
from songsift.llm.decontaminate import terms_of
from songsift.session import settle

@dataclass(frozen=True)
class Settings:
    """``rows`` of each label and ``words`` bound what the driver sees; the ``kinds`` come from ``strongest`` words."""

    rows: int = 3000
    words: int = 4096
    least: int = 4
    evidence: float = 10.83
    folds: int = 5
    penalty: float = 0.05
    steps: int = 40
    kinds: int = 2
    strongest: int = 64


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Sparse rows of words and dense columns beside them."""

    def __init__(self, words: list[np.ndarray], n_words: int, dense: np.ndarray):
        self.row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        self.column = np.concatenate([*words, np.zeros(0, np.int64)]).astype(np.int64)
        self.n_words, self.dense = n_words, dense

    def times(self, w: np.ndarray) -> np.ndarray:
        n = self.n_words
        return np.bincount(self.row, w[self.column], len(self.dense)) + self.dense @ w[n:-1] + w[-1]

    def transposed(self, e: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, e[self.row], self.n_words), self.dense.T @ e, [e.sum()]])


def fit_logistic(x: Rows, y: np.ndarray, settings: Settings) -> np.ndarray:
    """Weights of words, dense columns and a constant, by L-BFGS."""
    penalty = np.full(x.n_words + x.dense.shape[1] + 1, settings.penalty)
    penalty[-1] = 0

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(w)
        value = np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (w * w)
        return float(value), x.transposed(logistic(z) - y) + penalty * w

    w = np.zeros(len(penalty))
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(settings.steps):
        step, alphas = slope.copy(), []
        for s, d in reversed(past):
            alphas.append(s @ step / (s @ d))
            step -= alphas[-1] * d
        if past:
            step *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, d), alpha in zip(past, reversed(alphas)):
            step += (alpha - d @ step / (s @ d)) * s
        size = 1.0 if past else 1 / max(1.0, float(np.abs(slope).sum()))
        while size > 1e-8:
            new, new_slope = loss(w - size * step)
            if new <= value - 1e-4 * size * (slope @ step):
                break
            size /= 2
        else:
            break
        moved, turned = -size * step, new_slope - slope
        w, gain, value, slope = w + moved, value - new, new, new_slope
        if moved @ turned > 1e-10:
            past = [*past, (moved, turned)][-8:]
        if gain < 1e-6 * max(1.0, abs(value)):
            break
    return w


def fit_chain(words: list[np.ndarray], n_words: int, labels: np.ndarray, settings: Settings) -> tuple[list, float]:
    """The weights of each category, and the threshold of the last."""
    n = len(words)
    fold = np.arange(n) % settings.folds
    earlier = np.zeros((n, 0))
    models = []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        models.append(fit_logistic(Rows(words, n_words, earlier), y, settings))
        unseen = np.zeros(n)
        for k in range(settings.folds):
            inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            w = fit_logistic(Rows([words[i] for i in inside], n_words, earlier[inside]), y[inside], settings)
            unseen[outside] = logistic(Rows([words[i] for i in outside], n_words, earlier[outside]).times(w))
        earlier = np.column_stack([earlier, unseen])
    return models, best_threshold(earlier[:, -1], labels[:, -1])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Midway between the neighbouring values where F1 is best."""
    if not len(p) or not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    ends = np.append(np.diff(p[order]) != 0, True)
    at = int(np.where(ends, f1, -1).argmax())
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


#: A word also counts by its first bytes, so that its other forms are known.
STEMS = (5, 6, 7, 8)


def features_of(words: list[bytes]) -> set[bytes]:
    distinct = set(words)
    return distinct | {w[:k] + b"*" for w in distinct for k in STEMS if len(w) > k}


_BANDS, _ROWS = 6, 3
_MIX = np.random.default_rng(5).integers(1, 2**63, (_BANDS * _ROWS, 2), np.uint64) | np.uint64(1)


def band_keys(words: list[bytes], shingle: int = 3) -> list[int]:
    """Keys of which near copies of a text share one, by minima of hashed shingles."""
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = np.array([xxhash.xxh64_intdigest(p) for p in parts], np.uint64)
    minima = [int(((hashes ^ x) * y).min()) for x, y in _MIX]
    bands = [minima[b * _ROWS : (b + 1) * _ROWS] for b in range(_BANDS)]
    return [xxhash.xxh64_intdigest(repr((b, band))) >> 1 for b, band in enumerate(bands)]


def _words_and_bands(texts: list[bytes]) -> list:
    words = [terms_of(t) for t in texts]
    # Byte for byte, as a stem may end inside a character.
    features = [sorted(f.decode("latin-1") for f in features_of(own)) for own in words]
    return [pa.array(features, pa.list_(pa.string())), pa.array([band_keys(w) for w in words], pa.list_(pa.int64()))]


def one_of_each_group(found: DataFrame) -> DataFrame:
    """Rows of which no near copy has a smaller hash, and of equal texts one row."""
    bands = found.select("_hash", F.explode("_bands").alias("band"))
    smallest = bands.groupBy("band").agg(F.min("_hash").alias("first"))
    behind = bands.join(smallest, "band").filter("first < _hash").select("_hash").distinct()
    distinct = found.groupBy("_hash", "_words").agg(F.max("_label").alias("_label"))
    return distinct.join(behind, "_hash", "left_anti")


def labelled_sample(labels: DataFrame, id_column: str, label: str, settings: Settings) -> DataFrame:
    """``settings.rows`` ids of each label, chosen by a hash of the id."""
    one = (
        labels.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_label"))
        .filter("_id is not null and _label in (0, 1)")
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    return first_of_each(one, "_label", ["_id"], settings.rows).drop("_hash")


def telling_words(sample: DataFrame, settings: Settings) -> list[str]:
    """Words whose presence goes with the label more than chance would have it, by G squared."""
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("pos")).first()
    n, pos = float(totals["n"]), float(totals["pos"])
    if not 0 < pos < n:
        return []
    counts = (
        sample.select("_label", F.explode("_words").alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).cast("double").alias("df"), F.sum("_label").cast("double").alias("both"))
        .filter(F.col("df") >= settings.least)
    )

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    df, both = F.col("df"), F.col("both")
    share = pos / n
    g = 2 * (
        part(both, df * share)
        + part(df - both, df * (1 - share))
        + part(pos - both, (n - df) * share)
        + part(n - pos - df + both, (n - df) * (1 - share))
    )
    rows = counts.withColumn("g", g).filter(F.col("g") >= settings.evidence)
    return [r["word"] for r in rows.orderBy(F.desc("g"), "word").limit(settings.words).collect()]


def word_groups(words: list[np.ndarray], toxic: np.ndarray, strongest: list[int], groups: int) -> list[list[int]]:
    """The ``strongest`` words that speak for toxic rows, in groups of words that occur together in them.

    The first group starts with the most common word, each further one with the
    word that is least often found with the words that started the others.  Then
    every word joins the group whose words it is found with most, until none moves.
    """
    at = {w: i for i, w in enumerate(strongest)}
    has = np.zeros((len(words), len(strongest)))
    for row, own in enumerate(words):
        has[row, [at[w] for w in own.tolist() if w in at]] = 1
    for_, against = has[toxic].sum(axis=0), has[~toxic].sum(axis=0)
    kept = np.flatnonzero(for_ / max(1, toxic.sum()) > against / max(1, (~toxic).sum()))
    if len(kept) < groups or groups < 1:
        return []
    rows = has[toxic][:, kept]
    size = np.sqrt(rows.sum(axis=0))
    together = rows.T @ rows / np.outer(size, size)
    np.fill_diagonal(together, 0)
    starts = [int(size.argmax())]
    while len(starts) < groups:
        nearest = together[:, starts].max(axis=1)
        nearest[starts] = np.inf
        starts.append(int(nearest.argmin()))
    group = together[:, starts].argmax(axis=1)
    group[starts] = np.arange(groups)
    for _ in range(20):
        means = np.stack([together[:, group == g].sum(axis=1) / max(1, (group == g).sum()) for g in range(groups)], 1)
        new = means.argmax(axis=1)
        new[starts] = np.arange(groups)
        if (new == group).all():
            break
        group = new
    return [[strongest[kept[i]] for i in np.flatnonzero(group == g)] for g in range(groups)]


class Chain:
    def __init__(self, categories: list[str], words: list[str], models: list[np.ndarray], threshold: float):
        self.categories, self.models, self.threshold = categories, models, threshold
        self.number = {w.encode("latin-1"): i for i, w in enumerate(words)}

    def probabilities(self, texts: Iterable[bytes]) -> np.ndarray:
        known = self.number.keys()
        words = [np.array([self.number[w] for w in known & features_of(terms_of(t))], np.int64) for t in texts]
        earlier = np.zeros((len(words), 0))
        for w in self.models:
            earlier = np.column_stack([earlier, logistic(Rows(words, len(self.number), earlier).times(w))])
        return earlier


def train_chain(
    df: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    kinds: dict[str, list[str]] | None = None,
    settings: Settings = Settings(),
) -> Chain:
    """A chain of the kinds of toxic texts and, last, of ``label`` itself, 1 for toxic and 0 for others.

    A text is of a kind if it is labelled toxic and has one of the kind's words.
    The kinds are learned, or given by their words.  Without enough telling words
    the label alone is left.
    """
    # At most twice ``settings.rows`` rows.
    sample = F.broadcast(labelled_sample(labels, id_column, label, settings))
    rows = df.select(F.col(id_column).alias("_id"), F.col(text).alias("_of")).join(sample, "_id")
    rows = rows.withColumn("_hash", F.xxhash64("_of")).select("_label", "_hash", "_of")
    found = settle(
        per_text(
            rows, lambda: _words_and_bands, "_words array<string>, _bands array<bigint>", ["_label", "_hash"], "_of"
        ),
        "labelled",
    )
    # Copies of a text would make its own words look telling, and be known from other folds.
    distinct = settle(one_of_each_group(found), "labelled")
    words = telling_words(distinct, settings)
    number = {w: i for i, w in enumerate(words)}
    vocabulary = F.array(*map(F.lit, words)) if words else F.array().cast(T.ArrayType(T.StringType()))
    named = sorted({w for own in (kinds or {}).values() for w in own})
    given = F.array(*map(F.lit, named)) if named else F.array().cast(T.ArrayType(T.StringType()))
    seen = distinct.select(
        "_hash", "_label", F.array_intersect("_words", vocabulary).alias("_seen"), F.array_intersect("_words", given).alias("_named")
    )
    picked = seen.orderBy("_hash", "_label").collect()
    ids = [np.array([number[w] for w in r["_seen"]], np.int64) for r in picked]
    toxic = np.array([bool(r["_label"]) for r in picked], bool)
    if kinds is None:
        strongest = [i for i, w in enumerate(words) if not w.endswith("*")][: settings.strongest]
        groups = word_groups(ids, toxic, strongest, settings.kinds)
        kinds = {f"kind{g}": [words[i] for i in own] for g, own in enumerate(groups, 1)}
        own_words = [set(r["_seen"]) for r in picked]
    else:
        own_words = [set(r["_named"]) for r in picked]
    targets = np.array([[t and bool(has & set(kinds[k])) for k in kinds] + [t] for t, has in zip(toxic, own_words)], bool)
    models, threshold = fit_chain(ids, len(words), targets.reshape(len(picked), len(kinds) + 1), settings)
    chain = Chain([*kinds, label], words, models, threshold)
    # No text is toxic without evidence.
    chain.threshold = max(threshold, float(chain.probabilities([b""])[0, -1]))
    return chain


def _scorer(chain: Chain) -> Callable[[], Callable[[list[bytes]], list]]:
    def score(texts: list[bytes]) -> list:
        p = chain.probabilities(texts)
        return [*(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array(p[:, -1] > chain.threshold)]

    return lambda: score


def predict_toxicity(df: DataFrame, chain: Chain, keep: list[str], text: str = "text", flag: str = "toxic") -> DataFrame:
    """The probability of each category as ``p_<category>``, and the decision on the last."""
    fields = ", ".join(f"p_{c} double" for c in chain.categories) + f", {flag} boolean"
    return per_text(df, _scorer(chain), fields, keep, text)
